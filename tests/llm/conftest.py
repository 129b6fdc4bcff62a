import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from ripplemap.llm.common import ship  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def docs(spark):
    """``docs(rows)``: a table of documents with columns whose names operators use themselves."""

    def make(rows, schema="doc_id long, text string, source string"):
        names = [x.split()[0] for x in schema.split(",")]
        extra = "key long, fp long, kept boolean, part int, host string, shard int"
        full = [(*r, 1, 2, False, 3, "x", 4) for r in rows]
        taken = ", ".join(x for x in (y.strip() for y in extra.split(",")) if x.split()[0] not in names)
        return spark.createDataFrame(full, f"{schema}, {taken}")

    return make
