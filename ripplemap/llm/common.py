"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what separates words, as a regular expression.
GAP = r"[\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


# Rows that Spark hands to a task at once, where the session has its default of 10,000: texts are long.
ARROW_ROWS = 1000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and keep batches of texts small."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(_ARROW) == "10000":
        spark.conf.set(_ARROW, str(ARROW_ROWS))
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where the body names it often."""
    return F.transform(F.array(value), body)[0]


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """Columns ``key`` and ``text`` under these fixed names; all other columns are left behind."""
    return docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"), *more)


def pieces(
    batches: Iterator[pa.RecordBatch], max_bytes: int, text: str = "text"
) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``max_bytes`` of text, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def bounded_sample(docs: DataFrame, rows: int, key: str = "key") -> DataFrame:
    """At most ``rows`` rows, chosen by a hash of the key and the row's place in the input, so that no
    key is too common to be cut; only keys are read and hashes sorted to find them."""
    place = F.xxhash64(key, F.monotonically_increasing_id())
    last = docs.select(place.alias("place")).orderBy("place").limit(rows).agg(F.max("place"))
    bound = last.first()[0]
    chosen = docs.withColumn("_place", place).where(F.col("_place") <= bound if bound is not None else F.lit(False))
    return chosen.drop("_place").limit(rows)
