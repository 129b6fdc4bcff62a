"""Registry of checkable queries: a Spark callable and, where SQL can say it, its DuckDB text."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ripplemap.bridge.ctes import compose
from ripplemap.bridge.tables import Driver
from ripplemap.plans.session import tune

_WORKSPACES: dict[tuple[str, str], Driver] = {}


def workspace(spark: SparkSession, folder: str, fresh: bool = False) -> Driver:
    """Inputs and stored review tables of one folder, shared by the queries of one session.

    All reports of a review read the same catalog, closure and verdict tables, so these are
    written once per session. ``fresh`` builds everything anew.
    """
    key = (spark.sparkContext.applicationId, folder)
    if fresh or key not in _WORKSPACES:
        _WORKSPACES[key] = Driver(tune(spark), folder)
    return _WORKSPACES[key]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(driver) -> DataFrame`` under ``name``."""

    def register(build: Callable[[Driver], DataFrame]) -> Callable[[Driver], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(workspace(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = compose(sql)
        return build

    return register
