"""Session settings and the shared folder for intermediate tables."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings. Sizes are upper limits; they leave small inputs unaffected.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    # Hash instead of sort-merge joins, only where every partition is measured below this size
    # (takes effect only when it is not below the advisory size).
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Rows of large stored tables that meet no row of a small one are left out before the shuffle. The
    # small side may be larger than by default, the large side smaller; neither changes any result.
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256m",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "32m",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ripplemap")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="ripplemap-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # this process made it
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ripplemap/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, plain: tuple[str, ...] = ()) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and later reads prune columns. ``plain`` names columns
    of nearly as many values as rows, for which the writer need not try a dictionary.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    options = {f"parquet.enable.dictionary#{column}": "false" for column in plain}
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def if_any(hot: DataFrame) -> DataFrame | None:
    """Hot keys as a stored table, or None where there are none."""
    kept = stored(hot, "hot_keys")
    return None if kept.isEmpty() else kept
