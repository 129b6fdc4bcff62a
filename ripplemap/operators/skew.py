"""Joins that stay balanced when one key holds a large share of the rows.

Heavy keys are found by a map-side combined count and chosen by their size only. Their list is
sent to all tasks where it has no more than ``SENT_KEYS`` rows, else it is joined like any table.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENT_KEYS = 100_000
BUCKETS = 1 << 16
ROWS_PER_SHARD = 2_000_000


def hot_keys(
    counts: DataFrame, keys: list[str], n: str = "n", rows_per_shard: int = ROWS_PER_SHARD
) -> DataFrame:
    """Keys that need more than one shard, with their shard count."""
    return (
        counts.filter(F.col(n) > rows_per_shard)
        .select(*keys, F.ceil(F.col(n) / rows_per_shard).cast("int").alias("_shards"))
    )


def crowded_keys(
    rows: DataFrame, keys: list[str], rows_per_shard: int = ROWS_PER_SHARD, buckets: int = BUCKETS
) -> DataFrame:
    """``hot_keys`` of the rows themselves. A key with many rows lies in a bucket with many, so buckets
    are counted first, and only the keys of such buckets one by one: few rows are shuffled."""
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")
    counts = rows.select(place).groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    full = counts.filter(F.col("n") > rows_per_shard).select("_bucket")
    met = rows.select(*keys, place).join(F.broadcast(full), "_bucket", "left_semi")
    return hot_keys(met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "n", rows_per_shard)


def _sent(hot: DataFrame) -> DataFrame:
    return F.broadcast(hot) if hot.count() <= SENT_KEYS else hot


def split_rows(df: DataFrame, hot: DataFrame | None, keys: list[str], by: str) -> DataFrame:
    """Spread each hot key's rows over its shards by the hash of ``by``; no-op without hot keys."""
    if hot is None:
        return df
    shards = F.coalesce(F.col("_shards"), F.lit(1))
    return (
        df.join(_sent(hot), keys, "left")
        .withColumn("_shard", F.pmod(F.xxhash64(by), shards).cast("int"))
        .drop("_shards")
    )


def repeat_rows(df: DataFrame, hot: DataFrame | None, keys: list[str]) -> DataFrame:
    """One copy per shard for rows that meet a hot key, one copy otherwise."""
    if hot is None:
        return df
    last = F.coalesce(F.col("_shards"), F.lit(1)) - 1
    return (
        df.join(_sent(hot), keys, "left")
        .withColumn("_shard", F.explode(F.sequence(F.lit(0), last)))
        .drop("_shards")
    )


def shard_key(hot: DataFrame | None) -> list[str]:
    return [] if hot is None else ["_shard"]


def join_split(
    many: DataFrame, one: DataFrame, hot: DataFrame | None, keys: list[str], by: str
) -> DataFrame:
    """Join ``many`` (may hold hot keys) with ``one`` on ``keys``, hot keys spread over shards."""
    on = keys + shard_key(hot)
    return split_rows(many, hot, keys, by).join(repeat_rows(one, hot, keys), on).drop("_shard")
