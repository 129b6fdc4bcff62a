"""Catalog construction: entities, edges, column edges, schema rows, registry, profiles."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemap.functions import constants as K
from ripplemap.functions.typing import type_family
from ripplemap.functions.urn import compact, dataset_urn, expanded, key_kind, registry_urn


MOST_PROFILES = 62


def profile_mask(profiles: list[str]) -> Column:
    """The bit of the row's ``profile``; null for profiles that are not among them."""
    if len(profiles) > MOST_PROFILES:
        raise ValueError(f"at most {MOST_PROFILES} profiles fit into one walk")
    bit = F.when(F.lit(False), F.lit(0).cast("long"))
    for place, name in enumerate(profiles):
        bit = bit.when(F.col("profile") == name, F.lit(1 << place).cast("long"))
    return bit


def with_urn(entities: DataFrame) -> DataFrame:
    """(platform, name, …) plus its dataset URN."""
    return entities.withColumn("urn", dataset_urn(F.col("platform"), F.col("name")))


def edges_from_declared(declared: DataFrame) -> DataFrame:
    """``lineage: map<downstream, array<upstream>>`` to edge rows; empty lists give none."""
    return (
        declared.select(F.explode("lineage").alias("down_name", "ups"))
        .select(F.explode("ups").alias("up_name"), "down_name")
        .distinct()
    )


def column_edges_from_declared(declared: DataFrame) -> DataFrame:
    """``(platform, model, columns: map<column, array<struct<platform, qualified>>>)`` to rows.

    The qualified name splits at its last dot: table before it, column after it.
    """
    flat = declared.select(
        "platform", "model", F.explode("columns").alias("down_col", "sources")
    ).select("platform", "model", "down_col", F.explode("sources").alias("source"))
    split = r"^(.*)\.([^.]*)$"
    qualified = F.col("source.qualified")
    return flat.select(
        dataset_urn(F.col("source.platform"), F.regexp_extract(qualified, split, 1)).alias("up_urn"),
        F.regexp_extract(qualified, split, 2).alias("up_col"),
        dataset_urn(F.col("platform"), F.col("model")).alias("down_urn"),
        "down_col",
    ).distinct()


def with_upstream_platform(
    names: DataFrame, raw_names: DataFrame, warehouse: str, models: str
) -> DataFrame:
    """A name on the raw list lives in the warehouse, any other is a model."""
    raw = raw_names.select("name").distinct().withColumn("_raw", F.lit(True))
    return names.join(raw, "name", "left").select(
        *names.columns,
        F.when(F.col("_raw"), warehouse).otherwise(models).alias("upstream_platform"),
    )


def schema_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, family, native, rows) of every given table; loops over tables, not rows."""

    def rows(table: str, df: DataFrame) -> DataFrame:
        fields = F.array(
            *[
                F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("native"))
                for f in df.schema.fields
            ]
        )
        return (
            df.agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(table).alias("table"), "rows", F.explode(fields).alias("f"))
            .select("table", "f.column", "f.native", "rows")
        )

    listed = reduce(DataFrame.unionByName, [rows(t, df) for t, df in tables.items()])
    return listed.withColumn("family", type_family(F.col("native")))


def describe(entities: DataFrame, descriptions: DataFrame, prefix: str, derived: str) -> DataFrame:
    """Declared description by (platform, name); for the ``derived`` platform a label from the name."""
    label = F.concat(F.lit(prefix), F.translate("name", "_-", "  "))
    return entities.join(descriptions, ["platform", "name"], "left").select(
        *entities.columns,
        F.coalesce("description", F.when(F.col("platform") == derived, label)).alias("description"),
        F.initcap("platform").alias("platform_title"),
    )


def visible_edges(edges: DataFrame, profile_platforms: DataFrame) -> DataFrame:
    """Edges each profile can see: downstream platform connected, inferred only where allowed.

    ``profile_platforms`` is declared configuration: one row per profile and connected platform. It is
    sent to all tasks, since a shuffle by platform would put nearly all edges into a few of them.
    """
    seen = profile_platforms.select(
        "profile", F.col("platform").alias("down_platform"), "emit_inferred"
    )
    return (
        edges.join(F.broadcast(seen), "down_platform")
        .filter(F.col("emit_inferred") | (F.col("provenance") != "inferred"))
        .drop("emit_inferred")
    )


def masked_edges(edges: DataFrame, profile_platforms: DataFrame, profiles: list[str]) -> DataFrame:
    """``visible_edges`` with a row for each edge, not for each profile that sees it: (src, dst,
    up_platform, down_platform, provenance, mask, src_kind, dst_kind) on compact keys, profiles as bits
    of ``mask``. Edges of the same kinds of nodes lie together in each partition.

    ``edges`` have such keys or URNs. An edge that is given twice stays twice; nothing is shuffled.
    """
    if "src" not in edges.columns:
        edges = edges.withColumns({"src": compact(F.col("up_urn")), "dst": compact(F.col("down_urn"))})
    own = profile_platforms.select(
        F.col("platform").alias("down_platform"), "emit_inferred", profile_mask(profiles).alias("_bit")
    ).where("_bit IS NOT NULL")
    seen = own.groupBy("down_platform").agg(
        F.bit_or("_bit").alias("_all"), F.bit_or(F.when(F.col("emit_inferred"), F.col("_bit"))).alias("_some")
    )
    mask = F.when(F.col("provenance") != "inferred", F.col("_all")).otherwise(F.col("_some"))
    rows = edges.join(F.broadcast(seen), "down_platform").select(
        "src", "dst", "up_platform", "down_platform", "provenance", mask.alias("mask"),
        key_kind(F.col("src")).alias("src_kind"), key_kind(F.col("dst")).alias("dst_kind"),
    )
    return rows.where("mask IS NOT NULL").sortWithinPartitions(F.hash("src_kind", "dst_kind"))


def edges_by_profile(masked: DataFrame, profiles: list[str]) -> DataFrame:
    """``masked_edges`` with a row for each profile that sees an edge, as ``visible_edges`` has them."""
    seen = [
        F.when(F.col("mask").bitwiseAND(F.lit(1 << place).cast("long")) != 0, F.lit(name))
        for place, name in enumerate(profiles)
    ]
    return masked.select(
        F.explode(F.array_compact(F.array(*seen))).alias("profile"), expanded(F.col("src")).alias("up_urn"),
        expanded(F.col("dst")).alias("down_urn"), "up_platform", "down_platform", "provenance",
    )


def build_registry(
    platforms: DataFrame, profile_platforms: DataFrame, profiles: list[str]
) -> DataFrame:
    """Every declared platform in every profile; the connector flag says whether it is connected."""
    every = platforms.withColumn("profile", F.explode(F.array(*[F.lit(p) for p in profiles])))
    connected = profile_platforms.select("profile", "platform").withColumn("_on", F.lit(True))
    return every.join(connected, ["profile", "platform"], "left").select(
        "profile",
        "platform",
        F.coalesce("_on", F.lit(False)).alias("connector"),
        "expected",
        "note",
        "hosts_consumers",
    )


def registry_to_wire(registry: DataFrame) -> DataFrame:
    """Registry rows as string maps, booleans in lower case."""
    return registry.select(
        "profile",
        registry_urn(F.col("platform")).alias("urn"),
        F.create_map(
            F.lit(K.KEY_PLATFORM), F.col("platform"),
            F.lit(K.KEY_CONNECTOR), F.col("connector").cast("string"),
            F.lit(K.KEY_EXPECTED), F.col("expected").cast("string"),
            F.lit(K.KEY_NOTE), F.col("note"),
            F.lit(K.KEY_HOSTS), F.col("hosts_consumers").cast("string"),
        ).alias("properties"),
    )


def registry_from_wire(wire: DataFrame, known: list[str], carried: list[str] = ("profile",)) -> DataFrame:
    """Read registry rows back from ``properties`` (a map) or ``pairs`` (key/value structs).

    Rows without the platform key are skipped, missing values and counts that are no number take
    their defaults, the last of repeated keys holds, and only the known platforms' own registry
    entities are read.
    """
    read = wire.filter(F.col("urn").isin([_registry_urn_text(p) for p in known]))

    def value(key: str) -> Column:
        own = F.try_element_at("properties", F.lit(key))
        if "pairs" not in wire.columns:
            return own
        same = F.filter("pairs", lambda p: p["key"] == key)
        last = F.try_element_at(same, F.lit(-1))["value"]
        return F.when(F.col("properties").isNotNull(), own).otherwise(last)

    return read.filter(value(K.KEY_PLATFORM).isNotNull()).select(
        *carried,
        value(K.KEY_PLATFORM).alias("platform"),
        F.coalesce(value(K.KEY_CONNECTOR) == "true", F.lit(False)).alias("connector"),
        F.coalesce(value(K.KEY_EXPECTED).try_cast("bigint"), F.lit(0)).alias("expected"),
        F.coalesce(value(K.KEY_NOTE), F.lit("")).alias("note"),
        (F.coalesce(value(K.KEY_HOSTS), F.lit("true")) == "true").alias("hosts_consumers"),
    )


def _registry_urn_text(platform: str) -> str:
    return f"urn:li:dataset:(urn:li:dataPlatform:{K.REGISTRY_PLATFORM},registry.{platform},{K.ENV})"


def aspect_counts(
    entities: DataFrame, edges: DataFrame, described: DataFrame
) -> DataFrame:
    """Aspects per platform: entity keys, lineage (one per downstream with any edge), descriptions."""
    keys = entities.select("platform", F.lit("key").alias("aspect"), "urn")
    lineage = edges.select(
        F.col("down_platform").alias("platform"), F.lit("lineage").alias("aspect"),
        F.col("down_urn").alias("urn"),
    ).distinct()
    notes = described.filter(F.col("description").isNotNull()).select(
        "platform", F.lit("properties").alias("aspect"), "urn"
    )
    return (
        keys.unionByName(lineage).unionByName(notes)
        .groupBy("platform", "aspect").agg(F.count(F.lit(1)).alias("n"))
    )


def estate_size(registry: DataFrame) -> DataFrame:
    """Declared entities and the platforms without lineage, per profile."""
    return registry.groupBy("profile").agg(
        F.sum("expected").alias("expected"),
        F.array_join(
            F.array_sort(F.collect_set(F.when(~F.col("connector"), F.col("platform")))), ", "
        ).alias("dark_platforms"),
    )
