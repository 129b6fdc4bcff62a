"""Model sources, diff feeds, lineage snapshots and tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemap.functions.text import file_stem
from ripplemap.sources.files import read_files

DIFF_BREAK = "\ndiff --git "


def model_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``.sql`` file below ``folder``, one per model name."""
    files = (
        spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.sql")
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("sql_text"))
    )
    return one_per_stem(files)


def written_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a folder that ``files.write_files`` wrote: relative paths, finished writes only."""
    found = read_files(spark, folder, "*.sql")
    paths = read_files(spark, folder, "*.sql", texts=False)
    return one_per_stem(found.withColumnRenamed("text", "sql_text"), paths)


def one_per_stem(files: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The file with the smallest path for each model name, so the pick is stable.

    Only paths are grouped; the text follows in a join, not through the aggregation. ``paths`` are
    those of ``files``, where they can be had without the texts.
    """
    named = files.withColumn("name", file_stem(F.col("path")))
    own = named if paths is None else paths.withColumn("name", file_stem(F.col("path")))
    first = own.groupBy("name").agg(F.min("path").alias("path"))
    return named.join(first, ["name", "path"]).dropDuplicates(["name", "path"])


def diffs(spark: SparkSession, path: str, separator: str | None = DIFF_BREAK) -> DataFrame:
    """Diff texts: one per ``diff --git`` block of concatenated feeds, or one per whole file."""
    if separator is None:
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    rows = spark.read.text(path, lineSep=separator).select(F.col("value").alias("text"))
    return rows.filter(F.trim("text") != "")


def snapshots(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Captured catalog reads (profile, doc): one JSON document per file, or per line.

    ``doc`` is a variant, parsed once; what is no JSON gives no row.
    """
    texts = spark.read.text(path, wholetext=multi_line)
    docs = texts.select(F.try_parse_json("value").alias("doc")).filter(F.col("doc").isNotNull())
    return docs.select(_get("doc", "$.profile", "string").alias("profile"), "doc")


def _get(column: str, path: str, kind: str) -> Column:
    return F.try_variant_get(column, path, kind)


def _entries(rows: DataFrame, variant: Column, *keep: Column | str) -> DataFrame:
    """``keep``, and ``key`` and ``value`` of each field or element of a variant column."""
    spark = rows.sparkSession
    inner = rows.select(*keep, variant.alias("_inner"))
    each = inner.lateralJoin(spark.tvf.variant_explode(F.col("_inner").outer()))
    return each.drop("_inner", "pos")


def _lists(snapshot: DataFrame, part: str) -> DataFrame:
    """(profile, name, urn) of a part that maps names to lists of urns."""
    maps = _entries(snapshot, _get("doc", f"$.{part}", "variant"), "profile")
    urns = _entries(maps, F.col("value"), "profile", F.col("key").alias("name"))
    return urns.select("profile", "name", _get("value", "$", "string").alias("urn"))


def snapshot_lineage(snapshot: DataFrame) -> DataFrame:
    """Rows (profile, root_urn, dir, column, hops, urn) of the keyed lineage map."""
    part = F.split("name", r"\|")
    return _lists(snapshot, "lineage").select(
        "profile",
        part[0].alias("root_urn"),
        part[1].alias("dir"),
        part[2].alias("column"),
        part[3].cast("int").alias("hops"),
        "urn",
    )


def snapshot_search(snapshot: DataFrame) -> DataFrame:
    """Rows (profile, query, urn) of the search map."""
    return _lists(snapshot, "search").withColumnRenamed("name", "query")


def snapshot_registry(snapshot: DataFrame) -> DataFrame:
    rows = _entries(snapshot, _get("doc", "$.registry", "variant"), "profile")
    return rows.select(
        "profile",
        _get("value", "$.platform", "string").alias("platform"),
        _get("value", "$.lineage_connector_configured", "boolean").alias("connector"),
        _get("value", "$.expected_entity_count", "long").alias("expected"),
        _get("value", "$.note", "string").alias("note"),
        F.coalesce(_get("value", "$.hosts_consumers", "boolean"), F.lit(True)).alias("hosts_consumers"),
    )


def table_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    """A catalog table, or nothing when it does not exist."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def columns_of(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    """Column names and types of a table; a missing table has none."""
    df = table_or_none(spark, name)
    return [] if df is None else [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
