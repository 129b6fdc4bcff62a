"""Combined check: a change and its edits must build together, away from everything else.

Models are SQL texts whose inputs are named in braces; Spark resolves them against the given
DataFrames, so nothing is registered and the real tables are not touched. Models are files of one
project, so looping over them on the driver is bounded; their rows never leave the cluster.
"""

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemap.functions import constants as K
from ripplemap.operators.rewrite import apply_change, rewrite_sql

RESULT = "variant string, model string, attempt int, exit_code int, rows bigint, matches boolean, output_tail string"


def rewritten(
    spark: SparkSession, models: dict[str, str], change: dict[str, str], broken: list[str]
) -> tuple[str, dict[str, str]]:
    """The changed model's own text and the edits of the models it breaks."""
    sources = spark.createDataFrame(
        [(name, f"models/{name}.sql", sql) for name, sql in models.items()],
        "name string, path string, sql_text string",
    )
    changes = spark.createDataFrame(
        [(0, change["model"], change["column"], change["new_value"])],
        "change_id int, model string, column string, new_value string",
    )
    own = apply_change(sources, changes).select("modified").first()[0]
    new_text = rewrite_sql(
        F.col("sql_text"), F.lit(K.UPDATE_REFERENCES), F.lit(change["column"]), F.lit(change["new_value"])
    )
    edits = sources.filter(F.col("name").isin(broken)).select("name", new_text.alias("t")).collect()
    return own, {r["name"]: r["t"] for r in edits}


def _fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free hash by column position, so renamed columns still compare."""
    cells: list[Column] = [F.col(f"`{c}`").cast("string") for c in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.xxhash64(*cells).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h"),
        F.lit(len(df.columns)).alias("width"),
    )


def _build(
    spark: SparkSession, inputs: dict[str, DataFrame], models: dict[str, str]
) -> dict[str, DataFrame | str]:
    """Each model as a DataFrame, or the error text when it does not resolve."""
    built: dict[str, DataFrame | str] = {}
    for name, sql in models.items():
        ready = {k: v for k, v in {**inputs, **built}.items() if isinstance(v, DataFrame)}
        try:
            built[name] = spark.sql(sql, **{k: v for k, v in ready.items() if f"{{{k}}}" in sql})
        except (PySparkException, KeyError) as error:
            built[name] = str(error)[-K.OUTPUT_TAIL :]
    return built


def combined_check(
    spark: SparkSession,
    inputs: dict[str, DataFrame],
    models: dict[str, str],
    change: dict[str, str],
    broken: list[str],
) -> DataFrame:
    """Attempt rows per model: the change alone, then the change with its edits, against the baseline."""
    own, edits = rewritten(spark, models, change, broken)
    changed = {**models, change["model"]: own}
    baseline = _build(spark, inputs, models)
    variants = {
        "change_only": _build(spark, inputs, changed),
        "change_and_edits": _build(spark, inputs, {**changed, **edits}),
    }
    rows = []
    for attempt, (variant, built) in enumerate(variants.items(), start=1):
        for name, result in built.items():
            label = [F.lit(variant).alias("variant"), F.lit(name).alias("model"), F.lit(attempt).alias("attempt")]
            if isinstance(result, str):
                rows.append(spark.createDataFrame([(variant, name, attempt, 1, None, False, result)], RESULT))
                continue
            if isinstance(baseline[name], str):
                # It builds now and did not before: there is nothing that it could match.
                rows.append(
                    _fingerprint(result).select(
                        *label, F.lit(0).alias("exit_code"), "rows", F.lit(False).alias("matches"),
                        F.lit("").alias("output_tail"),
                    )
                )
                continue
            # Both sides are one-row aggregates.
            want = _fingerprint(baseline[name]).select(F.struct("rows", "h", "width").alias("w"), F.lit(1).alias("k"))
            got = _fingerprint(result).select("rows", F.struct("rows", "h", "width").alias("g"), F.lit(1).alias("k"))
            rows.append(
                got.join(want, "k").select(
                    *label, F.lit(0).alias("exit_code"), "rows", (F.col("g") == F.col("w")).alias("matches"),
                    F.lit("").alias("output_tail"),
                )
            )
    return reduce(DataFrame.unionByName, rows)
