"""Read surface of the catalog: search, lookups, schema fields, query log, documents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplemap.functions.constants import GREP_CONTEXT
from ripplemap.operators import cube

# Quoted JSON strings, escapes included, with the colon that would make one a key.
JSON_STRING = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:?)'


def search(
    entities: DataFrame,
    queries: list[str],
    limit: int | None = None,
    where: Column | None = None,
    sort_by: tuple[Column, ...] = (),
) -> DataFrame:
    """Case-insensitive substring search: all hits (urn, query), or the first ``limit`` per query.

    ``where`` keeps matching entities only; ``sort_by`` orders the hits before their urns do. The
    user's query texts are tested on each entity row, so there is no join. With a limit, hits get a
    ``rank``, and the rank filter is evaluated before the shuffle as well.
    """
    hits = F.filter(
        F.array(*[F.lit(q) for q in queries]), lambda q: F.contains(F.lower("urn"), F.lower(q))
    )
    kept = entities if where is None else entities.filter(where)
    found = kept.withColumn("query", F.explode(hits))
    if limit is None:
        return found.select("urn", "query")
    rank = F.row_number().over(W.partitionBy("query").orderBy(*sort_by, "urn"))
    return found.select("urn", "query", rank.alias("rank")).filter(F.col("rank") <= limit)


def lookup(entities: DataFrame, urns: DataFrame) -> DataFrame:
    return entities.join(urns.select("urn").distinct(), "urn", "left_semi")


def lineage(
    requests: DataFrame, found: DataFrame, name_filter: str | None = None, limit: int | None = None
) -> DataFrame:
    """Lineage of each request (profile, root_urn, dir, column, hops) from ``cube.asked_distances``
    or a stored cube, with an optional name filter and cap."""
    if name_filter is not None:
        found = found.filter(F.contains(F.lower("urn"), F.lit(name_filter.lower())))
    rows = cube.answers(requests, found)
    if limit is not None:
        keys = [c for c in rows.columns if c != "urn"]
        rows = rows.withColumn(
            "_rank", F.row_number().over(W.partitionBy(*keys).orderBy("urn"))
        ).filter(F.col("_rank") <= limit).drop("_rank")
    return rows


def keyed_closure(requests: DataFrame, found: DataFrame) -> DataFrame:
    """Size and extremes of each requested closure; a missing key answers with nothing, not an error."""
    keys = ["profile", "root_urn", "dir", "column", "hops"]
    sizes = cube.answers(requests, found).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("urn").alias("first_urn"), F.max("urn").alias("last_urn")
    )
    return requests.select(*keys).distinct().join(sizes, keys, "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def schema_fields(rows: DataFrame, keywords: list[str]) -> DataFrame:
    wanted = F.array(*[F.lit(k.lower()) for k in keywords])
    return rows.filter(F.exists(wanted, lambda k: F.contains(F.lower("column"), k)))


def query_history(log: DataFrame, column: str | None = None) -> DataFrame:
    """Queries per entity, a relevance signal; optionally only those naming a column."""
    rows = log if column is None else log.filter(F.col("column") == column)
    return rows.groupBy("urn").agg(
        F.count(F.lit(1)).alias("queries"), F.max("ts").alias("last_ts")
    )


def grep_documents(
    documents: DataFrame, ids: DataFrame, pattern: str, context: int = GREP_CONTEXT
) -> DataFrame:
    """Matches in the named documents: count, and the first one with text around it."""
    head = F.regexp_extract("text", rf"(?s)\A(.*?)({pattern})", 1)
    match = F.regexp_extract("text", rf"(?s)\A(.*?)({pattern})", 2)
    tail = F.substr("text", F.length("head") + F.length("match") + 1, F.lit(context))
    return (
        documents.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        .select("doc_id", "text", F.size(F.regexp_extract_all("text", F.lit(f"({pattern})"))).alias("matches"))
        .filter(F.col("matches") > 0)
        .select("doc_id", "matches", head.alias("head"), match.alias("match"), "text")
        .select("doc_id", "matches", F.concat(F.right("head", F.lit(context)), "match", tail).alias("context"))
    )


def search_documents(documents: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Documents that hold the query: all, or the first ``limit`` by id."""
    hits = documents.filter(F.contains("text", F.lit(query)))
    found = hits.select("doc_id", "source")
    return found if limit is None else found.orderBy("doc_id").limit(limit)


def harvest_urns(payloads: DataFrame, prefix: str) -> DataFrame:
    """(id, urn, pos): string values of any nested JSON that start with ``prefix``, first seen first.

    Strings are read left to right as whole JSON tokens, so keys and text inside other strings do
    not count. A payload that is not JSON is one plain string, which counts if it starts with the
    prefix. All of it happens in the row.
    """
    tokens = F.filter(
        F.regexp_extract_all("payload", F.lit(JSON_STRING)),
        lambda t: F.startswith(t, F.lit('"' + prefix)) & ~F.endswith(t, F.lit(":")),
    )
    values = F.transform(
        tokens, lambda t: F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$[0]")
    )
    plain = F.filter(F.array("payload"), lambda t: F.startswith(t, F.lit(prefix)))
    found = F.when(F.try_parse_json("payload").isNotNull(), values).otherwise(plain)
    return payloads.select("id", F.posexplode(F.array_distinct(found)).alias("pos", "urn"))
