"""Registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplemap.llm import (
    chat,
    decontam,
    packing,
    phrases,
    pieces_bpe,
    pitman_yor,
    quality,
    repair,
    secrets,
    sharding,
    simhash,
    tokenfile,
    warc,
)
from ripplemap.llm.common import table
from ripplemap.plans.session import stored

# Files of public tokenizers, where this machine has them.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), p AS (
  SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5
), g AS (
  SELECT r, i, words[i:i + 4] AS five FROM p
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r
), m AS (
  SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), flags AS (
  SELECT source, unnest([
    {'rule': 'short', 'bad': n_words < 10}, {'rule': 'repeats', 'bad': 100 * n_repeat_words > 20 * n_words},
    {'rule': 'symbols', 'bad': 100 * n_symbols > 10 * word_chars}, {'rule': 'lines', 'bad': n_dup_lines > 5}]) AS f
  FROM f
), h AS (
  SELECT source, f.rule AS rule, count(*) AS n, count(*) FILTER (f.bad) AS failed FROM flags GROUP BY ALL
), mean AS (
  SELECT rule, sum(failed) / sum(n) AS mean, sum(n) AS total, count(*) AS hosts FROM h GROUP BY rule
), spread AS (
  SELECT rule, any_value(mean) AS mean, sum(n * (failed / n - mean) ** 2) / any_value(total)
    - any_value(mean * (1 - mean) * (hosts - 1) / total) AS between_hosts
  FROM h JOIN mean USING (rule) GROUP BY rule
), weight AS (
  SELECT rule, mean, CASE WHEN between_hosts <= 0 THEN 1e6
    ELSE least(1e6, greatest(1, mean * (1 - mean) / between_hosts - 1)) END AS k
  FROM spread
), rate AS (
  SELECT source, n, k, mean, (failed + mean * k) / (n + k) AS rate FROM h JOIN weight USING (rule)
), verdict AS (
  SELECT source, bool_or(rate - 3 * sqrt(rate * (1 - rate) / (n + k + 1)) > mean + 0.25) AS rejected
  FROM rate GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""


@query("op8_quality_rules", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"), keep=["doc_id"])
    return judged.select("row.doc_id", *quality.LONGS, "base_failed", "kept")


@query("op9_secret_scans")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = secrets.model_of(docs)
    found = docs.select("doc_id", secrets.spans(docs["text"], model).alias("found"))

    def base(kind: int | None = None):
        return F.filter(
            "found", lambda s: s["kind"] < 3 if kind is None else s["kind"] == F.lit(kind)
        )

    return found.select(
        "doc_id",
        *(
            F.size(base(k)).cast("long").alias(f"n_{secrets.KINDS[k]}")
            for k in range(3)
        ),
        F.sha2(secrets.listed(base()), 256).alias("base_sha256"),
        secrets.listed(F.col("found")).alias("spans"),
    )


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query("op1_benchmark_decontamination")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document and benchmark item that it holds, exactly or nearly."""
    found = decontam.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumnsRenamed({"key": "doc_id", "item": "item_id"})


@query("op10_sentencepiece")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    made = pieces_bpe.round_trip(table(spark, folder, "documents"), PIECE_MODEL)
    return made.select(
        F.col("key").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op3_token_files")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    manifest = tokenfile.write(table(spark, folder, "documents"), WORD_TOKENIZER, end=2)
    return tokenfile.read(manifest).withColumnsRenamed({"key": "doc_id", "crc": "ids_crc32"})


@query("op5_sharding")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shards(table(spark, folder, "documents"), n_shards=24)
    return placed.select(
        F.col("key").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_warc")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, folder, "pages")))
    return records.select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
         length(role || text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g'))
         + length(regexp_replace(role, '[^\n]', '', 'g')) + 14 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(length(loss))::BIGINT AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def _log(turns: DataFrame) -> DataFrame:
    """An event log that ends in the given turns.

    All texts come in two deltas. By turn, some are regenerated after a first draft, and some are
    edited after one. Rows of one conversation and turn are messages of their own.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select(
        F.col("conv_id").alias("conversation"),
        F.struct("turn", F.row_number().over(order).alias("nth")).alias("message"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
        F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3)).alias("way"),
    )
    half = F.floor(F.length("text") / 2).cast("int")
    draft = F.reverse("text")
    deltas = [
        (chat.DELTA, F.substring(F.col("text"), F.lit(1), half)),
        (chat.DELTA, F.substring(F.col("text"), half + 1, F.length("text"))),
    ]
    empty = F.lit(None).cast("string")
    ways = {
        0: [(chat.OPEN, empty), *deltas],
        1: [(chat.OPEN, empty), (chat.DELTA, draft), (chat.REGENERATE, empty), *deltas],
        2: [(chat.OPEN, empty), (chat.DELTA, draft), (chat.EDIT, deltas[0][1]), deltas[1]],
    }
    events = F.when(F.lit(False), None)
    for way, steps in ways.items():
        listed = [
            F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), text.alias("text"))
            for k, (kind, text) in enumerate(steps)
        ]
        events = events.when(F.col("way") == way, F.array(*listed))
    return rows.select("conversation", "message", "role", F.explode(events).alias("e")).select(
        "conversation",
        "message",
        F.struct("message", "e.step").alias("sequence"),
        "e.kind",
        F.when(F.col("e.kind") == chat.OPEN, F.col("role")).alias("role"),
        "e.text",
    )


@query("op2_chat_formatting", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], turns.schema)
    segments = chat.render(chat.fold(_log(turns.unionByName(more))))
    read_back = chat.parse(stored(segments, "chat_segments"))
    return chat.digests(read_back).withColumnsRenamed(
        {"conversation": "conv_id", "turns": "n_turns", "chars": "formatted_chars"}
    )


@query("op6_lm_scores")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return pitman_yor.scores(table(spark, folder, "documents")).withColumnRenamed("key", "doc_id")


def _damaged(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, robbed of their ends, repeated or given a wrong role, by a checksum."""
    space = F.lit(" ")
    told = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    way = F.crc32(F.concat(told[0], F.lit(":"), told[1]).cast("binary")) % 20
    text = F.coalesce("text", space)
    rows = turns.select(
        F.col("conv_id").alias("conversation"),
        "turn",
        F.when(way == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(way == 1, "").when(way == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(way == 3, 2).otherwise(1).alias("copies"),
        way.alias("way"),
    ).where("way != 0")
    return rows.select(
        "conversation", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    ).drop("col")


@query("op11_conversation_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    found = repair.summaries(
        turns.select(F.col("conv_id").alias("conversation")), repair.repair(_damaged(turns))
    )
    return found.withColumnsRenamed({"conversation": "conv_id", "sha256": "repaired_sha256"}).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


@query("op12_packing")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), WORD_TOKENIZER, end=1, length=2048)
    return packed.pieces.select(
        F.col("key").alias("doc_id"),
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query("op13_phrases")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"), least=100, first=2000)
