"""Phrase collocations mined with stripes: each prefix keys an associative counter of next words.

One pass over the texts for each phrase length. A task counts the next words of every prefix in its
own texts and sends one stripe a prefix: the prefix once, then next words and counts. Stripes of one
prefix meet in one task and are merged elementwise. The merged stripes hold all there is to know:

* extensions: the entries with enough occurrences are the phrases, and the prefixes of the next pass;
* prefix totals: an entry's count is the total of the prefix that it makes with the next word;
* subsumption maxima: the largest entry of a stripe, and of the entries that end alike, say how often
  the likeliest longer phrase occurs. One word more is enough to look at, since a phrase in between
  occurs at least as often as the longer one.

A phrase as frequent as asked for has only such phrases inside. So a pass counts no window whose two
shorter phrases were not frequent. That leaves many pairs of common words, so that pairs are first
counted by hash, in one bucket for each ``WORDS_A_BUCKET`` words of the corpus, and those in buckets
with too few occurrences are left out as well. Bitmaps of fixed size (``FILTER_BITS``) tell tasks
which phrases and buckets may be frequent; their false alarms cost time only, since merged counts are
exact. Prefixes with more than one in
``HOT_SHARE`` of all words (at most that many a length) have their stripes cut by next word. A task
sends its stripes in bundles, ``BUNDLES`` for each partition of the shuffle.

Words, pieces and case are those of ``Cut``. Defined results: a null or empty text has no words; a
null group is called ``und``; repeated rows count as often as they occur; ties are ordered by count,
then by the phrase's bytes; an empty table gives no row; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemap.plans.session import stored

# What ends a piece, and what separates words in it.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

FILTER_BITS = 1 << 26
HOT_SHARE = 2000
BUNDLES = 4
WORDS_A_BUCKET = 16
MERGE_ROWS = 400_000
BLOCK_BYTES = 6 << 20

_KIND = np.zeros(256, np.uint8)  # 0: part of a word, 1: blank, 2: break
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2
_LOWER = bytes(range(256)).lower()  # A-Z only


class Cut:
    """Words of some texts of one group, as numbers into ``names``, with the piece of each."""

    def __init__(self, group: str, texts: list[bytes]):
        self.group = group
        raw = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
        kind = _KIND[raw]
        part = kind == 0
        edge = np.flatnonzero(np.diff(part, prepend=False, append=False))
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), edge[::2]).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(edge[1::2] - edge[::2])])
        del kind, edge
        words = pa.Array.from_buffers(
            pa.large_binary(),
            len(self.piece),
            [None, pa.py_buffer(ends), pa.py_buffer(raw[part])],
        ).dictionary_encode()
        self.words = words.indices.to_numpy()
        self.names = words.dictionary.cast(pa.large_string())
        self.hashes = word_hashes(self.names)
        self.seed = int(word_hashes([group])[0])


def word_hashes(names) -> np.ndarray:
    names = names.to_pylist() if isinstance(names, pa.Array) else names
    return pd.util.hash_array(np.array(names, object), categorize=False)


def longer(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on with one more word."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed + more) * np.uint64(0xBF58476D1CE4E5B9)


def window_hashes(cut: Cut, n: int) -> np.ndarray:
    """For each word, the hash of the ``n`` words that begin there, pieces not regarded."""
    total = max(len(cut.words) - n + 1, 0)
    out = np.full(total, cut.seed, np.uint64)
    for k in range(n):
        out = longer(out, cut.hashes[cut.words[k : k + total]])
    return out


def _place(hashes: np.ndarray, size: int) -> np.ndarray:
    """A bucket of so many (a power of two); with fewer of them, the same modulo their number."""
    return hashes >> np.uint64(17) & np.uint64(size - 1)


def _cells(bit: np.ndarray) -> pa.RecordBatch:
    """Set bits as 64-bit cells."""
    cells, inverse = np.unique(bit >> np.uint64(6), return_inverse=True)
    values = np.zeros(len(cells), np.uint64)
    np.bitwise_or.at(values, inverse, np.uint64(1) << (bit & np.uint64(63)))
    return pa.record_batch(
        [pa.array(cells.astype(np.int64)), pa.array(values.view(np.int64))], names=["cell", "value"]
    )


class Filter:
    """Phrases that may be frequent: none of those is missing."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    @staticmethod
    def collected(found: DataFrame, bits: int) -> Filter:
        """From ``cell`` and ``value``; at most ``bits / 64`` numbers reach the driver."""
        cells = np.zeros(bits // 64, np.uint64)
        for row in found.groupBy("cell").agg(F.bit_or("value").alias("value")).toLocalIterator():
            cells[row["cell"]] = row["value"] & 0xFFFFFFFFFFFFFFFF
        return Filter(cells)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        bit = _place(hashes, len(self.cells) * 64)
        return (self.cells[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)

    @staticmethod
    def of(phrases: DataFrame, bits: int) -> Filter:
        """From a table of ``lang`` and ``phrase``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                out = word_hashes(batch.column("lang"))
                split = pd.DataFrame([p.split(" ") for p in batch.column("phrase").to_pylist()])
                for k in split:
                    out = longer(out, word_hashes(split[k]))
                yield _cells(_place(out, bits))

        found = phrases.select("lang", "phrase").mapInArrow(run, "cell long, value long")
        return Filter.collected(found, bits)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[Cut]:
    """The texts of a task by group, some at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        groups, texts = batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())
        for group, text in zip(groups, texts.to_pylist(), strict=True):
            held.setdefault(group, []).append(text)
            size += len(text) + 1
            if size >= block_bytes:
                yield from (Cut(*x) for x in held.items())
                held, size = {}, 0
    yield from (Cut(*x) for x in held.items())


def word_counts(texts: DataFrame, block_bytes: int) -> DataFrame:
    """``lang``, ``phrase`` (one word) and ``count``; a null phrase has the total of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in _blocks(batches, block_bytes):
            counts = np.append(np.bincount(cut.words, minlength=len(cut.names)), len(cut.words))
            names = pa.concat_arrays([cut.names.cast(pa.string()), pa.nulls(1, pa.string())])
            groups = pa.array([cut.group] * len(names))
            yield pa.record_batch([groups, names, pa.array(counts)], names=["lang", "phrase", "count"])

    found = texts.mapInArrow(run, "lang string, phrase string, count long")
    return found.groupBy("lang", "phrase").agg(F.sum("count").alias("count"))


def _windows(cut: Cut, n: int, shorter: Filter) -> np.ndarray:
    """Where windows of ``n`` words begin whose two shorter phrases may be frequent."""
    if len(cut.words) < n:
        return np.zeros(0, np.int64)
    may = shorter.test(window_hashes(cut, n - 1))
    return np.flatnonzero(may[:-1] & may[1:] & (cut.piece[: 1 - n] == cut.piece[n - 1 :]))


def _hashes_at(cut: Cut, n: int, at: np.ndarray) -> np.ndarray:
    out = np.full(len(at), cut.seed, np.uint64)
    for k in range(n):
        out = longer(out, cut.hashes[cut.words[at + k]])
    return out


def pair_filter(
    texts: DataFrame, frequent: Filter, least: int, all_words: int, bits: int, block_bytes: int
) -> Filter:
    """Pairs in buckets with at least ``least`` occurrences, one bucket for some words of the corpus.

    A task adds up the buckets of its own texts and sends them in ranges; a range is added up by one
    task in an array of its buckets.
    """
    spark = texts.sparkSession
    buckets = 1 << max(16, (all_words // WORDS_A_BUCKET).bit_length())
    ranges = min(buckets, 1 << (BUNDLES * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    width, bits = buckets // ranges, min(bits, buckets)
    shared = spark.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in _blocks(batches, block_bytes):
            at = _windows(cut, 2, shared.value)
            own, n = np.unique(_place(_hashes_at(cut, 2, at), buckets), return_counts=True)
            place, inner = np.divmod(own.astype(np.int64), width)
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            offsets = pa.array(np.append(starts, len(own)), pa.int32())
            steps = np.diff(inner, prepend=0)  # small numbers are shuffled in fewer bytes
            steps[starts] = inner[starts]
            made = [pa.array(steps, pa.int64()), pa.array(n, pa.int64())]
            made = [pa.ListArray.from_arrays(offsets, x) for x in made]
            yield pa.record_batch(
                [pa.array(place[starts]), *made], names=["place", "steps", "counts"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, np.zeros(width, np.int64)

        def done() -> pa.RecordBatch:
            many = np.flatnonzero(total >= least) + held * width
            return _cells(many.astype(np.uint64) & np.uint64(bits - 1))

        for batch in batches:
            lists = [batch.column(c) for c in ("steps", "counts")]
            flat = [x.flatten().to_numpy() for x in lists]
            ends = np.cumsum(lists[0].value_lengths().to_numpy())
            for place, stop, n in zip(batch.column("place").to_pylist(), ends, lists[0].value_lengths().to_pylist()):
                if held is not None and place != held:
                    yield done()
                    total[:] = 0
                held = place
                total[np.cumsum(flat[0][stop - n : stop])] += flat[1][stop - n : stop]
        if held is not None:
            yield done()

    found = texts.mapInArrow(count, "place long, steps array<long>, counts array<long>")
    dealt = found.repartition("place").sortWithinPartitions("place")
    return Filter.collected(dealt.mapInArrow(add, "cell long, value long"), bits)


def _stripes(
    cut: Cut, n: int, shorter: Filter, own: Filter | None, hot: set[int], buckets: int
) -> pa.RecordBatch | None:
    """Stripes of all prefixes of ``n - 1`` words, the next words of each with their counts, in
    bundles by a hash of the prefix, or for a hot prefix of prefix and next word."""
    at = _windows(cut, n, shorter)
    if own is not None:
        at = at[own.test(_hashes_at(cut, n, at))]
    if not len(at):
        return None
    size = np.int64(len(cut.names))
    prefix = cut.words[at].astype(np.int64)
    where = at  # a place of each different prefix
    for k in range(1, n - 1):
        prefix = np.unique(prefix * size + cut.words[at + k], return_inverse=True)[1]
    first = np.zeros(int(prefix.max()) + 1, np.int64)
    first[prefix] = where
    last = cut.words[at + n - 1].astype(np.int64)
    hashes = _hashes_at(cut, n - 1, first)
    hot_prefix = np.isin(hashes, np.fromiter(hot, np.uint64, len(hot)))
    keys, counts = np.unique(prefix * size + last, return_counts=True)
    stripe, following = np.divmod(keys, size)
    mixed = hashes[stripe]
    mixed = np.where(hot_prefix[stripe], longer(mixed, cut.hashes[following]), mixed)
    bucket = (mixed >> np.uint64(7)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, stripe, following, counts = (x[order] for x in (bucket, stripe, following, counts))
    starts = np.flatnonzero((np.diff(bucket, prepend=buckets) != 0) | (np.diff(stripe, prepend=-1) != 0))
    place = first[stripe[starts]]
    names = [cut.names.take(pa.array(cut.words[place + k])) for k in range(n - 1)]
    offsets = pa.array(np.append(starts, len(keys)), pa.int32())
    prefixes = pc.binary_join_element_wise(*names, pa.scalar(" ", pa.large_string())).cast(pa.string())
    stripes = pa.StructArray.from_arrays(
        [
            prefixes,
            pa.ListArray.from_arrays(offsets, cut.names.take(pa.array(following)).cast(pa.string())),
            pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
        ],
        ["prefix", "following", "counts"],
    )
    own = bucket[starts]
    begins = np.flatnonzero(np.diff(own, prepend=buckets) != 0)
    return pa.record_batch(
        [
            pa.array([cut.group] * len(begins)),
            pa.array(own[begins].astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(np.append(begins, len(own)), pa.int32()), stripes),
        ],
        names=["lang", "bucket", "stripes"],
    )


def merged_stripes(
    texts: DataFrame,
    n: int,
    least: int,
    shorter: Filter,
    own: Filter | None,
    hot: set[int],
    block_bytes: int,
) -> DataFrame:
    """``lang``, ``phrase`` (of ``n`` words) and ``count``: entries of all merged stripes with at
    least so many."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((shorter, own, hot))
    buckets = BUNDLES * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in _blocks(batches, block_bytes):
            bundles = _stripes(cut, n, *shared.value, buckets)
            if bundles is not None:
                yield from (bundles.slice(k, 20) for k in range(0, bundles.num_rows, 20))

    stripe = "struct<prefix: string, following: array<string>, counts: array<long>>"
    bundles = texts.mapInArrow(run, f"lang string, bucket int, stripes array<{stripe}>")
    dealt = bundles.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda b: _merged(b, least), "lang string, phrase string, count long")


def _entries(bundles: pa.RecordBatch) -> pa.Table:
    """The entries of some bundles, as columns."""

    def places(lists) -> pa.Array:
        return pa.array(np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()))

    lists = bundles.column("stripes")
    stripes = lists.flatten()
    following, of_stripe = stripes.field("following"), places(stripes.field("following"))
    columns = [
        bundles.column("lang").take(places(lists)).take(of_stripe),
        stripes.field("prefix").take(of_stripe),
        following.flatten(),
        stripes.field("counts").flatten(),
    ]
    return pa.table(columns, names=["lang", "prefix", "following", "count"])


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Add stripes up elementwise, a bucket at a time, in sorted input."""
    key = ["lang", "prefix", "following"]
    bucket, held, rows = None, [], 0

    def added() -> pa.Table:
        total = pa.concat_tables(held).group_by(key).aggregate([("count", "sum")])
        return total.rename_columns({"count_sum": "count"})

    def done() -> list[pa.RecordBatch]:
        total = added()
        total = total.filter(pc.greater_equal(total["count"], least))
        phrase = pc.binary_join_element_wise(total["prefix"], total["following"], " ")
        return pa.table([total["lang"], phrase, total["count"]], ["lang", "phrase", "count"]).to_batches()

    for batch in batches:
        own = batch.column("bucket").to_numpy()
        for start, stop in zip(*(np.flatnonzero(np.diff(own, prepend=-1, append=-1))[k:] for k in (0, 1))):
            if bucket is not None and own[start] != bucket:
                yield from done()
                held, rows = [], 0
            bucket = own[start]
            held.append(_entries(batch.slice(start, stop - start)))
            rows += len(held[-1])
            if rows > MERGE_ROWS:
                held = [added()]
                rows = len(held[0])
    if held:
        yield from done()


def _hot(phrases: DataFrame, all_words: int) -> set[int]:
    """Hashes of the phrases that hold a large share of all places; fewer than ``HOT_SHARE``."""
    found = phrases.where(F.col("count") * HOT_SHARE > all_words).select("lang", "phrase").collect()
    out = set()
    for lang, phrase in found:
        hashed = word_hashes([lang])
        for word in phrase.split(" "):
            hashed = longer(hashed, word_hashes([word]))
        out.add(int(hashed[0]))
    return out


def frequent_phrases(
    docs: DataFrame,
    least: int,
    longest: int = 5,
    text: str = "text",
    group: str = "lang",
    filter_bits: int = FILTER_BITS,
    block_bytes: int = BLOCK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words with at least ``least`` occurrences: ``lang``,
    ``phrase``, ``words`` and ``count``; and the number of words of each ``lang``, ``total``."""
    own = docs.select(
        F.coalesce(docs[group].cast("string"), F.lit("und")).alias("lang"), docs[text].alias("text")
    ).where(F.octet_length("text") > 0)
    words = word_counts(own, block_bytes)
    words = stored(words.where((F.col("count") >= least) | F.col("phrase").isNull()), "words")
    totals = words.where(F.col("phrase").isNull()).select("lang", F.col("count").alias("total"))
    levels = [words.where(F.col("phrase").isNotNull())]
    all_words = totals.agg(F.sum("total")).first()[0] or 0
    while len(levels) < longest and not levels[-1].isEmpty():
        shorter, pairs, hot = Filter.of(levels[-1], filter_bits), None, _hot(levels[-1], all_words)
        if len(levels) == 1:
            pairs = pair_filter(own, shorter, least, all_words, filter_bits, block_bytes)
        found = merged_stripes(own, len(levels) + 1, least, shorter, pairs, hot, block_bytes)
        levels.append(stored(found, f"phrases_{len(levels) + 1}"))
    out = levels[0].withColumn("words", F.lit(1))
    for k, level in enumerate(levels[1:], 2):
        out = out.unionByName(level.withColumn("words", F.lit(k)))
    return out, totals


def subsumed_by(phrases: DataFrame) -> DataFrame:
    """``lang``, ``phrase`` and ``most``, the count of the likeliest phrase with one word more on
    either side."""
    p = F.split("phrase", " ")
    ends = F.array(*(F.array_join(F.slice(p, k, F.col("words") - 1), " ") for k in (F.lit(1), F.lit(2))))
    inner = phrases.where("words > 2").select("lang", F.explode(ends).alias("phrase"), "count")
    return inner.groupBy("lang", "phrase").agg(F.max("count").alias("most"))


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), in 38 digits."""
    whole = [c.cast("decimal(19,0)") for c in (a, n, left, right)]
    above = (F.lit(1000).cast("decimal(4,0)") * whole[0]).cast("decimal(23,0)") * whole[1]
    return F.call_function("div", above.cast("decimal(38,0)"), (whole[2] * whole[3]).cast("decimal(38,0)"))


def collocations(
    docs: DataFrame,
    least: int = 100,
    longest: int = 5,
    first: int | None = None,
    percent: int = 100,
    **more,
) -> DataFrame:
    """Phrases by how much oftener they occur than their parts would by chance.

    ``lang``, ``rank``, ``phrase``, ``a`` (its occurrences), ``l`` and ``r`` (those of both parts at
    the cut of the lowest score), ``n`` (words of the group) and ``score``. Left out are phrases
    inside a longer frequent one with at least ``percent`` of their occurrences. ``first`` asks for
    the head of each group's list.
    """
    phrases, totals = frequent_phrases(docs, least, longest, **more)
    inside = subsumed_by(phrases)
    kept = (
        phrases.where("words > 1")
        .join(inside, ["lang", "phrase"], "left")
        .where(F.col("most").isNull() | (F.col("most") * 100 < F.col("count") * percent))
        .join(totals, "lang")
    )
    parts = F.split("phrase", " ")
    cuts = kept.select(
        "lang", "phrase", F.col("count").alias("a"), F.col("total").alias("n"), "words", parts.alias("p"),
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
    ).select(
        "lang", "phrase", "a", "n", "k",
        F.array_join(F.slice("p", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("p", F.col("k") + 1, F.col("words")), " ").alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        part = phrases.select("lang", F.col("phrase").alias(side), F.col("count").alias(name))
        cuts = cuts.join(part, ["lang", side])
    scored = cuts.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long"))
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "b.l", "b.r", "n", "b.score")
