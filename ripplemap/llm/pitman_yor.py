"""Language-model scores by a hierarchical Pitman-Yor model of words.

A word is a customer of its context's restaurant; the context is the word before, hashed into one of
``contexts`` restaurants, or the start of the text. The tables of all context restaurants are the
customers of one parent restaurant, whose base is uniform over the words of the training texts and
one more. The seating is sampled by Gibbs sweeps: in each one, every dish of every restaurant is
seated anew by the Chinese restaurant process, given the parent's probabilities and the tables of all
others from the sweep before. The predictive probabilities of the sweeps after ``burn_in`` are
averaged.

How it runs:

1. Each task cuts its texts into batches and counts (word, context, text). Counts go to buckets by
   word, packed. Words that are very common in a bounded sample are spread by context as well; the
   sample decides on balance only.
2. A bucket holds all of its words' dishes: sorted once and written to the shared folder.
3. A sweep is one pass over the dishes. Only the tables of each context (a bounded array), two sums
   and the common words' counts (bounded too) pass through the driver. No seating is written: each
   pass replays the sweeps before from their seeds and these recorded totals.
4. The last pass scores every (word, context) of a bucket and adds up by text; sums go back to the
   batches, packed.

All counts, the vocabulary and the seating cover all training texts.

Defined results: a null or empty text is one token, its end; a null id counts as an empty one where
texts are held out; repeated rows are texts of their own; an empty table gives an empty result; if
all texts are held out the model is uniform; other columns play no part, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemap.llm.common import bounded_sample, pieces, texts
from ripplemap.plans.session import stored

END = xxhash.xxh64_intdigest(b"\n")  # no word holds a line end
EXACT = 32  # up to so many customers of a dish, tables are drawn from their exact distribution
BATCH_BYTES, BATCH_ROWS = 8 << 20, 60_000
# Buckets that a task scores one after the other, and text sums that it holds at most.
TOGETHER, WAITING = 4, 1_500_000


@dataclass(frozen=True)
class Settings:
    contexts: int = 32_768
    discounts: tuple[float, float] = (0.6, 0.8)  # of the parent, of the contexts
    strengths: tuple[float, float] = (1.0, 1.0)
    burn_in: int = 1
    samples: int = 3
    seed: int = 5
    bucket_bytes: int = 10 << 20
    common_share: float = 0.002
    sample_rows: int = 2000
    held_out: tuple[int, int] = (10, 0)  # modulus and remainder of the id's checksum


@dataclass
class Totals:
    """What passes through the driver: sizes bounded by contexts and common words."""

    n_tokens: int = 0
    n_words: int = 0
    customers: np.ndarray | None = None  # of each context
    common: dict[int, int] = field(default_factory=dict)  # training count of each common word
    sweeps: list[Sweep] = field(default_factory=list)


@dataclass
class Sweep:
    """The state after a sweep."""

    tables: np.ndarray  # of each context
    parent_tables: int
    common: dict[int, tuple[int, int]]  # the parent's customers and tables of each common word


def pack(**arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def narrow(values: np.ndarray) -> np.ndarray:
    """The same counts in the smallest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


# Counting -------------------------------------------------------------------------------------


def is_held_out(keys: list, settings: Settings) -> np.ndarray:
    modulus, remainder = settings.held_out
    sums = (zlib.crc32(b"" if k is None else str(k).encode()) for k in keys)
    return np.array([s % modulus == remainder for s in sums], bool)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, each text's end after it; its text; the word before (0:
    none)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    words = flat.dictionary_encode()
    hashes = np.fromiter(
        map(xxhash.xxh64_intdigest, words.dictionary.cast(pa.binary()).to_pylist()),
        np.uint64,
        len(words.dictionary),
    )
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    text, word = text[real], hashes[words.indices.to_numpy()[real]]
    ends = np.cumsum(np.bincount(text, minlength=len(texts)))
    word = np.insert(word, ends, np.uint64(END))
    text = np.insert(text, ends, np.arange(len(texts)))
    last = np.concatenate([[0], word[:-1]]).astype(np.uint64)
    last[np.concatenate([[True], text[1:] != text[:-1]])[: len(last)]] = 0
    return word, text, last


def context_of(before: np.ndarray, contexts: int) -> np.ndarray:
    """Place 0 is the start of a text."""
    return np.where(before == 0, 0, 1 + before % np.uint64(contexts - 1)).astype(np.int64)


def bucket_of(word: np.ndarray, context: np.ndarray, common: np.ndarray, buckets: int) -> np.ndarray:
    spread = np.where(np.isin(word, common), context, 0).astype(np.uint64)
    mixed = (word >> np.uint64(20)) + spread * np.uint64(0x9E3779B1)
    return (mixed % np.uint64(buckets)).astype(np.int64)


def count_task(batches, settings: Settings, common: np.ndarray, buckets: int):
    """Rows ``bucket``, ``batch`` and a packed list of (word, context, text, times)."""
    number = itertools.count()
    for large in pieces(batches, BATCH_BYTES):
        for start in range(0, large.num_rows, BATCH_ROWS):
            own = large.slice(start, BATCH_ROWS)
            batch = TaskContext.get().partitionId() << 32 | next(number)
            keys = own.column("key")
            held = is_held_out(keys.to_pylist(), settings)
            word, text, last = tokens(own.column("text").fill_null(""))
            known, word = np.unique(word, return_inverse=True)
            # One number holds word, context and text, so that one plain sort brings them together.
            entry = np.uint64(1 << 16) * context_of(last, settings.contexts).astype(np.uint64)
            entry += word.astype(np.uint64) << np.uint64(32)
            entry, times = np.unique(entry + text.astype(np.uint64), return_counts=True)
            word = known[(entry >> np.uint64(32)).astype(np.int64)]
            context = (entry >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)
            text = (entry & np.uint64(0xFFFF)).astype(np.int64)
            bucket = bucket_of(word, context, common, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            rows = []
            for places in np.split(order, cuts[1:]):
                words, runs = np.unique(word[places], return_counts=True)
                ends = text[places[word[places] == END]]
                ids = keys.take(pa.array(ends))
                blob = pack(
                    words=words, runs=narrow(runs), context=context[places].astype(np.uint16),
                    text=text[places].astype(np.uint16), times=narrow(times[places]),
                    held=np.packbits(held), ends=ends.astype(np.uint16),
                    ids=ids.fill_null(0).to_numpy(), null=np.packbits(ids.is_null().to_numpy(False)),
                )
                rows.append((int(bucket[places[0]]), batch, blob))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))]
            yield pa.record_batch(columns, names=["bucket", "batch", "blob"])


def gather(settings: Settings, key: tuple, group: pa.Table) -> pa.Table:
    """One bucket: its dishes, and the texts in which each appears."""
    group = group.sort_by("batch")
    parts = [unpack(b) for b in group.column("blob").to_pylist()]
    words = np.unique(np.concatenate([p["words"] for p in parts]))
    place = np.concatenate([np.repeat(np.searchsorted(words, p["words"]), p["runs"]) for p in parts])
    context = np.concatenate([p["context"] for p in parts]).astype(np.int64)
    pair, where = np.unique(place << 16 | context, return_inverse=True)
    text = np.concatenate([p["text"] for p in parts])
    times = np.concatenate([p["times"].astype(np.int64) for p in parts])
    sizes = [len(p["text"]) for p in parts]
    held = np.concatenate(
        [np.unpackbits(p["held"])[p["text"]].astype(bool) for p in parts]
    )
    count = np.bincount(where[~held], times[~held], len(pair)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    dishes = pack(words=words, word=narrow(np.diff(pair >> 16, prepend=0)),
                  context=(pair & 0xFFFF).astype(np.uint16), count=narrow(count))
    uses = pack(
        runs=narrow(np.bincount(where, minlength=len(pair))),
        part=narrow(np.repeat(np.arange(len(parts)), sizes)[order]),
        text=text[order], times=narrow(times[order]),
        batches=group.column("batch").to_numpy(),
        n_ends=np.array([len(p["ends"]) for p in parts]),
        ends=np.concatenate([p["ends"] for p in parts]),
        ids=np.concatenate([p["ids"] for p in parts]),
        null=np.concatenate([np.unpackbits(p["null"], count=len(p["ids"])) for p in parts]),
    )
    return pa.table(
        {"bucket": pa.array([key[0].as_py()], pa.int32()), "dishes": [dishes], "uses": [uses]}
    )


# Seating --------------------------------------------------------------------------------------


def log_stirling(most: int, discount: float) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers: ways to seat n customers at t tables."""
    table = np.full((most + 1, most + 2), -np.inf)
    table[0, 0] = 0.0
    for n in range(most):
        t = np.arange(1, n + 2)
        stay = table[n, t] + np.log(np.maximum(n - discount * t, 1e-300))
        table[n + 1, t] = np.logaddexp(table[n, t - 1], stay)
    return table


def seat(count: np.ndarray, new: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables of dishes with ``count`` customers, where a new table has the weight ``new``.

    Up to ``EXACT`` customers their number has the exact conditional distribution. The customers of
    larger dishes are seated one after the other, in blocks that grow with those seated.
    """
    tables = np.minimum(count, 1)
    ways = log_stirling(EXACT, discount)
    for n in range(2, EXACT + 1):
        own = np.flatnonzero(count == n)
        if len(own):
            t = np.arange(1, n + 1)
            logit = ways[n, t] + np.log(new[own, None]) * t
            logit += rng.gumbel(size=logit.shape)
            tables[own] = 1 + logit.argmax(axis=1)
    own = np.flatnonzero(count > EXACT)
    seated = 1
    while len(own):
        block = np.minimum(max(1, seated // EXACT), count[own] - seated)
        weight = new[own]
        share = weight / (weight + seated - discount * tables[own])
        tables[own] += rng.binomial(block, share)
        seated += max(1, seated // EXACT)
        own = own[count[own] > seated]
    return tables


class Bucket:
    """The dishes of a bucket, and the replay of the sweeps over them."""

    def __init__(self, number: int, blob: bytes, settings: Settings, totals: Totals):
        data = unpack(blob)
        self.number, self.settings, self.totals = number, settings, totals
        self.words = data["words"]
        self.word = np.cumsum(data["word"].astype(np.int64))
        self.context = data["context"].astype(np.int64)
        self.count = data["count"].astype(np.int64)
        self.tables = np.minimum(self.count, 1)
        self._parents(None)

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, values, len(self.words)).astype(np.int64)

    def _parents(self, sweep: int | None) -> None:
        """The parent's customers and tables of each word, after a sweep or at the start."""
        self.parent = self.by_word(self.tables)
        if sweep is None:
            self.parent_tables = np.minimum(self.parent, 1)
        else:
            s, t = self.settings, self.totals
            tables = t.sweeps[sweep].parent_tables
            new = (s.strengths[0] + s.discounts[0] * tables) / (t.n_words + 1)
            rng = np.random.default_rng([s.seed, sweep, self.number, 1])
            weight = np.full(len(self.words), new)
            self.parent_tables = seat(self.parent, weight, s.discounts[0], rng)

    def common_places(self) -> list[tuple[int, int]]:
        if not self.totals.common or not len(self.words):
            return []
        common = np.array(sorted(self.totals.common), np.uint64)
        return [(int(p), int(self.words[p])) for p in np.flatnonzero(np.isin(self.words, common))]

    def word_probability(self, sweep: int) -> np.ndarray:
        """The parent's predictive probability of each word."""
        s, t = self.settings, self.totals
        state = t.sweeps[sweep]
        customers, tables = self.parent.copy(), self.parent_tables.copy()
        for place, word in self.common_places():
            customers[place], tables[place] = state.common.get(word, (0, 0))
        base = (s.strengths[0] + s.discounts[0] * state.parent_tables) / (t.n_words + 1)
        seats = s.strengths[0] + int(state.tables.sum())
        return (customers - s.discounts[0] * tables + base) / seats

    def sweep(self, sweep: int) -> None:
        """Seat every dish anew, given the totals recorded after sweep ``sweep``."""
        s = self.settings
        new = s.strengths[1] + s.discounts[1] * self.totals.sweeps[sweep].tables
        weight = new[self.context] * self.word_probability(sweep)[self.word]
        rng = np.random.default_rng([s.seed, sweep, self.number, 0])
        self.tables = seat(self.count, weight, s.discounts[1], rng)
        self._parents(sweep)

    def probability(self, sweep: int) -> np.ndarray:
        """Predictive probability of each dish in its context."""
        s, t = self.settings, self.totals
        up = self.word_probability(sweep)[self.word]
        own = t.sweeps[sweep].tables[self.context]
        new = (s.strengths[1] + s.discounts[1] * own) * up
        seats = s.strengths[1] + t.customers[self.context]
        return (self.count - s.discounts[1] * self.tables + new) / seats


def statistics(batches, settings: Settings, totals: Totals) -> Iterator[pa.RecordBatch]:
    """Rows ``kind``, ``key``, ``value``: what the recorded totals are the sums of."""
    for batch in batches:
        for number, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "dishes")), strict=True):
            b = Bucket(number, blob, settings, totals)
            for sweep in range(len(totals.sweeps)):
                b.sweep(sweep)
            common = b.common_places()
            split = np.zeros(len(b.words), bool)
            split[[p for p, _ in common]] = True
            seen = b.by_word(b.count)
            rows = [("words", 0, int(((seen > 0) & ~split).sum()))]
            rows.append(("parent_tables", 0, int(b.parent_tables[~split].sum())))
            rows += [("common_count", np.uint64(w).astype(np.int64), int(seen[p])) for p, w in common]
            rows += [("common_parent", np.uint64(w).astype(np.int64), int(b.parent[p])) for p, w in common]
            for kind, values in (("customers", b.count), ("tables", b.tables)):
                by_context = np.bincount(b.context, values, settings.contexts).astype(np.int64)
                used = np.flatnonzero(by_context)
                rows += zip(itertools.repeat(kind), used.tolist(), by_context[used].tolist())
            columns = zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))
            columns = [pa.array(c, k) for c, k in columns]
            yield pa.record_batch(columns, names=["kind", "key", "value"])


def record(state: DataFrame, settings: Settings, totals: Totals) -> None:
    """One sweep as a Spark job (none yet: the start); its totals are added to ``totals``."""
    shared = state.sparkSession.sparkContext.broadcast(totals)
    rows = state.select("bucket", "dishes").mapInArrow(
        lambda batches: statistics(batches, settings, shared.value),
        "kind string, key long, value long",
    )
    found: dict[str, dict[int, int]] = {}
    # At most two rows a context, two a common word, and two more.
    for r in rows.groupBy("kind", "key").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["kind"], {})[r["key"]] = r["value"]

    def by_context(kind: str) -> np.ndarray:
        out = np.zeros(settings.contexts, np.int64)
        for k, v in found.get(kind, {}).items():
            out[k] = v
        return out

    def unsigned(kind: str) -> dict[int, int]:
        return {k & (1 << 64) - 1: v for k, v in found.get(kind, {}).items()}

    first = not totals.sweeps
    if first:
        counts = unsigned("common_count")
        totals.common = {w: counts.get(w, 0) for w in totals.common}
        totals.customers = by_context("customers")
        totals.n_tokens = int(totals.customers.sum())
        known = sum(n > 0 for n in totals.common.values())
        totals.n_words = found.get("words", {}).get(0, 0) + known
    parents = unsigned("common_parent")
    words = sorted(totals.common)
    customers = np.array([parents.get(w, 0) for w in words], np.int64)
    if first:
        tables = np.minimum(customers, 1)
    else:
        s = settings
        new = s.strengths[0] + s.discounts[0] * totals.sweeps[-1].parent_tables
        rng = np.random.default_rng([s.seed, len(totals.sweeps), 2])
        weight = np.full(len(words), new / (totals.n_words + 1))
        tables = seat(customers, weight, s.discounts[0], rng)
    common = dict(zip(words, zip(customers.tolist(), tables.tolist(), strict=True), strict=True))
    parent_tables = found.get("parent_tables", {}).get(0, 0) + int(tables.sum())
    totals.sweeps.append(Sweep(by_context("tables"), parent_tables, common))


# Scores ---------------------------------------------------------------------------------------


def _text_sums(b: Bucket, u: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """For each batch, the sums of those of its texts that use the bucket."""
    settings, totals = b.settings, b.totals
    mean = np.zeros(len(b.count))
    for sweep in range(len(totals.sweeps)):
        # The state recorded as number ``sweep`` is what the bucket holds at this point.
        if sweep >= settings.burn_in:
            mean += b.probability(sweep)
        if sweep + 1 < len(totals.sweeps):
            b.sweep(sweep)
    score = np.log10(mean / (len(totals.sweeps) - settings.burn_in))
    seen = b.by_word(b.count)
    for place, word in b.common_places():
        seen[place] = totals.common[word]
    base = np.log10((seen + 0.1) / (totals.n_tokens + 0.1 * (totals.n_words + 1)))
    pair = np.repeat(np.arange(len(b.count)), u["runs"])
    times, word = u["times"].astype(np.int64), b.word[pair]
    # Texts of all batches side by side.
    texts, where = np.unique(u["part"].astype(np.int64) << 16 | u["text"], return_inverse=True)
    sums = {
        "n": np.bincount(where, times),
        "known": np.bincount(where, times * (seen[word] > 0)),
        "base": np.bincount(where, times * base[word]),
        "score": np.bincount(where, times * score[pair]),
    }
    part, ends = texts >> 16, np.cumsum(u["n_ends"])
    for k, name in enumerate(u["batches"].tolist()):
        own = slice(*np.searchsorted(part, [k, k + 1]))
        end = slice(int(ends[k] - u["n_ends"][k]), int(ends[k]))
        found = {"text": texts[own] & 0xFFFF, **{c: v[own] for c, v in sums.items()}}
        yield name, found | {c: u[c][end] for c in ("ends", "ids", "null")}


def _added(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums of one batch from several buckets, one entry a text."""
    whole = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    texts, where = np.unique(whole["text"], return_inverse=True)
    sums = {c: np.bincount(where, whole[c]) for c in ("n", "known", "base", "score")}
    return whole | {"text": texts} | sums


def score_task(batches, settings: Settings, totals: Totals) -> Iterator[pa.RecordBatch]:
    """Rows ``batch`` and packed sums by text, added up over the buckets of a task."""
    waiting: dict[int, list[dict[str, np.ndarray]]] = {}
    entries = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for name, parts in waiting.items():
            s = _added(parts)
            packed = pack(
                text=s["text"].astype(np.uint16), n=narrow(s["n"]), known=narrow(s["known"]),
                base=s["base"], score=s["score"].astype(np.float32),
                ends=s["ends"], ids=s["ids"], null=s["null"],
            )
            yield pa.record_batch([pa.array([name]), pa.array([packed])], names=["batch", "sums"])
        waiting.clear()

    for batch in batches:
        for row in range(batch.num_rows):
            number, dishes, uses = (batch.column(c)[row].as_py() for c in ("bucket", "dishes", "uses"))
            for name, found in _text_sums(Bucket(number, dishes, settings, totals), unpack(uses)):
                waiting.setdefault(name, []).append(found)
                entries += len(found["text"])
            if entries > WAITING:
                yield from flush()
                entries = 0
    yield from flush()


def finish(settings: Settings, totals: Totals, group: pa.Table) -> pa.Table:
    """The texts of one batch, their sums added up in a fixed order."""
    parts = [unpack(b) for b in sorted(group.column("sums").to_pylist())]
    text = np.concatenate([p["text"] for p in parts]).astype(np.int64)
    size = int(text.max()) + 1
    out = {c: np.bincount(text, np.concatenate([p[c] for p in parts]), size) for c in ("n", "known", "base", "score")}
    ends = np.concatenate([p["ends"] for p in parts]).astype(np.int64)
    ids = pa.array(
        np.concatenate([p["ids"] for p in parts]),
        mask=np.concatenate([p["null"] for p in parts]).astype(bool),
    )
    return pa.table(
        {
            "key": ids,
            "held_out": is_held_out(ids.to_pylist(), settings),
            "n_tokens": out["n"][ends].astype(np.int64),
            "n_known": out["known"][ends].astype(np.int64),
            "train_tokens": np.full(len(ends), totals.n_tokens),
            "base_score": out["base"][ends],
            "score": out["score"][ends],
        }
    )


def common_words(docs: DataFrame, settings: Settings) -> np.ndarray:
    """Hashes of the words, ends included, of at least ``common_share`` of a bounded sample."""
    rows = bounded_sample(docs, settings.sample_rows).collect()
    counts: Counter = Counter()
    for r in rows:
        counts.update((r["text"] or "").encode().lower().split())
    least = settings.common_share * (counts.total() + len(rows))
    words = [xxhash.xxh64_intdigest(w) for w, n in counts.items() if n >= least]
    return np.array(sorted({*words, END}), np.uint64)


def scores(
    docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score`` (log10 probability of the text) of every row."""
    own = texts(docs, key, text)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / settings.bucket_bytes))
    common = common_words(own, settings)
    counted = own.mapInArrow(
        lambda batches: count_task(batches, settings, common, buckets),
        "bucket int, batch long, blob binary",
    )
    state = counted.groupBy("bucket").applyInArrow(
        lambda k, group: gather(settings, k, group), "bucket int, dishes binary, uses binary"
    )
    state = stored(state, "dishes")
    totals = Totals(common=dict.fromkeys(common.tolist(), 0))
    for _ in range(settings.burn_in + settings.samples):
        record(state, settings, totals)
    shared = own.sparkSession.sparkContext.broadcast(totals)
    sums = state.coalesce(math.ceil(buckets / TOGETHER)).mapInArrow(
        lambda batches: score_task(batches, settings, shared.value), "batch long, sums binary"
    )
    return sums.groupBy("batch").applyInArrow(
        lambda group: finish(settings, shared.value, group),
        "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity a token by ``held_out``."""
    each = F.sum("score") / F.sum("n_tokens")
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -each).alias("perplexity"))
