"""Token files, shards, archives and chats: exact round trips and plain Python results."""

import base64
import hashlib
import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ripplemap.llm import chat, sharding, tokenfile, warc

WORD = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " \n", "J̌ ̈x", "<|endoftext|> a <|ENDOFTEXT|>", "It's 3.5, ok.. ΣΑΣ.", "日本 ok."]


def texts(n=300, seed=1):
    rnd = random.Random(seed)
    words = "the Of in, er. on's é ß 12 x_y | Ünd ti\x0cb".split(" ")
    made = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(60))) for _ in range(n)]
    return [*ODD, *made, "long text, " * 20_000]


def test_token_files(docs):
    rows = [(3 * i, t, "s") for i, t in enumerate(texts())] + [(None, "no id", "s"), (9, "again", "s")]
    manifest = tokenfile.write(docs(rows).repartition(5), WORD, end=2, rows_per_file=64)
    assert manifest.count() >= 4
    tokens = Tokenizer.from_file(WORD)
    want = []
    for key, text, _ in rows:
        ids = [*tokens.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((-1 if key is None else key, ids))
    got = tokenfile.read(manifest).collect()
    order = sorted(got, key=lambda r: r.start)
    keys = [-1 if r.key is None else r.key for r in order]
    assert keys == sorted(keys)
    start = 0
    for r in order:
        assert r.start == start
        start += r.n_tokens
    have = sorted((-1 if r.key is None else r.key, r.n_tokens, r.crc) for r in got)
    assert have == sorted((k, len(i), zlib.crc32(np.array(i, "<u4"))) for k, i in want)
    # One document alone, through the index.
    file = tokenfile.TokenFile(manifest.orderBy("part").first()["file"])
    by_key = dict(want)
    place = len(file.index) // 2
    assert file.document(place).tolist() == by_key[int(file.index["key"][place])]


@pytest.mark.parametrize("hot", [5, None])
def test_a_key_with_a_third_of_all_rows_is_cut(docs, hot):
    rows = [(hot, "the same text", "s")] * 200 + [(hot, f"text {i}", "s") for i in range(100)]
    rows += [(100 + i, f"other {i} " * (i % 9), "s") for i in range(300)]
    table = docs(rows).repartition(4)
    manifest = tokenfile.write(table, WORD, end=2, rows_per_file=50)
    sizes = [r["documents"] for r in manifest.collect()]
    assert sum(sizes) == 600 and max(sizes) <= 120
    got = tokenfile.read(manifest).collect()
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order[:-1])]).tolist()
    keys = [-1 if r.key is None else r.key for r in order]
    assert keys == sorted(keys) and keys.count(-1 if hot is None else hot) == 300
    placed = sharding.shards(table, 24, rows_per_range=50).collect()
    assert len(placed) == 600
    by_shard = {}
    for r in placed:
        by_shard.setdefault(r.shard, []).append(r)
    target = sum(r.size for r in placed) / 24
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - target) <= max(r.size for r in placed)


def test_token_file_dictionary_is_checked(docs, tmp_path):
    rows = [(i, t, "s") for i, t in enumerate(texts(400))]
    folder = str(tmp_path / "tok")
    tokenfile.write(docs(rows).coalesce(1), WORD, end=2, folder=folder)
    path = next((tmp_path / "tok").iterdir())
    raw = bytearray(path.read_bytes())
    assert tokenfile.HEAD.unpack(raw[: tokenfile.HEAD.size])[1] > 0  # a dictionary was trained
    raw[tokenfile.HEAD.size + 5] ^= 1
    path.write_bytes(raw)
    with pytest.raises(ValueError):
        tokenfile.TokenFile(str(path))
    empty = tokenfile.write(docs(rows).limit(0), WORD, end=2)
    assert tokenfile.read(empty).count() == 0


@pytest.mark.parametrize("per_range", [7, 1000])
def test_shards(docs, per_range):
    rnd = random.Random(2)
    rows = [(rnd.randrange(-500, 500), "é" * rnd.randrange(50), "s") for _ in range(400)]
    rows += [(None, "x", "s"), (None, None, "s"), (7, "", "s"), rows[0], rows[0]]
    got = sharding.shards(docs(rows).repartition(3), 24, rows_per_range=per_range).collect()
    size = lambda t: len((t or "").encode()) + 8
    want = sorted((-(2**63) if k is None else k, zlib.crc32((t or "").encode()), size(t)) for k, t, _ in rows)
    total, at, shards, slots = sum(w[2] for w in want), 0, [], {}
    for k, crc, n in want:
        middle = at + n - n // 2
        shard = sum(total * s // 24 <= middle for s in range(1, 24))
        shards.append((k, crc, n, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        at += n
    assert sorted(shards) == sorted((-(2**63) if r.key is None else r.key, r.crc, r.size, r.shard, r.slot) for r in got)
    totals = [sum(x[2] for x in shards if x[3] == s) for s in range(24)]
    assert max(totals) - min(totals) <= 2 * max(x[2] for x in shards)
    assert sharding.shards(docs(rows).limit(0), 24).count() == 0
    assert {r.shard for r in sharding.shards(docs(rows[:1]), 24).collect()} <= set(range(24))


@pytest.mark.parametrize("least", [0, 3])
def test_archives(spark, least):
    rnd = random.Random(3)
    bodies = [None, "", "é", "same", "x" * 9000, "<p>\r\n\r\nWARC/1.1\r\n</p>"]
    rows = [(i, rnd.choice(["http://a/ b", None, "u\r\nWARC-Type: x"]), rnd.choice(bodies)) for i in range(80)]
    rows += [(None, "u", "same"), (None, "u", "lonely"), (5, "u", "same")]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, n int, digest string")
    manifest = warc.write(pages.repartition(3), least_bytes=least, frame_bytes=4000)
    got = warc.read(manifest).collect()
    first = {}
    for k, _, b in rows:
        if k is not None:
            first[b or ""] = min(k, first.get(b or "", k))
    want = []
    for k, _, b in rows:
        raw = (b or "").encode()
        smallest = first.get(b or "")
        revisit = len(raw) >= least and smallest is not None and k != smallest
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((str(k), len(raw), digest, "revisit" if revisit else "response", smallest if revisit else None))
    have = [(str(r.key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or len(r.payload) == r.payload_bytes
    file = manifest.first()["file"]
    reader = warc.Reader(file)
    assert len(reader.sizes) > 1
    for e in reader.index:
        if not e["null"]:
            assert int(e["id"]) in {int(f["WARC-Record-ID"].strip("<>").rpartition(":")[2]) for f, _ in reader.find(int(e["id"]))}
    # Any Zstandard reader unpacks a bundle as one stream of records.
    raw = open(file, "rb").read()
    stream = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert len(list(warc.parse(stream))) == len(reader.index)
    assert warc.read(warc.write(pages.limit(0))).count() == 0


LOG = "conversation long, message long, sequence long, kind string, role string, text string, place int"


def test_fold_and_render(spark):
    says = "</s>[INST] \\ \\l <|turn|>\\\\< ok [/INST]\n"
    rows = [
        (1, 0, 0, "open", "user", None), (1, 0, 1, "delta", None, "he"), (1, 0, 2, "delta", None, says),
        (1, 0, 2, "delta", None, says),  # delivered twice
        (1, 1, 3, "open", "assistant", None), (1, 1, 4, "delta", None, "draft"),
        (1, 1, 5, "regenerate", None, None), (1, 1, 6, "delta", None, "new "), (1, 1, 7, "delta", None, "one"),
        (1, 0, 8, "edit", None, "edited " + says), (1, 0, 9, "delta", None, "!"), (1, 0, 10, "what", None, "?"),
        (2, 5, 0, "delta", None, None), (3, 1, 4, "edit", None, "x"), (3, 1, 2, "open", "ro\n<le", "ignored"),
        (None, None, 1, "open", "assistant", None),
    ]
    log = spark.createDataFrame([(*r, 0) for r in rows], LOG)
    folded = {(r.conversation, r.role, r.text) for r in chat.fold(log).collect()}
    assert folded == {
        (1, "user", f"edited {says}!"), (1, "assistant", "new one"), (2, "", ""), (3, "ro\n<le", "x"),
        (None, "assistant", ""),
    }
    template = chat.Template()
    segments = chat.render(chat.fold(log))
    for r in segments.collect():
        inner = r.segment.removeprefix(template.start).removesuffix(template.end)
        assert not any(c in inner for c in template.controls)
    back = {(r.conversation, r.role, r.text) for r in chat.parse(segments).collect()}
    assert back == folded
    got = {r.conversation: r for r in chat.digests(chat.parse(segments)).collect()}
    one = f"user\nedited {says}!\nassistant\nnew one\n"
    assert (got[1].turns, got[1].turns_sha256) == (2, hashlib.sha256(one.encode()).hexdigest())
    assert (got[1].loss_chars, got[1].loss_sha256) == (7, hashlib.sha256(b"new one").hexdigest())
    assert chat.digests(chat.parse(chat.render(chat.fold(log.limit(0))))).count() == 0


def test_escapes_round_trip(spark):
    rnd = random.Random(6)
    alphabet = ["\\", "<", "[", "a", "b", "\n", "|", "é", "</s>"]
    made = [("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(12))),) for _ in range(2000)]
    escapes = chat.Template().escapes("\n")
    table = spark.createDataFrame(made, "t string")
    back = chat.unescaped(chat.escaped(F.col("t"), escapes), escapes)
    assert table.where(back != F.col("t")).count() == 0


def test_hot_conversation_is_streamed(spark):
    log = spark.range(6000).select(
        F.lit(1).cast("long").alias("conversation"), F.col("id").alias("message"), F.col("id").alias("sequence"),
        F.lit("edit").alias("kind"), F.lit(None).cast("string").alias("role"), F.col("id").cast("string").alias("text"),
    )
    row = chat.digests(chat.parse(chat.render(chat.fold(log.repartition(6))))).first()
    want = "".join(f"\n{i}\n" for i in range(6000))
    assert SimpleNamespace(**row.asDict()).turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
