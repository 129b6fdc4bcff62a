"""The registered queries over whole tables: against SQL where there is some, else plain Python."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from check import duck, duck_rows, spark_rows
from plain import base, held, measures, slow_components, slow_fingerprint, words_of
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from ripplemap.llm import decontam, queries as registered

SMALL = "/root/testdata/sf0.001"
SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
DOCS = {r["doc_id"]: r for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rows(spark, name):
    return [r.asDict() for r in queries()[name](spark, SMALL).collect()]


def test_all_and_the_pipeline_are_registered():
    names = set(queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert "pipeline" in names and set(oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_matches_sql(spark, name):
    assert spark_rows(queries()[name](spark, SMALL)) == duck_rows(duck(SMALL), oracle_sql()[name])


def leaks(texts):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    own = {k: decontam.words_of(t.encode()) for k, t in texts.items()}
    found = set()
    for item, text in items:
        words = decontam.words_of(text.encode())
        bag = Counter(words)
        for k, passage in own.items():
            if len(words) < 8 or (Counter(passage) & bag).total() < 0.8 * len(words):
                continue
            row = [0] * (len(passage) + 1)
            for i, w in enumerate(words, 1):
                new = [i]
                for j, v in enumerate(passage, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
                row = new
            if min(row) <= int(0.2 * len(words)):
                found.add((k, item))
    return found


def test_op1(spark):
    got = {(r["doc_id"], r["item_id"]) for r in rows(spark, "op1_benchmark_decontamination")}
    assert got == leaks({k: r["text"] for k, r in DOCS.items()})


def test_op3(spark):
    tokens, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r["doc_id"]: r for r in rows(spark, "op3_token_files")}
    for k in sorted(DOCS):
        ids = [*tokens.encode(DOCS[k]["text"], add_special_tokens=False).ids, 2]
        r = got.pop(k)
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4"))
        start += len(ids)
    assert not got


def test_op4(spark):
    fps = {k: slow_fingerprint(r["text"]) for k, r in sorted(DOCS.items())}
    label = slow_components(list(fps.values()), 3)
    ids = list(fps)
    want = {(k, f"{fps[k]:016x}", ids[g]) for k, g in zip(ids, label)}
    got = rows(spark, "op4_simhash_near_dedup")
    assert want == {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got}


def test_op5(spark):
    got = {r["doc_id"]: r for r in rows(spark, "op5_sharding")}
    assert got.keys() == DOCS.keys() and all(r["law"] == "bytes" for r in got.values())
    places = [(got[k]["shard"], got[k]["slot"]) for k in sorted(got)]
    assert places == sorted(places)
    assert all(r["size"] == len(DOCS[k]["text"].encode()) + 8 for k, r in got.items())
    assert all(r["text_crc32"] == zlib.crc32(DOCS[k]["text"].encode()) for k, r in got.items())


def test_op6(spark):
    counts = Counter(w for k, r in DOCS.items() if not held(k) for w in words_of(r["text"]))
    for r in rows(spark, "op6_lm_scores"):
        words = words_of(DOCS[r["doc_id"]]["text"])
        known = sum(counts[w] > 0 for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), known, counts.total())


def test_op7(spark):
    pages = {r["page_id"]: r["html"].encode() for r in pq.read_table(f"{SMALL}/pages.parquet").to_pylist()}
    first = {}
    for k, body in sorted(pages.items()):
        first.setdefault(body, k)
    got = {r["page_id"]: r for r in rows(spark, "op7_warc")}
    assert got.keys() == pages.keys()
    for k, body in pages.items():
        again = first[body] != k
        assert got[k]["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (got[k]["record_type"], got[k]["payload_bytes"]) == ("revisit" if again else "response", len(body))
        assert got[k]["refers_to"] == (first[body] if again else None)


def test_op9(spark):
    for r in rows(spark, "op9_secret_scans"):
        want = base(DOCS[r["doc_id"]]["text"])
        named = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == sha(named)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in want) for k in range(3)]
        assert set(filter(None, named.split(","))) <= set(r["spans"].split(","))


def test_op10(spark):
    for r in rows(spark, "op10_sentencepiece"):
        ids = SP.encode(DOCS[r["doc_id"]]["text"], add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(SP.decode(ids))


def test_pipeline(spark):
    got = {r["doc_id"]: r for r in rows(spark, "pipeline")}
    left = {}
    for k, r in sorted(DOCS.items()):
        n, _, _, _, repeated = measures(r["text"])
        if n >= 10 and 100 * repeated <= 20 * n:
            left[k] = r["text"]
    ids = list(left)
    label = slow_components([slow_fingerprint(t) for t in left.values()], 3)
    left = {k: left[k] for k in {ids[g] for g in label}}
    left = {k: t for k, t in left.items() if k not in {d for d, _ in leaks(left)}}
    assert got.keys() == left.keys()
    for k, text in left.items():
        out, at = "", 0
        for start, _, end in base(text):
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        ids = SP.encode(out + text[at:], add_eos=True)
        assert (got[k]["ids"], got[k]["decoded"]) == (ids, SP.decode(ids))


def test_stages_keep_columns_and_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key int, found string"
    odd = [(1, None), (1, None), (None, ""), (2, "word " * 100_000), (3, "a b c d e f g h i j k l")] * 2
    table = spark.createDataFrame([(*r, None, None, None, 1, "x") for r in odd], schema)
    for docs in (table, table.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, SMALL)
            made.collect()
            assert name == corpus_pipeline.STAGES[-1][0] or made.columns == docs.columns


def test_the_secret_stage_keeps_columns_of_any_name(spark):
    key = hashlib.sha256(b"k").hexdigest()
    rows = [(1, f"see {key} there", "f1", "m1", 7, True), (2, "nothing", "f2", None, None, False), (3, None, None, "m3", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, masked string, n_chars long, some boolean")
    made = corpus_pipeline.secret_scans(spark, docs, SMALL)
    assert made.columns == docs.columns
    assert sorted(map(tuple, made.collect())) == [
        (1, "see [SECRET] there", "f1", "m1", 18, True), (2, "nothing", "f2", None, None, False),
        (3, None, None, "m3", 1, None),
    ]
