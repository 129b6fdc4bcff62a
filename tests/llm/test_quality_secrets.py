"""Quality rules and secret scans against plain Python, with the edge cases of their docstrings."""

import hashlib
import random

from pyspark.sql import functions as F
from plain import base, measures

from ripplemap.llm import quality, secrets


def rows_of(n=60):
    rnd = random.Random(4)
    texts = [None, "", " \t\n", "a b c d e " * 30, "x " * 4000, "é\x0bß ü\n\né\x0bß ü", "# $ <>" * 9]
    for _ in range(n):
        words = [rnd.choice("ab c\n de é <f # g".split(" ")) for _ in range(rnd.randrange(60))]
        texts.append(rnd.choice([" ", "  ", "\t"]).join(words))
    return [(i, t, None if i % 5 == 0 else f"h{i % 3}") for i, t in enumerate(texts)]


def test_measures_and_rules(docs):
    rows = rows_of()
    got = quality.judge(docs([*rows, rows[8]]), keep=["doc_id"]).collect()
    assert len(got) == len(rows) + 1
    text = {r[0]: r[1] for r in rows}
    for r in got:
        want = measures(text[r.row.doc_id])
        assert want == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept <= (not r.base_failed)


def test_bad_host_is_rejected_and_small_hosts_are_shrunk(docs):
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(i, good, "good") for i in range(50)]
    rows += [(100 + i, "short" if i < 48 else good, "bad") for i in range(50)]
    rows += [(200, "short", "small"), (201, good, None)]
    judged = quality.judge(docs(rows), keep=["doc_id"])
    kept = {r.row.doc_id for r in judged.where("kept").collect()}
    assert kept == set(range(50)) | {201}
    rates = {r.host: r for r in quality.host_rates(judged, quality.Limits()).collect()}
    assert rates["bad"].rejected and rates["bad"].bound_short > 0.8
    assert 0.05 < rates["small"].rate_short < 1 and rates[None].rate_short > 0
    # Hosts with one rate among them: no variance, all shrunk to it.
    same = quality.judge(docs([(1, good, "a"), (2, good, "b")]), keep=["doc_id"])
    assert same.where("kept").count() == 2


def test_each_rule_finds_its_hosts_and_chance_rejects_none(docs):
    rnd = random.Random(9)
    plain = lambda: " ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 9) + str(rnd.random())[:6] for _ in range(14))
    bad = {
        "short": lambda: "too short",
        "repeats": lambda: "all of this is said again " * 9,
        "symbols": lambda: plain().replace("0", "#$|") + " $$$ ### |||" * 3,
        "lines": lambda: "\n".join([plain(), "menu"] * 9),
    }
    rows, planted = [], set()
    for h in range(300):
        host = f"h{h}"
        rule = list(bad)[h // 10] if h < 40 else None
        if rule:
            planted.add(host)
        for _ in range(40 if rule else rnd.choice([1, 2, 3, 30])):
            fails = rnd.random() < (0.9 if rule else 0.06)
            rows.append((len(rows), (bad[rule or rnd.choice(list(bad))] if fails else plain)(), host))
    judged = quality.judge(docs(rows), keep=["doc_id"])
    hosts = {r.host: r for r in quality.host_rates(judged, quality.Limits()).collect()}
    assert {h for h, r in hosts.items() if r.rejected} == planted
    for h in planted:
        rule = list(bad)[int(h[1:]) // 10]
        assert getattr(hosts[h], f"bound_{rule}") > 0.4
    kept = {r.row.doc_id for r in judged.where("kept").collect()}
    failed = {r.row.doc_id for r in judged.where("base_failed").collect()}
    assert kept == {k for k, _, h in rows if h not in planted} - failed


def test_quality_keeps_columns_and_empty_tables(docs):
    table = docs(rows_of())
    assert quality.passing(table).columns == table.columns
    assert quality.passing(table.limit(0)).count() == 0


def test_base_spans(docs):
    rnd = random.Random(9)
    bits = ["token", "api_key", "ApiKey", "SECRET", "=", ":", " ", "  ", "'", '"', "abcdef0123", "é",
            "", "", "AKIA", "ABCDEFGH12", "0123456789abcdef", "pass", "password", "\n"]
    texts = [None, "", "secret=token: abcdefgh", "token=" + "x" * 50_000, "token: abcdef " * 200]
    texts += ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    table = docs([(i, t, "s") for i, t in enumerate(texts)])
    model = [0.0] * len(secrets.CHARACTERS) ** 2
    got = table.select("doc_id", secrets.spans(table.text, model).alias("f")).collect()
    for r in got:
        assert [tuple(s) for s in r.f] == base(texts[r.doc_id])


def test_models_tell_random_strings_from_identifiers(docs, spark):
    rnd = random.Random(1)
    names = ["get", "user", "by", "account", "number", "parse", "record", "list", "value", "index", "page"]
    word = lambda: "_".join(rnd.choice(names) for _ in range(6))
    key = lambda: "".join(rnd.choice(secrets.CHARACTERS[:62]) for _ in range(32))
    samples = [("random", key()) for _ in range(300)] + [("identifier", word()) for _ in range(300)]
    samples += [("random", None), ("identifier", ""), ("random", "é?"), ("identifier", "x")]
    model = secrets.train(spark.createDataFrame(samples, "label string, string string"))
    held_out = [(i, f"see {key()} here") for i in range(100)]
    held_out += [(100 + i, f"see {word()} here") for i in range(100)]
    table = docs(held_out, "doc_id long, text string")
    found = table.select("doc_id", secrets.listed(secrets.spans(table.text, model)).alias("s"))
    hits = {r.doc_id: r.s for r in found.collect()}
    assert sum(hits[i] == "markov:4:36" for i in range(100)) >= 98
    assert not any(hits[100 + i] for i in range(100))


def test_redaction_and_training_from_documents(docs):
    key = hashlib.sha256(b"x").hexdigest()
    rows = [(1, f"a token='{key}' and {key} é", "s"), (2, None, "s"), (3, "plain words", "s")]
    table = docs(rows)
    model = secrets.model_of(table)
    assert len(model) == len(secrets.CHARACTERS) ** 2
    found = secrets.spans(table.text, model)
    got = table.select("doc_id", F.struct("text", found.alias("f")).alias("x")).select(
        "doc_id", secrets.redacted(F.col("x.text"), F.col("x.f")).alias("t")
    )
    got = {r.doc_id: r.t for r in got.collect()}
    assert got == {1: "a [SECRET]' and [SECRET] é", 2: None, 3: "plain words"}
    assert set(secrets.model_of(table.limit(0))) == {0.0}


def test_added_spans_in_documents(docs):
    """Recall and false alarms of planted keys that no fixed pattern finds; secrets are rare."""
    rnd = random.Random(12)
    vowels, others = "aeiou", "bcdfghlmnprst"
    word = lambda: "".join(rnd.choice(others) + rnd.choice(vowels) for _ in range(rnd.randrange(2, 7)))
    name = lambda: "_".join(word() for _ in range(5))
    key = lambda: "".join(rnd.choice(secrets.CHARACTERS[:62]) for _ in range(36))
    rows, planted, named = [], {}, set()
    for i in range(3000):
        words = [word() for _ in range(40)]
        if i % 10 == 0:
            words[7] = f"token={key()}"
        elif i % 10 == 1:
            words[9] = key()
            planted[i] = sum(len(w) + 1 for w in words[:9])
        elif i % 10 == 2:
            words[9] = name()
            named.add(i)
        rows.append((i, " ".join(words), "s"))
    table = docs(rows)
    model = secrets.model_of(table, scan=secrets.Scan(sample_rows=500))
    found = table.select("doc_id", secrets.listed(secrets.spans(table.text, model)).alias("s"))
    hits = {r.doc_id: r.s for r in found.collect()}
    right = sum(hits[i] == f"markov:{at}:{at + 36}" for i, at in planted.items())
    assert right >= 0.95 * len(planted)
    wrong = [i for i, s in hits.items() if "markov" in s and i not in planted]
    assert len(wrong) <= 3 and sum(i in named for i in wrong) <= 1
