"""Quality rules, secrets, mixing and toxicity against brute force, with awkward and empty tables."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, awkward, awkward_rows, empty
from urbanloom.llm import quality_rules, secret_scan, source_mix, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measure(text):
    text = text or ""
    words = WORD.findall(text)
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measurements(spark):
    extra = [(100, "x y\nx y\n\nx y", *[None] * 13), (101, "a b c d e f g h " * 3, *[None] * 13), (102, "## a | b *** <c>", *[None] * 13)]
    docs = awkward(spark).unionByName(spark.createDataFrame(extra, SCHEMA))
    got = quality_rules.apply_policy(quality_rules.ledger(docs)).collect()
    assert len(got) == docs.count()
    expected = collections.Counter((r[0], *measure(r[1])) for r in [*awkward_rows(), *extra])
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_ledger_policies_and_ablation(spark):
    frame = quality_rules.ledger(awkward(spark)).cache()
    strict = quality_rules.apply_policy(frame, "strict/2").where("kept").count()
    base = quality_rules.apply_policy(frame, "base/1").where("kept").count()
    assert strict <= base
    rows = {r.rule: r for r in quality_rules.ablation(frame, "base/1").collect()}
    bits = [r.failed_bits & quality_rules.BASE_MASK for r in frame.collect()]
    for name in ("short", "repeated_windows"):
        bit = quality_rules.BIT[name]
        assert rows[name].n_failed == sum(bool(b & bit) for b in bits)
        assert rows[name].n_only_this == sum(b == bit for b in bits)
    kept = quality_rules.keep_good(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.count() == strict
    assert quality_rules.keep_good(empty(spark)).count() == 0
    assert quality_rules.ablation(quality_rules.ledger(empty(spark))).first().n_failed == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


SECRETS = [
    "password=token: abcdefgh", "PassWord : 'hunter22' api_key=x1 apikey=\"longvalue9\"", "漢字😀 secret:aaaaaa AKIA" + "A" * 16 + "AKIA" + "B" * 15, "token==abc===", "ab" * 11 + "c", "ab" * 12 + "G" + "0" * 24,
    "passwd=" + "deadbeef" * 4, "ſecret=abcdefgh toKen=abcdefgh", "token=\u212aabcdef", "",
]


def test_secret_spans(spark):
    rows = [(k, t, *[None] * 13) for k, t in enumerate(SECRETS)]
    docs = spark.createDataFrame(rows, SCHEMA)
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    got = {r.doc_id: r.listed for r in secret_scan.find_secrets(docs).select("doc_id", secret_scan.span_list(base).alias("listed")).collect()}
    assert got == {k: base_spans(t) for k, t in enumerate(SECRETS)}


def test_secret_ownership_separates_examples(spark):
    issued = "ghp_" + "a1B2" * 6
    rows = [(k, f"use {issued} here", None, f"s{k}", *[None] * 11) for k in range(6)] + [(50, "use ghp_" + "zZ9x" * 6, None, "s0", *[None] * 11)]
    got = {r.doc_id: r for r in secret_scan.find_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(len(got[k].spans) == 0 and got[k].n_copied == 1 for k in range(6))
    assert [s.kind for s in got[50].spans] == ["issued"] and got[50].n_live == 1


def test_secret_of_one_owner_stays_live_in_many_documents(spark):
    held = {"a": "ghp_" + "q7W8" * 6, None: "ghp_" + "m3N4" * 6}
    rows = [(k, f"use {held[s]} here {k}", None, s, *[None] * 11) for k, s in enumerate(["a", None] * 12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert all([s.kind for s in r.spans] == ["issued"] and (r.n_live, r.n_copied) == (1, 0) for r in secret_scan.find_secrets(docs).collect())
    assert all("[secret]" in r.text and "ghp_" not in r.text for r in secret_scan.redact_secrets(docs).collect())


def test_secret_awkward_and_redaction(spark):
    docs = awkward(spark)
    assert secret_scan.find_secrets(docs).count() == docs.count()
    cleaned = secret_scan.redact_secrets(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    before = collections.Counter((r.doc_id, r.text) for r in docs.collect() if r.doc_id not in (9, 12))
    rows = cleaned.collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows if r.doc_id not in (9, 12)) == before
    assert [r.text for r in rows if r.doc_id == 12] == ["[secret]"]  # one run of hexadecimal digits
    (nine,) = [r.text for r in rows if r.doc_id == 9]
    assert nine.count("[secret]") == 3 and "AKIA" not in nine and base_spans(nine) == ""
    assert secret_scan.redact_secrets(empty(spark)).count() == 0 and secret_scan.find_secrets(empty(spark)).count() == 0


def water_levels(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    fixed, total = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not above:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in above}


def test_mix(spark):
    docs = awkward(spark)
    rows = source_mix.mix_sources(docs, rows_per_bucket=2).collect()
    sizes = collections.Counter()
    for r in awkward_rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    targets = water_levels(sizes)
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - int(targets[s])) <= 1 for s in sizes)
    assert len(rows) == docs.count()
    key = lambda rs: sorted((r.doc_id is None, r.doc_id or 0, r.size, r.taken) for r in rs)
    assert key(rows) == key(source_mix.mix_sources(docs.repartition(5), rows_per_bucket=2).collect())
    assert key(rows) == key(source_mix.mix_sources(docs, rows_per_bucket=1000).collect())
    assert source_mix.mix_sources(empty(spark)).count() == 0
    carried = source_mix.mix_sources(docs, carry=True)
    assert carried.select("row.*").columns == docs.columns and carried.count() == docs.count()


def test_mix_of_equal_and_empty_sources(spark):
    rows = [(k, "x " * n, None, s, *[None] * 11) for k, (s, n) in enumerate([("a", 10), ("b", 10), ("c", 0), ("d", 1)])]
    got = {r.source: r for r in source_mix.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {s: r.target for s, r in got.items()} == pytest.approx(water_levels({"a": 10, "b": 10, "c": 0, "d": 1}))


def test_toxicity_learns_and_locates(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(200)]
    docs, labels = [], []
    for k in range(700):
        sentences = [" ".join(rng.choice(vocabulary, 8)) for _ in range(rng.integers(1, 6))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            sentences[rng.integers(len(sentences))] += f" {rng.choice(['vile', 'nasty', 'scummy'])} fool"
        docs.append((k, ". ".join(sentences) + ".", *[None] * 13))
        labels.append((k, 0, toxic))
    table = spark.createDataFrame(docs, SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(table, marks).collect()
    truth = {k: t for k, _, t in labels}
    held = [r for r in rows if r.held_out]
    assert len(rows) == 700 and 90 < len(held) < 200
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    text = {d[0]: d[1] for d in docs}
    assert all("fool" in text[r.doc_id][r.worst_start : r.worst_end] for r in held if truth[r.doc_id])
    awk = toxicity.score_toxicity(awkward(spark), marks).collect()
    assert len(awk) == awkward(spark).count() and all(0 <= r.score <= 1 for r in awk)
    none = toxicity.score_toxicity(awkward(spark), marks.limit(0)).collect()
    assert len(none) == len(awk) and toxicity.score_toxicity(empty(spark), marks).count() == 0
