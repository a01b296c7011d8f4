"""Very many matches of a text, and redaction over the pieces that it is cut into."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from urbanloom.llm import secret_scan


def test_running_values(spark):
    rows = [(n, [int(x) for x in random.Random(n).choices(range(50), k=n)]) for n in (0, 1, 2, 255, 256, 257, 1000, 3000)]
    frame = spark.createDataFrame(rows, "n int, v array<bigint>")
    got = frame.select("n", secret_scan.running(F.col("v"), lambda a, b: a + b, 0).alias("sums"), secret_scan.running(F.col("v"), F.greatest, 0).alias("most")).collect()
    values = dict(rows)
    for r in got:
        assert r.sums == [sum(values[r.n][:k]) for k in range(r.n)] and r.most == [max(values[r.n][:k], default=0) for k in range(r.n)]


def keys(n, seed=1):
    rng = random.Random(seed)
    return " é\n".join("".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(24, 40))) for _ in range(n))


def test_many_matches(spark):
    took = {}
    for n in (5_000, 20_000):
        text = keys(n)
        frame = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
        began = time.perf_counter()
        row = secret_scan.find_secrets(frame).first()
        took[n] = time.perf_counter() - began
        expect = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{24,}", text)]
        assert [(s.start, s.end) for s in row.spans] == expect and len(expect) == n
    assert took[20_000] < 20  # seconds; a walk that copied its spans took over a minute


def cleaned(text, spans, mark="[secret]"):
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + mark
        at = max(at, b)
    return out + text[at:]


@pytest.mark.parametrize("size", [7, 4096])
def test_redaction(spark, monkeypatch, size):
    monkeypatch.setattr(secret_scan, "PIECE", size)
    rng, rows = random.Random(3), []
    for k in range(40):
        text = "".join(rng.choice("aé漢\U0001f600 \n") for _ in range(rng.choice([0, 1, 6, 7, 8, 14, 50, 300])))
        spans = sorted(sorted(rng.choices(range(len(text) + 1), k=2)) for _ in range(rng.randrange(0, 6)))
        rows.append((k, text, [(a, b) for a, b in spans if a < b]))
    frame = spark.createDataFrame([(k, t, [(a, 0, b, "hex", "x") for a, b in s]) for k, t, s in rows], f"k long, text string, spans {secret_scan.SPAN}")
    got = {r.k: r.out for r in frame.select("k", secret_scan.redact(F.col("text"), F.col("spans")).alias("out")).collect()}
    assert got == {k: cleaned(t, s) for k, t, s in rows}


def test_long_texts_are_redacted_in_time(spark):
    text = keys(20_000)
    frame = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    began = time.perf_counter()
    out = secret_scan.redact_secrets(frame).first().text
    assert out == re.sub("[0-9a-f]{24,}", "[secret]", text) and time.perf_counter() - began < 30


def test_only_rows_with_candidates_are_decided(spark, monkeypatch):
    parts = []

    def kept(frame, cut=secret_scan.cut):
        out = cut(frame)
        parts.append(out.rdd.glom().map(len).collect())
        return out

    monkeypatch.setattr(secret_scan, "cut", kept)
    rows = [(k, "0f" * 15 if k % 50 == 0 else "nothing here", "a") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(20)
    got = {r.doc_id: r.text for r in secret_scan.redact_secrets(docs).collect()}
    assert got == {k: "[secret]" if k % 50 == 0 else text for k, text, _ in rows}
    assert [sum(p) for p in parts] == [8] and all(parts[0])  # no empty part for the rows without candidates
