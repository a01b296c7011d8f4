"""Phrases against counting every phrase of every piece."""

import collections
import random
import re

import numpy as np
import pytest

from tests.llm.helpers import awkward, awkward_rows, empty
from urbanloom.llm import collocations as C

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(FOLD)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for k in range(len(words) - size + 1):
                    f[lang][tuple(words[k : k + size])] += 1
    out = {}
    for lang, counts in f.items():
        frequent = {p: c for p, c in counts.items() if c >= least}
        found = []
        for p, a in frequent.items():
            inside = any(len(q) > len(p) and c >= a and any(q[k : k + len(p)] == p for k in range(len(q))) for q, c in frequent.items())
            if len(p) < 2 or inside:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out |= {(lang, rank): (p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)}
    return out


def found(frame):
    rows = frame.collect()
    out = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows}
    assert len(out) == len(rows)
    return out


def sentences(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "city", "light", "rail", "new", "york", "É", "x-1"] + [f"w{k}" for k in range(12)]
    weights = [1 / (k + 1) for k in range(len(words))]
    texts = []
    for k in range(n):
        w = rng.choices(words, weights, k=rng.randrange(0, 60))
        for i in range(len(w)):
            if rng.random() < 0.12:
                w[i] += rng.choice([".", ",", ";", "\n", "!", "?", ":", "\r", "\t"])
        texts.append((" ".join(w) + ("new york city hall of fame" if k % 3 == 0 else ""), rng.choice(["en", "en", "en", "de", None, "und"])))
    return texts


@pytest.mark.parametrize(("constants", "least"), [({}, 5), ({"HOT": 20, "TOKENS_PER_BUCKET": 300, "TOKENS_PER_FLUSH": 200, "SLICE": 7, "COUNTED": 5}, 5), ({"HOT": 50, "TOKENS_PER_BUCKET": 1000}, 40)])
def test_phrases(spark, monkeypatch, constants, least):
    for name, value in constants.items():
        monkeypatch.setattr(C, name, value)
    rows = sentences(1, 300)
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    expect = brute(rows, least)
    assert len(expect) > 30
    assert found(C.collocations(frame, least=least)) == expect
    assert found(C.collocations(frame, least=least, top=7)) == brute(rows, least, top=7)


def test_awkward_rows(spark):
    rows = [(r[1], r[2]) for r in awkward_rows()]
    assert found(C.collocations(awkward(spark), least=2)) == brute(rows, 2)
    assert C.collocations(empty(spark)).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), ("", "en"), (" ,. ", "en")], "text string, lang string")).count() == 0


def test_scores_beyond_64_bits(spark):
    text = "b c " * 6000
    rows = [(text, "en")] * 30
    assert 1000 * 180_000 * 360_000 * 180_000 > 2**63
    assert found(C.collocations(spark.createDataFrame(rows, "text string, lang string"))) == brute(rows, 100)


def test_fragments_survive_packing():
    ids = np.random.default_rng(3).integers(-1, 9, 4000).astype(np.int32)
    rows, weights, hashes = C.combined(C.cut_fragments(ids, 5), np.ones(len(C.cut_fragments(ids, 5)), np.int64))
    again, w = C.unpacked(C.packed(rows, weights), 5)
    assert (again == rows).all() and (w == weights).all() and w.sum() == len(C.cut_fragments(ids, 5))
    assert len(np.unique(rows, axis=0)) == len(rows) and len(hashes) == len(rows)
