"""Whitening against the covariance's own eigenvectors, sums in whole numbers."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanloom.llm import whitening as Wh
from urbanloom.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, x long, whitened double, deviation string, part long"


def table(spark, vectors, parts=5):
    return spark.createDataFrame([(k, v, 1, 2, 0.5, "d", 3) for k, v in vectors], SCHEMA).repartition(parts)


def steps(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


def made(seed=1, n=700, d=9):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * np.geomspace(3, 1e-2, d) + 5
    vectors = [(k, [float(c) for c in v]) for k, v in enumerate(values)]
    return vectors + [(9000 + k, vectors[3][1]) for k in range(400)] + [(None, vectors[4][1]), (5, vectors[5][1])]


def test_against_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(Wh, "BLOCK_VALUES", 90)
    monkeypatch.setattr(Wh, "FAN", 2)
    vectors = made()
    odd = [(1, None), (2, []), (3, [None] * 9), (4, [float("nan")] + [0.0] * 8), (5, [float("inf")] + [0.0] * 8), (6, [0.0] * 8 + [None])]
    model, rows = Wh.whiten(table(spark, vectors + [o for o in odd if o[1] != []]))
    got = rows.collect()
    distinct = sorted({tuple(steps(v)) for _, v in vectors})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    assert (model.n, list(model.sums)) == (n, sums)
    centred = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in distinct], float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert np.allclose(model.eigenvalues, values[:4], rtol=1e-10)
    assert np.allclose(np.abs(model.components @ axes[:, :4]), np.eye(4), atol=1e-9)
    assert np.allclose(model.explained, values[:4] / values.sum(), rtol=1e-10) and model.identity_error < 1e-10
    expect = collections.Counter((k, sum((n * c - s) ** 2 for c, s in zip(steps(v), sums, strict=True))) for k, v in vectors)
    assert collections.Counter((r.vec_id, r.deviation) for r in got) == expect
    by_id = dict(vectors[:700])
    for r in got:
        if r.vec_id in by_id and r.vec_id != 5:
            x = (np.array(steps(by_id[r.vec_id])) - np.array(sums) / n) @ model.components.T / np.sqrt(model.eigenvalues)
            assert np.allclose(r.whitened, x, atol=1e-9)


def test_small_deviations_keep_their_digits():
    rng = np.random.default_rng(0)
    q1, q2 = np.linalg.qr(rng.normal(size=(12, 12)))[0], np.linalg.qr(rng.normal(size=(12, 12)))[0]
    sizes = np.geomspace(1, 1e-11, 12)
    r = np.linalg.qr(q1 * sizes @ q2, mode="r")
    turned, axes = Wh.orthogonal_columns(r)
    assert np.allclose(np.sort(np.linalg.norm(turned, axis=0))[::-1], sizes, rtol=1e-4)
    assert np.allclose(axes.T @ axes, np.eye(12), atol=1e-14) and np.allclose(r @ axes, turned, atol=1e-14)


@pytest.mark.parametrize("d", [1, 2, 3, 8])
def test_any_dimension(d):
    r = np.triu(np.random.default_rng(d).normal(size=(d, d)))
    turned, _ = Wh.orthogonal_columns(r)
    assert np.allclose(np.sort(np.linalg.norm(turned, axis=0)), np.sort(np.linalg.svd(r)[1]))


def test_few_components(spark):
    line = [(k, [k / 256, 2 * k / 256, 0.0, 1.0]) for k in range(20)]
    model, rows = Wh.whiten(table(spark, line))
    assert len(model.explained) == 1 and abs(model.explained[0] - 1) < 1e-12 and all(len(r.whitened) == 1 for r in rows.collect())
    same = [(k, [1.0, 2.0]) for k in range(7)]
    model, rows = Wh.whiten(table(spark, same))
    assert model.n == 1 and [(r.deviation, r.whitened) for r in rows.collect()] == [(0, [])] * 7
    assert Wh.whiten(table(spark, []))[1].count() == 0
    assert [r.whitened for r in Wh.whiten(table(spark, [(1, []), (2, None)]))[1].collect()] == [[]]
    with pytest.raises(Exception, match="different lengths"):
        Wh.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_deviations_beyond_64_bits_are_null(spark):
    model, rows = Wh.whiten(table(spark, [(k, [3e7 * k, -2e7 * k]) for k in range(40)]))
    got = {r.vec_id: r.deviation for r in rows.collect()}
    for k, d in got.items():
        exact = sum((model.n * c - s) ** 2 for c, s in zip(steps([3e7 * k, -2e7 * k]), model.sums, strict=True))
        assert d == (exact if exact < 2**63 else None)
    assert None in got.values()


def test_any_blocks_and_partitions_agree(spark):
    one, many = (Wh.fit_whitening(table(spark, made(2, 300, 5), p).select(Wh.whole_steps(F.col("embedding"), 256).alias("x")).distinct(), 4, Scratch(spark)) for p in (1, 7))
    assert np.allclose(one.components, many.components, atol=1e-10) and one.sums == many.sums
