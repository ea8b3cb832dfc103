"""Whitening against exact fractions and numpy, on awkward vectors."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from ledgerloom.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string, packed string"


def brute(rows):
    """vec_id -> (n, deviation), with the exact covariance, by plain fractions."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fits = [list(x) for x in {tuple(x) for _, x in good}]
    n, sums = len(fits), [sum(c) for c in zip(*fits, strict=True)]
    deviation = sorted((i is None, i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for i, x in good)
    centred = [[Fraction(n * c - s, n) for c, s in zip(x, sums, strict=True)] for x in fits]
    d = len(sums)
    v = [[sum(x[i] * x[j] for x in centred) / n for j in range(d)] for i in range(d)]
    return good, n, sums, deviation, v


def check(rows, got):
    good, n, sums, deviation, v = brute(rows)
    v = np.array([[float(c) for c in r] for r in v])
    values, columns = np.linalg.eigh(v)
    values, columns = values[::-1], columns[:, ::-1]
    k = min(16, sum(values > 1e-11 * values[0]))
    assert len(got) == k * len(good)
    first = [r for r in got if r.component == 1]
    assert sorted((r.vec_id is None, r.vec_id, r.deviation) for r in first) == deviation
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-9)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    by_id = {i: x for i, x in good}
    for c in range(1, k + 1):
        mine = {r.vec_id: r.whitened for r in got if r.component == c}
        want = {i: float((np.array(x) - mean) @ columns[:, c - 1]) / math.sqrt(values[c - 1]) for i, x in by_id.items()}
        sign = 1 if sum(mine[i] * want[i] for i in want) >= 0 else -1
        for i in want:
            assert mine[i] == pytest.approx(sign * want[i], abs=1e-6)


def vectors(n, d, seed):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d)) * np.linspace(1, 0.1, d)[:, None]
    return [[float(c) for c in np.float32(v)] for v in 0.2 * r.normal(size=(n, d)) @ mix]


def test_equals_exact_fractions(spark, tmp_path):
    rows = list(enumerate(vectors(120, 20, 1)))
    rows += [(500 + k, rows[0][1]) for k in range(300)]  # a frequent vector counts once
    rows += [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (903, rows[1][1][:-1] + [float("inf")]), (3, rows[3][1]), (904, [])]
    rows += [(905, [40.0, -90.5, *rows[4][1][2:]])]  # entries of other sizes
    data = [(i, v, 1, "x", "y") for i, v in rows]
    spark.createDataFrame(data, SCHEMA).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.queries()["op11_polarised_whitening"](spark, str(tmp_path)).collect()
    check([(i, v) for i, v in rows if i != 904], got)


def test_few_dimensions_and_constant_ones(spark):
    rows = [(k, [a, 0.5, b]) for k, (a, b) in enumerate(vectors(50, 2, 2))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(rows, whitening.whiten(df).collect())


def test_widths_are_fitted_apart(spark):
    narrow, wide = list(enumerate(vectors(30, 3, 3))), [(100 + k, v) for k, v in enumerate(vectors(40, 5, 4))]
    got = whitening.whiten(spark.createDataFrame(narrow + wide, "vec_id long, embedding array<float>")).collect()
    check(narrow, [r for r in got if r.vec_id < 100])
    check(wide, [r for r in got if r.vec_id >= 100])


def test_large_entries_stay_exact(spark):
    rows = [(k, [c * 1e9 for c in v]) for k, v in enumerate(vectors(30, 4, 5))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good, n, sums, deviation, _ = brute(rows)
    got = {r.vec_id: r.deviation for r in whitening.whiten(df).where("component = 1").collect()}
    assert got == {i: d if d < 2**63 else None for _, i, d in deviation}
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(far).count() == 3  # the second direction has next to no variance


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == []
    one = spark.createDataFrame([(1, [0.5, 0.25], 1, "", ""), (2, [0.5, 0.25], 1, "", ""), (3, [], 1, "", "")], SCHEMA)
    assert whitening.whiten(one).collect() == []
