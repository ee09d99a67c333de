"""Whitening against exact fractions and a plain numpy covariance."""

from fractions import Fraction

import numpy as np
import pytest

from sigspan.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, component string, n string, whitened string, x string, k0 string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "c", "n", "w", "x", "k") for i, v in rows], SCHEMA)
    return wh.whiten(df, **kw).collect()


def brute(rows, components=4):
    """Fractions throughout: {place: (n, deviation, values by component)}, eigenvalues, covariance."""
    usable = [(p, [int(np.floor(256 * np.float64(c))) for c in v]) for p, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v)]
    fit_list = sorted({tuple(x) for _, x in usable})
    n, d = len(fit_list), len(fit_list[0])
    S = [sum(x[i] for x in fit_list) for i in range(d)]
    y = [[x[i] - Fraction(S[i], n) for i in range(d)] for x in fit_list]
    V = np.array([[float(sum(a[i] * a[j] for a in y) / n) for j in range(d)] for i in range(d)])
    e, w = np.linalg.eigh(V)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    out = {p: (n, sum((n * x[i] - S[i]) ** 2 for i in range(d)), (np.array([float(x[i] - Fraction(S[i], n)) for i in range(d)]) @ w) / np.sqrt(e)) for p, x in usable}
    return out, e / np.trace(V), V


def made(seed, n, d):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) * np.linspace(2, 0.2, d) + r.normal(size=d)).tolist()


def test_against_fractions(spark):
    vectors = made(1, 60, 7)
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(100 + i, vectors[0]) for i in range(40)]  # copies count once
    rows += [(7, vectors[3]), (None, vectors[5]), (200, None), (201, []), (202, [1.0, None] + [0.0] * 5), (203, [float("nan")] * 7), (204, [float("inf")] * 7), (205, [0.0] * 7)]
    want, explained, V = brute(rows)
    got = run(spark, rows)
    assert len(got) == 4 * len(want)
    by = {}
    for g in got:
        by.setdefault(g.vec_id, []).append(g)
    for p, (n, deviation, z) in want.items():
        mine = [g for g in by[rows[p][0]]]
        assert {g.n for g in mine} == {n} and deviation in {int(g.deviation) for g in mine}
        for c in range(4):
            values = [abs(g.whitened) for g in mine if g.component == c + 1]
            assert min(abs(v - abs(z[c])) for v in values) < 1e-9
    assert {g.component for g in got} == {1, 2, 3, 4}
    for g in got:
        assert abs(g.explained - explained[g.component - 1]) < 1e-12 and 0 <= g.identity_error < 1e-9
    assert sorted(g.whitened for g in got if g.vec_id == 0) == sorted(g.whitened for g in got if g.vec_id == 100)


def test_polarisation_equals_products_exactly(spark):
    """Squares of sums give the cross covariances to the last bit, for numbers past 2^53 too."""
    r = np.random.default_rng(3)
    x = r.integers(-(1 << 40), 1 << 40, (30, 5)) + (1 << 41)
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x array<bigint>").distinct()
    n, S = wh.totals(df)[5]
    centre = {5: np.array([s // n for s in S], np.int64)}
    v, trace = wh.polarised(n, [s % n for s in S], wh.squares(df, centre)[5])
    y = [[int(a) - Fraction(S[i], n) for i, a in enumerate(row)] for row in x.tolist()]
    for i in range(5):
        for j in range(5):
            assert v[i, j] == float(sum(a[i] * a[j] for a in y) / n)
    assert trace == float(sum(a[i] ** 2 for a in y for i in range(5)) / n)


def test_values_that_no_long_holds(spark):
    rows = [(0, [1e30, 0.5]), (1, [-1e30, 0.25]), (2, [3.0, 1e12])]
    got = run(spark, rows)
    assert len(got) == 6 and all(np.isfinite(g.whitened) and g.identity_error < 1e-4 for g in got)


def test_few_dimensions_no_variance_and_lengths_apart(spark):
    assert run(spark, []) == []
    one = run(spark, [(1, [0.5, 0.25])])
    assert [(g.component, g.n, int(g.deviation), g.whitened, g.explained, g.identity_error) for g in one] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    line = [(i, [i / 8, i / 4, -i / 8, 1.0, 2.0]) for i in range(9)]  # one live direction
    got = run(spark, line)
    assert {g.component for g in got} == {1, 2, 3, 4}
    assert all(g.whitened == 0 and g.explained == 0 for g in got if g.component > 1)
    assert all(abs(g.explained - 1) < 1e-12 and g.identity_error < 1e-9 for g in got if g.component == 1)
    both = run(spark, [*line, *[(50 + i, v) for i, v in enumerate(made(5, 20, 3))]])
    assert {(g.vec_id >= 50, g.n) for g in both} == {(False, 9), (True, 20)}
    assert sorted((g.vec_id, g.component, g.whitened) for g in both if g.vec_id < 50) == sorted((g.vec_id, g.component, g.whitened) for g in got)


def test_kept_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, v, "c", "n", "w", str(i), "k") for i, v in enumerate(made(2, 12, 4))], SCHEMA)
    out = wh.whiten(df.withColumnRenamed("x", "k1"), keep=["k1", "k0"])
    assert out.columns[-2:] == ["k1", "k0"] and all(r["k1"] == str(r["vec_id"]) and r["k0"] == "k" for r in out.collect())


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_on_its_whole_table(spark, sf):
    import pyarrow.parquet as pq

    from sigspan.llm.queries import QUERIES

    table = pq.read_table(f"/root/testdata/sf{sf}/embeddings.parquet").to_pydict()
    x = np.floor(256 * np.array(table["embedding"], np.float64)).astype(np.int64)
    fit_list = np.unique(x, axis=0)
    n, S = len(fit_list), fit_list.sum(0)
    V = np.cov(fit_list.T, bias=True)
    e, w = np.linalg.eigh(V)
    z = ((x - S / n) @ w[:, ::-1][:, :4]) / np.sqrt(e[::-1][:4])
    dev = ((n * x - S) ** 2).sum(1)
    rows = QUERIES["op13_whitening"](spark, f"/root/testdata/sf{sf}").collect()
    assert len(rows) == 4 * len(x)
    signs = np.zeros(4)
    for r in rows:
        k = r.component - 1
        assert r.n == n and r.deviation == dev[r.vec_id] and abs(abs(r.whitened) - abs(z[r.vec_id, k])) < 1e-6
        signs[k] += np.sign(r.whitened * z[r.vec_id, k])
        assert r.identity_error < 1e-4 and abs(r.explained - e[::-1][k] / np.trace(V)) < 1e-9
    assert (np.abs(signs) > 0.99 * len(x)).all()
