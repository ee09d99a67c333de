"""Least absolute error: against a dense reference, and what makes it robust."""

import numpy as np
import pytest

from conftest import frame
from sigspan.operators import model as mdl
from sigspan.operators import robust as rb


def _brute(x, y, rounds=rb.ROUNDS):
    scale = y.max() if y.max() else 1.0
    z, t = np.column_stack([np.ones(len(x)), x]), y / scale
    beta = np.zeros(z.shape[1])
    for r in range(rounds):
        w = np.ones(len(t)) if r == 0 else 1 / np.sqrt((t - z @ beta) ** 2 + rb.DELTA**2)
        beta = np.linalg.solve((z * w[:, None]).T @ z + rb.RIDGE * np.eye(z.shape[1]), (z * w[:, None]).T @ t)
    return beta, scale


def _data(n=120, outliers=0):
    r = np.random.default_rng(6)
    x = r.normal(size=(n, 3))
    y = 4 + x @ np.array([1.0, -2.0, 0.5]) + 0.01 * r.normal(size=n)
    y[:outliers] += 50
    return x, y


def test_equals_the_dense_rounds_in_any_partitioning(spark):
    x, y = _data(outliers=10)
    rows = [(a.tolist(), float(b)) for a, b in zip(x, y)] + [([0.0, 0.0, 0.0], None)]
    df = frame(spark, rows, "features array<double>, label double")
    beta, scale = _brute(x, y)
    for parts in (1, 7, 200):
        fit = rb.fit_absolute(df.repartition(parts), 3)
        assert fit.beta == pytest.approx(beta, abs=1e-10) and fit.scale == scale
    got = {tuple(r.features): r.prediction for r in fit.transform(df).collect()}
    for a in x:
        assert got[tuple(a)] == pytest.approx(scale * (beta[0] + a @ beta[1:]), abs=1e-9)


def test_outliers_do_not_pull_it(spark):
    x, y = _data(outliers=15)
    df = frame(spark, [(a.tolist(), float(b)) for a, b in zip(x, y)], "features array<double>, label double")
    fit = mdl.fit_regressor(df, "absolute")
    least_squares = mdl.fit_regressor(df, "linear")
    clean = np.abs(4 + x[15:] @ np.array([1.0, -2.0, 0.5]) - y[15:]).mean()
    error = lambda m: np.mean([abs(r.prediction - r.label) for r in mdl.predict(m, df).collect() if r.label < 30])
    assert error(fit) < clean + 0.5 < error(least_squares)


def test_small_and_flat_inputs(spark):
    schema = "features array<double>, label double"
    assert rb.fit_absolute(frame(spark, [], schema), 2) == rb.AbsoluteFit((0.0, 0.0, 0.0), 1.0)
    flat = rb.fit_absolute(frame(spark, [([1.0, 2.0], 0.0), ([2.0, 4.0], 0.0)], schema), 2)
    assert flat.scale == 1.0 and max(abs(b) for b in flat.beta) < 1e-12
    few = rb.fit_absolute(frame(spark, [([1.0, 2.0, 3.0, 4.0], 5.0)], schema), 4)  # fewer rows than terms
    out = few.transform(frame(spark, [([1.0, 2.0, 3.0, 4.0], 0.0)], schema)).first()
    assert out.prediction == pytest.approx(5.0, abs=0.01)


def test_keys_of_a_union_of_sets_do_not_mix(spark):
    from sigspan.spec import SMOKE

    f = frame(spark, [(g, 0, [float(10 * g + k) for k in range(26)]) for g in (0, 1)], "set int, seg int, f array<double>")
    labels = frame(spark, [(0, 0, 1.5), (1, 0, None)], "set int, seg int, y double")
    got = {(r["set"], r["seg"]): (r.features[0], r.label) for r in mdl.training_set(f, labels, SMOKE, keys=["set", "seg"]).collect()}
    assert got == {(0, 0): (0.0, 1.5), (1, 0): (10.0, None)}
