"""Mergeable moment states and batches that can be written again."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import frame
from sigspan.operators import moments as mom
from sigspan.operators import scaler as sc
from sigspan.session import scratch_path
from sigspan.sources import sinks as sk


def _brute(v):
    v = np.array(v, float)
    d = v - v.mean()
    m2 = (d**2).mean()
    return v.mean(), v.std(ddof=1) if len(v) > 1 else None, (d**3).mean() / m2**1.5 if m2 else None, (d**4).mean() / m2**2 - 3 if m2 else None, v.max()


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_merged_states_equal_the_union(spark, shift):
    r = np.random.default_rng(2)
    rows = [(None if g == 3 else g, int(r.integers(7)), float(v) + shift) for g in range(4) for v in r.gamma(1 + g, size=80)]
    rows += [(9, 0, 5.0), (10, 1, 2.0), (10, 2, 2.0), (10, 2, 2.0), (11, 0, None), (9, 3, None)]
    df = frame(spark, rows, "g int, part int, v double")
    merged = mom.merge_states(mom.moment_state(df, ["g", "part"], "v"), ["g"])
    twice = mom.merge_states(mom.merge_states(mom.moment_state(df, ["g", "part"], "v").withColumn("half", F.col("part") % 2), ["g", "half"]), ["g"])
    for states in (merged, twice):
        got = {r.g: tuple(r)[1:] for r in mom.state_statistics(states, ["g"]).collect()}
        assert set(got) == {0, 1, 2, None, 9, 10, 11}
        for g, stats in got.items():
            own = [v for k, _, v in rows if k == g and v is not None]
            want = _brute(own) if own else (None,) * 5
            for a, b in zip(stats, want):
                assert (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9 if not shift else 1e-4, abs_tol=1e-9 if not shift else 1e-4), (g, stats, want)


def test_one_state_of_all_rows(spark):
    df = frame(spark, [(i % 3, float(i * i)) for i in range(50)], "p int, v double")
    whole = mom.state_statistics(mom.merge_states(mom.moment_state(df, ["p"], "v"), []), []).first()
    assert tuple(whole) == pytest.approx(_brute([i * i for i in range(50)]))


def test_scaler_refitted_from_states_of_batches(spark):
    r = np.random.default_rng(4)
    rows = [(i, i % 2, [float(x) for x in r.normal(size=3)] + [1.0] + ([float("nan")] if i == 5 else [float(i)])) for i in range(30)]
    df = frame(spark, rows, "i int, win int, vx array<double>")
    for by in ([], ["win"]):
        parts = [mom.scaler_state(df.where(F.col("i") % 4 == k), "vx", by) for k in range(4)]
        states = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
        got = mom.scaler_from_states(mom.merge_states(states, [*by, "k"]), by).collect()
        want = sc.fit_scaler(df, "vx", by).collect()
        key = lambda x: x["win"] if by else 0
        for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
            assert a["std"] == pytest.approx(b["std"], rel=1e-12)


def test_a_batch_written_again_replaces_itself_only(spark):
    path = scratch_path(spark, "batches")
    one = frame(spark, [(1, "a"), (2, "b")], "i int, s string")
    sk.write_batch(one, path, "x")
    sk.write_batch(frame(spark, [(3, "c")], "i int, s string"), path, 7, sort_by=["i"])
    sk.write_batch(one.where("i = 2"), path, "x")  # a rerun that sees fewer rows
    sk.write_batch(one.where("i = 2"), path, "x")
    back = sk.read_batches(spark, path, one.schema)
    assert sorted((r.i, r.s, r.batch) for r in back.collect()) == [(2, "b", "x"), (3, "c", "7")]
