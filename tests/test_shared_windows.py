"""Window spectra from shared slices against the transform of each whole window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspan.operators import shared_windows as sw
from sigspan.operators import slices as sl
from sigspan.operators import spectral as sp
from sigspan.spec import LONG, TEST


def _dct(x):
    n = len(x)
    z = np.fft.fft(np.concatenate([x, np.zeros(n)]))[:n] * np.exp(-0.5j * np.pi * np.arange(n) / n)
    return z.real * np.sqrt(np.where(np.arange(n) == 0, 1, 2) / n)


@pytest.mark.parametrize("sizes,win,keep", [([5, 6, 6, 6], 3, 17), ([4, 4, 4], 1, 4), ([1, 1, 1], 3, 3), ([7, 0, 9, 3], 2, 7), ([100, 101, 101, 101, 90, 101], 3, 292)])
def test_equals_the_whole_window(sizes, win, keep):
    r = np.random.default_rng(3)
    slices = [r.normal(size=n) + 4 for n in sizes]
    got = sw.window_coefficients(slices, win, keep)
    assert len(got) == len(sizes) - win + 1
    for j, c in enumerate(got):
        assert np.allclose(c, _dct(np.concatenate(slices[j : j + win]))[:keep], atol=1e-10)


def test_each_slice_is_transformed_once_for_a_length(monkeypatch):
    calls = []
    plain = sw.partial_sums
    monkeypatch.setattr(sw, "partial_sums", lambda x, n, k: calls.append(n) or plain(x, n, k))
    sw.window_coefficients([np.ones(10)] * 10, 3, 5)
    assert len(calls) == 10  # not 24
    calls.clear()
    sw.window_coefficients([np.ones(9)] + [np.ones(10)] * 9, 3, 5)
    assert len(calls) == 12


@pytest.mark.parametrize("boundary", ["inclusive", "strict"])
def test_equals_window_spectra(spark, boundary):
    spec = TEST.with_(boundary=boundary)
    # a gap inside segment 1, and two sets with the same segment numbers
    seq = spark.range(6000).select((F.col("id") % 2).alias("set"), F.expr("id div 2000").alias("seg"), F.expr("cast(id % 2000 div 2 + 1 as int)").alias("no"), F.sin(F.col("id") * 0.37).alias("x"))
    seq = seq.where("not (seg = 1 and no between 205 and 230)")
    slices = sl.segment_slices(seq, spec, keys=["set", "seg"])
    want = {(r.set, r.seg, r.win): r.vx for r in sp.dct(sl.sliding_windows(slices, spec, keys=["set", "seg"]), "vx", keep=spec.win_dct_keep).collect()}
    got = {(r.set, r.seg, r.win): r.c for r in sw.shared_window_spectra(slices, spec, keys=["set", "seg"]).collect()}
    assert set(got) == set(want) and len(got) == 6 * 8
    assert all(np.allclose(got[k], want[k], atol=1e-10) for k in want)


def test_long_windows_and_failures(spark):
    x = np.cumsum(np.random.default_rng(5).normal(size=LONG.length))
    slices = [x[max(i * LONG.slice_len - 1, 0) : (i + 1) * LONG.slice_len] for i in range(LONG.n_slices)]
    df = spark.createDataFrame([(7, [s.tolist() for s in slices])], "seg long, slices array<array<double>>")
    got = sorted(sw.shared_window_spectra(df, LONG).collect(), key=lambda r: r.win)
    for r in got:
        want = _dct(np.concatenate(slices[r.win : r.win + 3]))[: LONG.win_dct_keep]
        assert np.allclose(r.c, want, atol=1e-9 * np.abs(want).max())
    assert sw.shared_window_spectra(df.limit(0), LONG).count() == 0
    with pytest.raises(Exception, match="slices, not"):
        sw.shared_window_spectra(df.select("seg", F.slice("slices", 1, 9).alias("slices")), LONG).collect()
    with pytest.raises(ValueError, match="shorter"):
        sw.window_coefficients([np.ones(3)] * 3, 3, 10)


def test_null_samples(spark):
    rows = [(1, [[1.0] * 100] * 4 + [[None] + [1.0] * 99] + [[1.0] * 100] * 5)]
    got = sw.shared_window_spectra(spark.createDataFrame(rows, "seg long, slices array<array<double>>"), TEST).collect()
    assert {r.win for r in got if np.isnan(r.c).any()} == {2, 3, 4}
