"""The blocked transform against the whole one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspan.operators import blocked as bl
from sigspan.operators import spectral as sp


def _dct(x):
    """Orthonormal DCT-II by one long FFT."""
    n = len(x)
    z = np.fft.fft(np.concatenate([x, np.zeros(n)]))[:n] * np.exp(-0.5j * np.pi * np.arange(n) / n)
    return z.real * np.sqrt(np.where(np.arange(n) == 0, 1, 2) / n)


@pytest.mark.parametrize("length,columns,keep", [(12, 3, 12), (12, 12, 12), (12, 1, 12), (36, None, 36), (35, 5, 20), (97, None, 97), (600, None, 7), (600, 20, 599), (1000, 8, 1000)])
def test_equals_the_whole_transform(spark, length, columns, keep):
    r = np.random.default_rng(length)
    x = {0: r.normal(size=length), 5: r.normal(size=length) + 3}
    rows = [(g, i + 1, float(v)) for g, xs in x.items() for i, v in enumerate(xs)]
    seq = spark.createDataFrame(rows, "seg long, no int, x double").repartition(3)
    got = {}
    for t in bl.blocked_spectrum(seq, length, keep, columns=columns).collect():
        assert (t.seg, t.k) not in got
        got[t.seg, t.k] = t.c
    assert set(got) == {(g, k) for g in x for k in range(keep)}
    for g, xs in x.items():
        assert np.allclose([got[g, k] for k in range(keep)], _dct(xs)[:keep], atol=1e-10)


def test_equals_the_row_transform_with_keys(spark):
    df = spark.range(480).select((F.col("id") % 2).alias("grp"), F.expr("id div 240").alias("seg"), F.expr("cast((id % 240) div 2 + 1 as int)").alias("no"), F.sin("id").alias("x"))
    vec = df.groupBy("grp", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "x"))), lambda e: e["x"]).alias("vx"))
    want = {(r.grp, r.seg): r.vx for r in sp.dct(vec, "vx").collect()}
    got = bl.blocked_spectrum(df, 120, 50, keys=["grp", "seg"]).collect()
    assert len(got) == 4 * 50 and all(abs(r.c - want[r.grp, r.seg][r.k]) < 1e-10 for r in got)


def test_incomplete_and_overlong_segments(spark):
    rows = [(0, i, 1.0) for i in range(1, 37)] + [(1, i, 1.0) for i in range(1, 37) if i != 20] + [(2, i, float(i)) for i in range(1, 50)]
    got = bl.blocked_spectrum(spark.createDataFrame(rows, "seg int, no int, x double"), 36, 10).collect()
    assert {r.seg for r in got} == {0, 2} and len(got) == 20
    assert max(abs(r.c) for r in got if r.seg == 0 and r.k) < 1e-12
    with pytest.raises(ValueError):
        bl.blocked_spectrum(spark.createDataFrame(rows, "seg int, no int, x double"), 36, 10, columns=5)


def test_a_million_samples(spark):
    length, keep = 10**6, 3000
    x = np.cumsum(np.random.default_rng(1).normal(size=length))
    seq = spark.createDataFrame(__import__("pandas").DataFrame({"seg": 0, "no": np.arange(1, length + 1), "x": x}))
    out = bl.blocked_spectrum(seq, length, keep)
    got = {r.k: r.c for r in out.collect()}
    want = _dct(x)[:keep]
    assert np.allclose([got[k] for k in range(keep)], want, atol=1e-6 * np.abs(want).max())
    assert bl.columns_of(length) == 1000  # no row holds more than 1001 numbers
