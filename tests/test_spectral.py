import math

import pytest
from pyspark.sql import functions as F

from conftest import frame
from sigspan.functions.arrays import band, overlapped_bins, stride
from sigspan.operators import scaler as sc
from sigspan.operators import spectral as sp
from sigspan.spec import BinSpec


def test_dct_unit_impulse(spark):
    n = 8
    df = frame(spark, [(0, [1.0] + [0.0] * (n - 1))], "id long, vx array<double>")
    c = sp.dct(df, "vx").first().vx
    assert math.isclose(c[0], math.sqrt(1 / n))
    for k in range(1, n):
        assert math.isclose(c[k], math.sqrt(2 / n) * math.cos(math.pi / n * 0.5 * k), abs_tol=1e-12)


def test_dct_keeps_energy(spark):
    vals = [math.sin(i * 0.37) * (i % 5) for i in range(64)]
    df = frame(spark, [(0, vals)], "id long, vx array<double>")
    c = sp.dct(df, "vx").first().vx
    assert math.isclose(sum(v * v for v in vals), sum(v * v for v in c), rel_tol=1e-12)


def test_low_pass_fails_on_short_vector(spark):
    df = frame(spark, [(0, [1.0, 2.0])], "id long, vx array<double>")
    with pytest.raises(Exception):
        sp.dct(df, "vx", keep=5).collect()


def test_bins_divisor_and_band_stride(spark):
    df = frame(spark, [(0, [float(-i) for i in range(10)])], "id long, v array<double>")
    b = df.select(overlapped_bins("v", BinSpec(4, 2, 4, 2.0)).alias("f")).first().f
    assert b == [(0 + 1 + 2 + 3) / 2, (2 + 3 + 4 + 5) / 2, (4 + 5 + 6 + 7) / 2, (6 + 7 + 8 + 9) / 2]
    r = df.select(band("v", 2, 5).alias("b"), stride(band("v", 2, 5), 2).alias("s")).first()
    assert r.b == [-2.0, -3.0, -4.0, -5.0, -6.0] and r.s == [-2.0, -4.0, -6.0]


def test_scaler_constant_dimension_and_unit_std(spark):
    rows = [(i, [float(i), 3.0, float(i * i)]) for i in range(6)]
    df = frame(spark, rows, "id long, v array<double>")
    out = sc.standard_scale(df, "v", "z")
    zs = [r.z for r in out.orderBy("id").collect()]
    assert all(z[1] == 0.0 for z in zs)
    std = out.select(F.posexplode("z").alias("k", "z")).groupBy("k").agg(F.stddev_samp("z").alias("s"))
    s = {r.k: r.s for r in std.collect()}
    assert math.isclose(s[0], 1.0) and s[1] == 0.0 and math.isclose(s[2], 1.0)


def test_scaler_single_row_maps_to_zero(spark):
    df = frame(spark, [(0, [2.0, 5.0])], "id long, v array<double>")
    assert sc.standard_scale(df, "v").first().v == [0.0, 0.0]


def test_scaler_fitted_on_train_only(spark):
    rows = [(i, [float(i)]) for i in range(10)]
    df = frame(spark, rows, "id long, v array<double>")
    train = df.where("id < 5")
    s = math.sqrt(sum((i - 2) ** 2 for i in range(5)) / 4)
    out = {r.id: r.v[0] for r in sc.standard_scale(df, "v", fit_on=train).collect()}
    assert math.isclose(out[9], 9 / s)


def test_grouped_scaler(spark):
    rows = [(w, i, [float(i * (w + 1))]) for w in range(2) for i in range(4)]
    df = frame(spark, rows, "win int, id long, v array<double>")
    out = sc.standard_scale(df, "v", by=["win"], groups_bound=2)
    s = {(r.win, r.id): r.v[0] for r in out.collect()}
    assert math.isclose(s[(0, 3)], s[(1, 3)])


def test_lazy_pipeline_equals_ml_pipeline(spark):
    from conftest import SF001
    from sigspan.operators import sequence as sq
    from sigspan.operators import slices as sl
    from sigspan.sources.tables import read_signal
    from sigspan.spec import TEST

    seq = sq.sequence_signal(read_signal(spark, SF001), TEST)
    vec = sl.concat_slices(sl.segment_slices(seq, TEST))
    model = sp.fit_spectral_pipeline(sp.as_vector(vec), TEST)
    a = {r.seg: r.f for r in sp.apply_spectral_pipeline(model, sp.as_vector(vec), TEST).collect()}
    lazy = sp.spectral_bins(sp.spectrum_scaled(vec, TEST), "vx", TEST.bins, "f")
    b = {r.seg: r.f for r in lazy.collect()}
    assert a.keys() == b.keys() and len(a) == 10
    for k in a:
        assert len(a[k]) == 99
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(a[k], b[k]))
