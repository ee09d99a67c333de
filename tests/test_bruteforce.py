"""Operators against direct numpy computations on the small fixture (sf0.001)."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF0001, frame
from sigspan.functions.arrays import overlapped_bins
from sigspan.operators import labels as lab
from sigspan.operators import profile as prof
from sigspan.operators import sequence as sq
from sigspan.operators import slices as sl
from sigspan.operators import spectral as sp
from sigspan.sources.tables import read_signal
from sigspan.spec import SMOKE, BinSpec


def _signal(spark):
    pdf = read_signal(spark, SF0001).toPandas().sort_values(["ts", "uid"]).reset_index(drop=True)
    return pdf


def test_sequence_profile_and_labels_against_numpy(spark):
    pdf = _signal(spark)
    x = pdf["x"].to_numpy()
    seq = sq.sequence_signal(read_signal(spark, SF0001), SMOKE)
    profile = {r.seg: r for r in prof.segment_profile(seq, "moments").collect()}
    L = SMOKE.length
    for seg, r in profile.items():
        v = x[seg * L:(seg + 1) * L]
        d = v - v.mean()
        m2 = (d ** 2).mean()
        assert math.isclose(r.x_avg, v.mean(), rel_tol=1e-12)
        assert math.isclose(r.x_std, v.std(ddof=1), rel_tol=1e-10)
        assert math.isclose(r.x_skew, (d ** 3).mean() / m2 ** 1.5, rel_tol=1e-8, abs_tol=1e-12)
        assert math.isclose(r.x_kurt, (d ** 4).mean() / m2 ** 2 - 3, rel_tol=1e-8, abs_tol=1e-12)
        for name, p in [("x_p1", 5), ("x_p2", 20), ("x_p5", 50), ("x_p8", 80), ("x_p9", 95)]:
            assert math.isclose(getattr(r, name), np.percentile(v, p), rel_tol=1e-12)
        assert math.isclose(r.xa_p9, np.percentile(np.abs(v), 95), rel_tol=1e-12)
    labels = {r.seg: r.y for r in lab.segment_label(seq, SMOKE).collect()}
    y = pdf["y"].to_numpy()
    assert labels == {s: y[(s + 1) * L - 1] for s in range(len(x) // L)}


def test_segment_vector_and_dct_against_formula(spark):
    pdf = _signal(spark)
    x = pdf["x"].to_numpy()
    seq = sq.sequence_signal(read_signal(spark, SF0001), SMOKE)
    vec = {r.seg: r.vx for r in sl.concat_slices(sl.segment_slices(seq, SMOKE)).collect()}
    L, s = SMOKE.length, SMOKE.slice_len
    for seg, got in vec.items():
        seg_x = x[seg * L:(seg + 1) * L]
        # inclusive bounds: slice i = positions i*s .. (i+1)*s (1-based), clipped to 1..L
        want = np.concatenate([seg_x[max(i * s, 1) - 1:(i + 1) * s] for i in range(SMOKE.n_slices)])
        assert np.array_equal(np.array(got), want)
    seg0 = np.array(vec[0])
    n = len(seg0)
    k = np.arange(n)[:, None]
    basis = np.cos(np.pi / n * (np.arange(n)[None, :] + 0.5) * k)
    direct = basis @ seg0 * np.where(np.arange(n) == 0, math.sqrt(1 / n), math.sqrt(2 / n))
    df = frame(spark, [(0, seg0.tolist())], "seg long, vx array<double>")
    got = np.array(sp.dct(df, "vx").first().vx)
    assert np.allclose(got, direct, rtol=1e-9, atol=1e-9)


@settings(max_examples=15, deadline=None)
@given(
    st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=12, max_size=40),
    st.integers(1, 3),
    st.integers(1, 4),
    st.floats(0.5, 10),
)
def test_bins_against_python(spark, values, hop, width, divisor):
    n_bins = (len(values) - width) // hop + 1
    spec = BinSpec(n_bins, hop, width, divisor)
    df = frame(spark, [(0, values)], "id long, v array<double>")
    got = df.select(overlapped_bins("v", spec).alias("f")).first().f
    want = [sum(abs(e) for e in values[i * hop:i * hop + width]) / divisor for i in range(n_bins)]
    assert np.allclose(got, want, rtol=1e-12, atol=1e-9)


@settings(max_examples=10, deadline=None)
@given(st.integers(1, 230), st.sampled_from(["inclusive", "strict"]))
def test_slice_ids_against_definition(spark, no, boundary):
    spec = SMOKE.with_(boundary=boundary)
    got = sorted(frame(spark, [(no,)], "no int").select(sl.slice_ids(spec).alias("s")).first().s)
    s = spec.slice_len
    if boundary == "inclusive":
        want = [i for i in range(spec.n_slices) if i * s <= no <= (i + 1) * s]
    else:
        want = [i for i in range(spec.n_slices) if i * s < no <= (i + 1) * s]
    if no > spec.length:  # beyond the segment: the own slice number, dropped by slice_membership
        want = [(no - 1) // s]
    assert got == want


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50)), min_size=1, max_size=120, unique=True),
    st.integers(1, 7),
)
def test_row_index_against_pandas_rank(spark, pairs, parts):
    import pandas as pd

    df = frame(spark, pairs, "g int, k int")
    glob = {r.k_g: r.idx for r in sq.row_index(df.selectExpr("g", "k", "struct(g, k) AS k_g"), ["k", "g"], num_partitions=parts).collect()}
    pdf = pd.DataFrame(pairs, columns=["g", "k"]).sort_values(["k", "g"]).reset_index(drop=True)
    want = {(r.g, r.k): i + 1 for i, r in pdf.iterrows()}
    assert {(kg.g, kg.k): v for kg, v in glob.items()} == want
    grouped = {(r.g, r.k): r.no for r in sq.row_index(df, ["k"], ["g"], name="no", num_partitions=parts).collect()}
    pdf["no"] = pdf.groupby("g").cumcount() + 1
    assert grouped == {(r.g, r.k): r.no for r in pdf.itertuples()}
