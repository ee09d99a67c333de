from pyspark.sql import functions as F

from conftest import SF0001, SF001, frame
from sigspan.operators import sequence as sq
from sigspan.operators import slices as sl
from sigspan.sources.tables import read_signal
from sigspan.spec import SMOKE, TAIL, TEST


def _seq(spark, n_rows, spec):
    df = spark.range(1, n_rows + 1).withColumnRenamed("id", "idx").withColumn("x", F.col("idx").cast("double"))
    return sq.assign_segments(df, spec)


def test_boundary_sample_membership(spark):
    seq = _seq(spark, 100, SMOKE)
    inc = {r.no: sorted(r.s) for r in seq.select("no", sl.slice_ids(SMOKE).alias("s")).collect()}
    assert inc[10] == [0, 1] and inc[11] == [1] and inc[100] == [9] and inc[1] == [0]
    strict = SMOKE.with_(boundary="strict")
    st = {r.no: r.s for r in seq.select("no", sl.slice_ids(strict).alias("s")).collect()}
    assert st[10] == [0] and st[11] == [1]


def test_inclusive_vector_length_and_strict_partition(spark):
    seq = _seq(spark, 300, SMOKE)
    inc = sl.concat_slices(sl.segment_slices(seq, SMOKE)).collect()
    assert {len(r.vx) for r in inc} == {SMOKE.length + SMOKE.n_slices - 1}
    strict = SMOKE.with_(boundary="strict")
    st = sl.concat_slices(sl.segment_slices(seq, strict)).collect()
    for r in st:
        assert r.vx == [float(r.seg * 100 + i) for i in range(1, 101)]


def test_missing_slice_drops_segment(spark):
    seq = _seq(spark, 250, SMOKE)  # segment 2 has 50 samples: slices 5..9 empty
    segs = sorted(r.seg for r in sl.segment_slices(seq, SMOKE).collect())
    assert segs == [0, 1]
    assert sorted(r.seg for r in sl.slice_counts(seq, SMOKE).collect()) == [0, 1]


def test_join_form_equals_one_scan(spark):
    seq = sq.sequence_signal(read_signal(spark, SF001), TAIL)
    a = sorted(tuple(r) for r in sl.slice_counts(seq, TAIL).collect())
    b = sorted(tuple(r) for r in sl.join_slices(seq, TAIL).select(sl.slice_counts(seq, TAIL).columns).collect())
    assert a == b and len(a) == 11


def test_sliding_window_sizes(spark):
    seq = _seq(spark, 1000, TEST)
    w = sl.sliding_windows(sl.segment_slices(seq, TEST), TEST)
    sizes = {r.win: len(r.vx) for r in w.collect()}
    assert sizes[0] == 302 and all(sizes[j] == 303 for j in range(1, 8)) and len(sizes) == 8


def test_shuffled_input_same_vectors(spark):
    seq = _seq(spark, 300, SMOKE)
    a = sorted((r.seg, tuple(r.vx)) for r in sl.concat_slices(sl.segment_slices(seq, SMOKE)).collect())
    shuffled = seq.repartition(5).sortWithinPartitions(F.rand(1))
    b = sorted((r.seg, tuple(r.vx)) for r in sl.concat_slices(sl.segment_slices(shuffled, SMOKE)).collect())
    assert a == b


def test_gap_in_positions_uses_filter_path(spark):
    rows = [(0, n, float(n)) for n in range(1, 101) if n != 55] + [(1, n, float(n)) for n in range(1, 101)]
    df = frame(spark, rows, "seg long, no int, x double")
    out = {r.seg: r.slices for r in sl.segment_slices(df, SMOKE).collect()}
    assert out[0][5] == [float(n) for n in range(50, 61) if n != 55]
    assert out[1][5] == [float(n) for n in range(50, 61)]
    assert out[0][0] == [float(n) for n in range(1, 11)] and out[1][9] == [float(n) for n in range(90, 101)]


def test_union_keeps_sets_and_tail_apart(spark):
    from sigspan.operators import labels as lab
    from sigspan.operators import profile as prof

    spec = SMOKE.with_(length=300, slice_len=30)
    seq = sq.sequence_signal(read_signal(spark, SF0001), spec)
    union = sq.union_train_test(seq, spec)
    assert union.count() == seq.count() and seq.count() % 300
    keys = ["set", "seg"]
    slices = sl.segment_slices(union, spec, keys=keys)
    assert slices.count() == seq.count() // 300
    assert {len(r.vx) for r in sl.concat_slices(slices, keys=keys).collect()} == {spec.vector_len}
    assert sum(r.n for r in sl.slice_rows(union, spec, keys=keys).collect()) >= seq.count()
    assert lab.segment_label(union, spec, keys).count() == seq.count() // 300
    assert prof.segment_profile(union, "moments", keys=keys).count() == seq.count() // 300 + 1


def test_degenerate_segment_spoils_no_scaler(spark):
    import math

    from sigspan.operators.scaler import standard_scale

    df = frame(spark, [(0, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, float("nan")])], "seg long, v array<double>")
    got = {r.seg: r.v for r in standard_scale(df, "v").collect()}
    assert abs(got[1][1] - 6.0 / math.sqrt(8.0)) < 1e-12 and math.isnan(got[2][1]) and abs(got[0][0] - 0.5) < 1e-12


def test_bucketed_table_has_one_file_a_bucket(spark):
    from sigspan.session import scratch_path
    from sigspan.sources import sinks as sk

    seq = sq.sequence_signal(read_signal(spark, SF0001), SMOKE)
    table = sk.write_segment_table(seq, scratch_path(spark, "t-buckets"), buckets=3)
    assert 0 < len(table.inputFiles()) <= 3 and table.count() == seq.count()
