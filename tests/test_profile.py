import math

from pyspark.sql import functions as F

from conftest import SF001, frame
from sigspan.operators import profile as prof
from sigspan.operators import sequence as sq
from sigspan.sources.tables import read_signal
from sigspan.spec import TEST


def test_single_row_and_constant_groups(spark):
    df = frame(spark, [(1, 5.0), (2, 3.0), (2, 3.0), (2, 3.0)], "seg long, x double")
    p = {r.seg: r for r in prof.segment_profile(df, "moments").collect()}
    one, const = p[1], p[2]
    assert one.x_std is None and one.x_skew is None and one.x_kurt is None
    assert one.x_p1 == 5.0 and one.x_p9 == 5.0
    assert const.x_std == 0.0 and const.x_skew is None and const.x_kurt is None


def test_profile_both_is_union_of_columns(spark):
    seq = sq.sequence_signal(read_signal(spark, SF001), TEST)
    both = prof.segment_profile(seq, "both")
    assert "x_p01" in both.columns and "x_skew" in both.columns and len(both.columns) == 1 + 20 + 13


def test_distributed_quantiles_match_percentile(spark):
    seq = sq.sequence_signal(read_signal(spark, SF001), TEST)
    # a hot group: one segment id holds a third of the rows
    hot = seq.withColumn("seg", F.when(F.col("uid") % 3 == 0, F.lit(99)).otherwise(F.col("seg")))
    a = {(r.seg, r.p): r.q for r in prof.quantile_profile(hot, ["seg"], "x").collect()}
    b = {(r.seg, r.p): r.q for r in prof.exact_quantiles_distributed(hot, ["seg"], "x").collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert math.isclose(a[k], b[k], rel_tol=1e-12, abs_tol=1e-12), k


def test_bucket_of_last_position_is_own_bucket(spark):
    df = frame(spark, [(0, n, float(n)) for n in range(1, 1001)], "seg long, no int, x double")
    bp = prof.bucket_profile(df, TEST)
    counts = {r.seq: r.n for r in df.withColumn("seq", prof.bucket_of(TEST)).groupBy("seq").agg(F.count("*").alias("n")).collect()}
    assert counts[0] == 49 and counts[20] == 1 and len(counts) == 21
    assert bp.count() == 21


def test_bucket_vectors_ordered(spark):
    rows = [(0, s, float(s)) for s in [3, 1, 2, 0]]
    df = frame(spark, rows, "seg long, seq int, x_avg double").withColumn("x_p02", F.col("x_avg")).withColumn(
        "x_p98", F.col("x_avg")
    ).withColumn("xa_p95", F.col("x_avg"))
    v = prof.bucket_vectors(df).first()
    assert v.stx1 == [0.0, 1.0, 2.0, 3.0]


def test_sql_profile_equals_dataframe_profile(spark):
    from sigspan.sources.views import profile_sql

    seq = sq.sequence_signal(read_signal(spark, SF001), TEST)
    a = prof.segment_profile(seq, "tails")
    b = profile_sql(spark, seq, "tails")
    ra = {r.seg: r for r in a.collect()}
    rb = {r.seg: r for r in b.collect()}
    assert ra.keys() == rb.keys()
    for k in ra:
        for c in a.columns:
            assert math.isclose(ra[k][c], rb[k][c], rel_tol=1e-12), (k, c)


def test_register_views(spark):
    from conftest import SF0001
    from sigspan.sources.views import register_views

    names = register_views(spark, SF0001, ["events", "lineitem"])
    assert names == ["events", "lineitem"]
    assert spark.sql("SELECT count(*) AS n FROM events").first().n == 1000


def test_assemble_null_policies(spark):
    import pytest

    df = frame(spark, [(1, 1.0, None), (2, 2.0, 3.0)], "seg long, a double, b double")
    keep = {r.seg: r.stat for r in prof.assemble(df, ["a", "b"], handle_invalid="keep").collect()}
    assert keep[2] == [2.0, 3.0] and math.isnan(keep[1][1])
    assert [r.seg for r in prof.assemble(df, ["a", "b"], handle_invalid="skip").collect()] == [2]
    with pytest.raises(Exception):
        prof.assemble(df, ["a", "b"]).collect()


def test_samples_past_the_last_slice_are_left_out(spark):
    from sigspan.operators import slices as sl
    from sigspan.spec import SMOKE

    rows = [(0, n, float(n)) for n in range(1, 150)]
    make = lambda r: sl.segment_slices(frame(spark, r, "seg long, no int, x double"), SMOKE).collect()
    assert make(rows) == make(rows[: SMOKE.length])


def test_approx_percentiles_close_to_exact(spark):
    seq = sq.sequence_signal(read_signal(spark, SF001), TEST)
    exact = {r.seg: r.x_p5 for r in prof.segment_profile(seq, "moments").collect()}
    approx = {r.seg: r.x_p5 for r in prof.segment_profile(seq, "moments", approx_accuracy=100000).collect()}
    for k in exact:
        assert abs(exact[k] - approx[k]) <= 1.0
