import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF001, frame
from sigspan.operators import sequence as sq
from sigspan.operators.ranges import fit_ranges
from sigspan.session import scratch_path
from sigspan.sources.tables import read_signal, read_table
from sigspan.spec import SMOKE, TEST


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_row_index_equals_global_row_number(spark):
    sig = read_signal(spark, SF001)
    ours = sq.row_index(sig, ["ts", "uid"])
    ref = sig.withColumn("idx", F.row_number().over(Window.orderBy("ts", "uid")))
    assert _rows(ours, "uid", "idx") == _rows(ref, "uid", "idx")


def test_row_index_ignores_input_partitioning(spark):
    sig = read_signal(spark, SF001)
    a = sq.row_index(sig, ["ts", "uid"])
    b = sq.row_index(sig.repartition(7, "x").sortWithinPartitions(F.rand(3)), ["ts", "uid"], num_partitions=5)
    assert _rows(a, "uid", "idx") == _rows(b, "uid", "idx")


def test_row_index_per_group_with_hot_group(spark):
    ev = read_table(spark, SF001, "events")
    # one user holds a third of all rows
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))
    ours = sq.row_index(hot, ["ts", "event_id"], ["user_id"], name="no")
    ref = hot.withColumn("no", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    assert _rows(ours, "event_id", "no") == _rows(ref, "event_id", "no")


def test_row_index_on_fixed_ranges_equals_the_stored_one(spark):
    sig = read_signal(spark, SF001)
    a = sq.row_index(sig, ["ts", "uid"], stored=False)
    b = sq.row_index(sig, ["ts", "uid"])
    assert _rows(a, "uid", "idx") == _rows(b, "uid", "idx")
    plan = a._jdf.queryExecution().toString()
    assert "row-index" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_row_index_on_fixed_ranges_with_hot_null_and_nan_keys(spark, parts):
    """A third of all rows share one first key; NULL, NaN, infinite and negative zero keys have their places."""
    special = F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 50 == 1, F.lit(float("nan")))
    special = special.when(F.col("id") % 50 == 2, F.lit(float("-inf"))).when(F.col("id") % 50 == 3, F.lit(-0.0)).when(F.col("id") % 50 == 4, F.lit(0.0))
    key = F.when(F.col("id") % 3 == 0, F.lit(7.5)).otherwise(F.coalesce(special, F.when(F.col("id") % 50 > 0, (F.col("id") * 37 % 1001 - 500) / 8.0)))
    df = spark.range(6000).select(key.cast("double").alias("k"), (F.col("id") * 7919 % 6007).alias("u"))
    ours = sq.row_index(df, ["k", "u"], stored=False, num_partitions=parts)
    ref = df.withColumn("idx", F.row_number().over(Window.orderBy("k", "u")))
    assert sorted((r.u, r.idx) for r in ours.collect()) == sorted((r.u, r.idx) for r in ref.collect())
    ranges = fit_ranges(df, ["k", "u"], 4 * parts)
    sizes = ranges.assign(df, "b").groupBy("b").count()
    got = sizes.orderBy("b").collect()
    assert len(got) <= ranges.count
    if parts > 1:  # the hot key is cut by the second key: no range holds much more than its share
        assert max(r["count"] for r in got) < 6000 / parts
    # ranges keep the order of both keys
    inside = ranges.assign(df, "b").withColumn("idx", F.row_number().over(Window.orderBy("k", "u")))
    spans = inside.groupBy("b").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).orderBy("b").collect()
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


def test_row_index_on_fixed_ranges_small_and_unfit_inputs(spark):
    empty = spark.createDataFrame([], "k double, u long")
    assert sq.row_index(empty, ["k", "u"], stored=False).count() == 0
    one = frame(spark, [(None, 1)], "k double, u long")
    assert [r.idx for r in sq.row_index(one, ["k", "u"], stored=False).collect()] == [1]
    days = frame(spark, [("2024-03-02", 1), ("2023-12-31", 2), (None, 3)], "d string, u long")
    dated = days.select(F.to_date("d").alias("d"), F.col("d").cast("timestamp_ntz").alias("t"), "u")
    for key in ("d", "t"):
        got = {r.u: r.idx for r in sq.row_index(dated, [key], stored=False).collect()}
        assert got == {3: 1, 2: 2, 1: 3}
    with pytest.raises(ValueError):
        sq.row_index(frame(spark, [("a",)], "s string"), ["s"], stored=False)
    with pytest.raises(ValueError):
        sq.row_index(one, ["k"], ["u"], stored=False)


def test_segments_positions(spark):
    df = spark.range(1, 251).withColumnRenamed("id", "idx")
    out = sq.assign_segments(df, SMOKE).collect()
    by_idx = {r.idx: (r.seg, r.no) for r in out}
    assert by_idx[1] == (0, 1)
    assert by_idx[100] == (0, 100)
    assert by_idx[101] == (1, 1)
    assert by_idx[250] == (2, 50)


def test_segment_name_not_truncated(spark):
    df = frame(spark, [(7,), (12345,)], "seg long")
    names = {r.seg: r.name for r in df.select("seg", sq.segment_name("seg").alias("name")).collect()}
    assert names == {7: "raw_0007", 12345: "raw_12345"}


def test_file_stem(spark):
    df = frame(spark, [("file:/a/b/seg_00ab.csv",)], "p string")
    assert df.select(sq.file_stem("p").alias("s")).first().s == "seg_00ab"


def test_complete_segments_and_tail(spark):
    seq = sq.assign_segments(spark.range(1, 2601).withColumnRenamed("id", "idx"), SMOKE)
    assert sorted(r.seg for r in sq.complete_segments(seq, SMOKE).collect()) == list(range(26))
    seq2 = sq.assign_segments(spark.range(1, 2651).withColumnRenamed("id", "idx"), SMOKE)
    assert sq.keep_complete(seq2, SMOKE).count() == 2600
    assert sorted(r.seg for r in sq.complete_segments(seq2, SMOKE).collect()) == list(range(26))


def test_union_ids_continue_and_labels_null(spark):
    seq = sq.sequence_signal(read_signal(spark, SF001), TEST)
    u = sq.union_train_test(seq, TEST)
    train = u.where("set = 0")
    test = u.where("set = 1")
    max_train = train.agg(F.max("uid")).first()[0]
    assert test.agg(F.min("uid")).first()[0] == max_train + 1
    assert test.where(F.col("y").isNotNull()).count() == 0
    assert sorted(r.seg for r in test.select("seg").distinct().collect()) == [0, 1]
    assert train.select("seg").distinct().count() == 8


def test_file_order_index_multi_file(spark):
    path = scratch_path(spark, "t-files")
    rows = [(float(i),) for i in range(300)]
    frame(spark, rows, "x double").coalesce(1).write.csv(path + "/a", header=True)
    frame(spark, rows[:40], "x double").coalesce(1).write.csv(path + "/b", header=True)
    raw = spark.read.csv(path + "/*/*.csv", header=True, schema="x double")
    per_file = sq.file_order_index(raw, name="no", per_file=True, keep_file=True)
    got = per_file.select("_file", "no", "x").collect()
    assert all(int(r.x) == r.no - 1 for r in got)
    assert len(got) == 340


def test_file_order_index_one_file_many_splits(spark):
    path = scratch_path(spark, "t-splits")
    rows = [(float(i),) for i in range(5000)]
    frame(spark, rows, "x double").coalesce(1).write.csv(path, header=True)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        raw = spark.read.csv(path, header=True, schema="x double")
        assert raw.rdd.getNumPartitions() > 4
        got = sq.file_order_index(raw, name="idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 5000
    assert all(int(r.x) == r.idx - 1 for r in got)


def test_null_group_keys_form_a_group(spark):
    rows = [(None, 3, 1.0), (None, 1, 2.0), ("a", 2, 3.0), ("a", 1, 4.0), (None, 2, 5.0)]
    df = frame(spark, rows, "g string, t int, v double")
    got = {(r.g, r.t): r.no for r in sq.row_index(df, ["t"], ["g"], name="no").collect()}
    assert got == {(None, 1): 1, (None, 2): 2, (None, 3): 3, ("a", 1): 1, ("a", 2): 2}
    from sigspan.operators.profile import exact_quantiles_distributed

    q = {(r.g, r.p): r.q for r in exact_quantiles_distributed(df, ["g"], "v", [0.0, 0.5, 1.0]).collect()}
    assert q == {(None, 0.0): 1.0, (None, 0.5): 2.0, (None, 1.0): 5.0, ("a", 0.0): 3.0, ("a", 0.5): 3.5, ("a", 1.0): 4.0}


def test_natural_order_of_paths(spark):
    names = ["p/part-99999-a.csv", "p/part-100000-a.csv", "p/part-9.csv", "p/part-010.csv", "p/x", "p/part-2/7", "p/part-2/10"]
    df = frame(spark, [(n,) for n in names], "path string")
    got = [r.path for r in df.orderBy(*sq.natural_order("path")).collect()]
    assert got == ["p/part-2/7", "p/part-2/10", "p/part-9.csv", "p/part-010.csv", "p/part-99999-a.csv", "p/part-100000-a.csv", "p/x"]


def test_shared_folder_is_needed_off_local_master():
    import pytest
    from types import SimpleNamespace

    from sigspan.session import checkpoint_dir

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d)))


def test_group_offsets_over_several_blocks(spark):
    sizes = {g: (g * 7) % 5 + 1 for g in range(50) if g % 9}
    rows = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(1, n + 1)], "seg long, no int")
    got = {r.seg: r.off for r in sq.group_offsets(rows.repartition(6), "seg", "no", block=8).collect()}
    assert got == {g: sum(n for k, n in sizes.items() if k < g) for g in sizes}


def test_row_index_reads_only_the_columns_in_use(spark):
    out = sq.row_index(spark.read.parquet(f"{SF001}/events.parquet"), ["ts", "event_id"]).select("event_id", "idx")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan
    reads = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema: " in line]
    assert reads and all("props" not in r for r in reads)
