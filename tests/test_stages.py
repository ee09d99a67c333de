from pyspark.sql import functions as F

from conftest import SF001
from sigspan.operators import sequence as sq
from sigspan.plans.stages import run_stages
from sigspan.session import scratch_path
from sigspan.sources import sinks as sk
from sigspan.sources.tables import read_signal
from sigspan.spec import TEST


def test_stages_end_to_end(spark):
    seq = sq.sequence_signal(read_signal(spark, SF001), TEST)
    base = scratch_path(spark, "t-stages")
    # train.csv: the first 8 segments in time order, one file
    seq.where(F.col("seg") < 8).orderBy("idx").select("x", "y").coalesce(1).write.option("header", True).csv(f"{base}/train")
    # test files: segments 8 and 9, one folder per name; manifest lists 9 first
    test = seq.where(F.col("seg") >= 8).withColumn("name", sq.segment_name("seg"))
    sk.write_signal_csv(test.repartition("name").sortWithinPartitions("name", "no"), f"{base}/test", ["x"], partition_by=["name"])
    spark.createDataFrame([("raw_0009",), ("raw_0008",)], "seg_id string").coalesce(1).write.option("header", True).csv(f"{base}/manifest")

    result = run_stages(spark, f"{base}/train", f"{base}/test", f"{base}/manifest", f"{base}/out", TEST, kind="linear", name_col="name")
    out = f"{base}/out"
    train = spark.read.parquet(f"{out}/train.parquet")
    test_t = spark.read.parquet(f"{out}/test.parquet")
    assert train.count() == 8000 and test_t.count() == 2000
    assert test_t.agg(F.min("uid")).first()[0] == train.agg(F.max("uid")).first()[0] + 1
    # manifest order: position 0 is raw_0009, whose samples continue the ids first
    first = test_t.where("seg = 0").agg(F.min("uid").alias("u"), F.first("name").alias("n")).first()
    assert first.n == "raw_0009" and first.u == 8000
    assert test_t.where(F.col("y").isNotNull()).count() == 0
    fbin = spark.read.parquet(f"{out}/train.fbin.parquet").collect()
    assert len(fbin) == 8 and {len(r.f) for r in fbin} == {TEST.band_size}
    stat = spark.read.parquet(f"{out}/train.stat.parquet").collect()
    assert {len(r.stat) for r in stat} == {20}
    assert {len(r.stat) for r in spark.read.parquet(f"{out}/train.stat.2.parquet").collect()} == {14}
    win = spark.read.parquet(f"{out}/test.win.fbin.parquet").collect()
    assert len(win) == 2 and {len(r.f) for r in win} == {TEST.n_windows * TEST.band_size}
    assert spark.read.parquet(f"{out}/train.win.target.parquet").count() == 8
    assert spark.read.parquet(f"{out}/train.win.stat.parquet").count() == 8
    # every step is a table, and the windows' features come from the same slices
    for name in ("train.vector", "train.vector.low", "train.vector.dct", "train.bins", "train.win.vector.dct", "train.profile"):
        assert spark.read.parquet(f"{out}/{name}.parquet").select("seg").distinct().count() == 8, name
    bins = spark.read.parquet(f"{out}/test.bins.parquet").collect()
    assert len(bins) == 2 and {len(r.f) for r in bins} == {99}
    metrics = {r.set_name for r in result.metrics.collect()}
    assert metrics == {"train", "holdout"}
    res = spark.read.csv(f"{out}/result", header=True).collect()
    assert [r.seg_id for r in res] == ["raw_0009", "raw_0008"]


def test_bucketed_segment_table_groups_without_shuffle(spark):
    from sigspan.operators import profile as prof
    from sigspan.operators import slices as sl

    seq = sq.sequence_signal(read_signal(spark, SF001), TEST)
    table = sk.write_segment_table(seq, scratch_path(spark, "t-bucketed"))
    for df in (prof.segment_profile(table, "moments"), sl.segment_slices(table, TEST)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
        assert df.count() == 10


def test_stored_steps_read_the_samples_once(spark):
    from sigspan.plans import stages as st

    seq = sq.sequence_signal(read_signal(spark, SF001), TEST)
    table = sk.write_segment_table(seq, scratch_path(spark, "t-once"))
    base = scratch_path(spark, "t-steps")
    scans = []

    def store(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        scans.append((name, plan.count("Relation spark_catalog")))
        return spark.read.schema(df.schema).parquet(sk.write_stage(df, f"{base}/{name}"))

    slices = st.slice_table(table, table, TEST, store)
    f_train, f_test = st.spectral_features(*slices, TEST, store)
    s20, s14 = st.stat_features(table, "train", store)
    assert {n: k for n, k in scans if k} == {"train.vector": 1, "test.vector": 1, "train.profile": 1}
    for df in (s20, s14):
        assert "Relation spark_catalog" not in df._jdf.queryExecution().optimizedPlan().toString()
    lazy = st.spectral_features(*st.slice_table(table, table, TEST), TEST)[0]
    want = {r.seg: r.f for r in lazy.collect()}
    got = {r.seg: r.f for r in f_train.collect()}
    assert want.keys() == got.keys()
    assert all(abs(a - b) <= 1e-9 * max(1, abs(a)) for k in want for a, b in zip(want[k], got[k], strict=True))
