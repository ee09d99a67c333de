import pytest
from pyspark.sql import functions as F

from conftest import SF0001, frame
from sigspan.operators import model as mdl
from sigspan.session import local_path, scratch_path
from sigspan.sources import files as fl
from sigspan.sources import sinks as sk


def test_segment_files_follow_manifest_not_size(spark):
    base = scratch_path(spark, "t-seg")
    for name, n in [("b_big", 500), ("a_small", 20), ("c_mid", 120)]:
        frame(spark, [(float(i),) for i in range(n)], "x double").coalesce(1).write.csv(f"{base}/tmp_{name}", header=True)
    import glob
    import os
    import shutil

    os.makedirs(local_path(base) + "/data")
    for name in ["b_big", "a_small", "c_mid"]:
        src = glob.glob(local_path(base) + f"/tmp_{name}/part-*.csv")[0]
        shutil.copy(src, local_path(base) + f"/data/{name}.csv")
    man_path = local_path(base) + "/manifest.csv"
    with open(man_path, "w") as f:
        f.write("seg_id,time_to_failure\nc_mid,0\nb_big,0\na_small,0\n")
    manifest = fl.read_manifest(spark, man_path)
    assert {r.seg_id: r.pos for r in manifest.collect()} == {"c_mid": 0, "b_big": 1, "a_small": 2}
    segs = fl.read_segment_files(spark, base + "/data", manifest)
    got = segs.groupBy("seg", "name").agg(F.count("*").alias("n"), F.min("no").alias("lo"), F.max("no").alias("hi"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, "c_mid", 120, 1, 120), (1, "b_big", 500, 1, 500), (2, "a_small", 20, 1, 20)]
    assert segs.where(F.col("x") != F.col("no") - 1).count() == 0


def test_submission_text_and_order(spark):
    df = frame(spark, [("s1", 1, 0.1), ("s0", 0, 2.5)], "seg_id string, pos long, time_to_failure double")
    path = sk.write_submission(df, scratch_path(spark, "t-sub"), single_file=True)
    lines = spark.read.text(path).collect()
    assert [r.value for r in lines] == ["seg_id,time_to_failure", "s0,2.50000000000000000000", "s1,0.10000000000000000555"]


def test_error_metrics_and_target_scale(spark):
    df = frame(spark, [(0, 1.0, 2.0), (1, 3.0, 3.0), (2, 4.0, 2.0)], "seg long, label double, prediction double")
    m = mdl.error_metrics(df).first()
    assert abs(m.mae - 1.0) < 1e-12 and abs(m.mse - 5 / 3) < 1e-12
    s = {r.seg: (r.scaled, r.back) for r in mdl.scale_target(df).collect()}
    assert s[2] == (1.0, 4.0) and s[0] == (0.25, 1.0)


def test_regressor_fits_and_predicts(spark):
    rows = [(i, [float(i), float(i % 3)], 2.0 * i + 1.0) for i in range(30)]
    df = frame(spark, rows, "seg long, features array<double>, label double")
    model = mdl.fit_regressor(df, "linear")
    pred = mdl.predict(model, df)
    assert mdl.error_metrics(pred).first().mae < 1e-6


def test_stream_ingest_equals_batch_reader_and_restarts_cleanly(spark):
    from sigspan.plans import catalog as c
    from sigspan.streaming.segment_stream import read_ingested, start_segment_stream

    data_dir, man_dir = c._write_segment_files(spark, SF0001)
    manifest = fl.read_manifest(spark, man_dir)
    batch = fl.read_segment_files(spark, data_dir, manifest, name_col="name")
    out, ck = scratch_path(spark, "t-stream"), scratch_path(spark, "t-stream-ck")
    start_segment_stream(spark, data_dir, out, ck, batch_bytes=2000).awaitTermination()
    assert spark.read.parquet(out).select("batch").distinct().count() > 1
    streamed = read_ingested(spark, out, manifest).select("seg", "name", "no", "x")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    # a restart with the same checkpoint finds nothing new and writes nothing twice
    start_segment_stream(spark, data_dir, out, ck, batch_bytes=2000).awaitTermination()
    assert read_ingested(spark, out, manifest).count() == batch.count()
    # files that came before their manifest lines wait in the table
    assert read_ingested(spark, out, manifest.where("false")).count() == 0


def test_segment_parts_names_and_missing_files(spark):
    import os

    import pytest

    base = local_path(scratch_path(spark, "t-parts"))
    for name, part, values in [("00123", "part-99999", [1, 2]), ("00123", "part-100000", [3]), ("a b+c", "part-2", [5, 6]), ("a b+c", "part-10", [7])]:
        os.makedirs(f"{base}/name={name}", exist_ok=True)
        with open(f"{base}/name={name}/{part}.csv", "w") as f:
            f.write("x\n" + "".join(f"{v}\n" for v in values))
    man = frame(spark, [("a b+c", 0), ("00123", 1)], "seg_id string, pos long")
    got = fl.read_segment_files(spark, base, man, name_col="name").select("seg", "name", "no", "x").collect()
    assert sorted(map(tuple, got)) == [(0, "a b+c", 1, 5.0), (0, "a b+c", 2, 6.0), (0, "a b+c", 3, 7.0), (1, "00123", 1, 1.0), (1, "00123", 2, 2.0), (1, "00123", 3, 3.0)]
    # grouping by seg puts a filter on it below the check
    assert fl.read_segment_files(spark, base, man, name_col="name").groupBy("seg").count().join(man.withColumnRenamed("pos", "seg"), "seg").count() == 2
    more = man.union(frame(spark, [("gone", 2)], "seg_id string, pos long"))
    with pytest.raises(Exception, match="no file for segment gone"):
        fl.read_segment_files(spark, base, more, name_col="name").collect()
    assert fl.read_segment_files(spark, base, more, name_col="name", check_missing=False).count() == 6


def test_submission_needs_every_prediction(spark):
    import pytest

    man = frame(spark, [("a", 0), ("b", 1)], "seg_id string, pos long")
    preds = frame(spark, [(0, 1.5)], "seg long, prediction double")
    with pytest.raises(Exception, match="no prediction for b"):
        mdl.submission(man, preds).collect()
    assert [tuple(r) for r in mdl.submission(man.limit(1), preds).select("seg_id", "time_to_failure").collect()] == [("a", 1.5)]


def test_write_stage_modes(spark):
    import pytest

    df = frame(spark, [(1, 2.0)], "seg long, x double")
    path = scratch_path(spark, "t-modes")
    sk.write_stage(df, path, mode="errorifexists")
    with pytest.raises(Exception):
        sk.write_stage(df, path, mode="errorifexists")
    sk.write_stage(df, path, mode="append")
    assert spark.read.parquet(path).count() == 2
    sk.write_stage(df, path, mode="overwrite", partition_by=["seg"], sort_by=["seg", "x"])
    assert spark.read.parquet(path).count() == 1


def test_streamed_read_moves_no_sample_and_names_missing_files(spark):
    """The dictionary of files is what is joined: no exchange above the scan of the rows, at a small automatic limit too."""
    from sigspan.streaming.segment_stream import ingest_segment_files, read_ingested

    src, out = scratch_path(spark, "t-dict"), scratch_path(spark, "t-dict-out")
    rows = [(f"s{g}", float(i)) for g in range(5) for i in range(40)]
    spark.createDataFrame(rows, "name string, x double").repartition(6).write.partitionBy("name").option("header", True).csv(src)
    manifest = spark.createDataFrame([(f"s{g}", 4 - g) for g in range(5)], "seg_id string, pos long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 20))
    try:
        back = ingest_segment_files(spark, src, manifest, out, batch_bytes=300)
        assert spark.read.parquet(out).select("batch").distinct().count() > 1
        assert sorted((r.seg, r.name, r.no) for r in back.collect()) == sorted((4 - g, f"s{g}", i + 1) for g in range(5) for i in range(40))
        plan = read_ingested(spark, out, manifest, check_missing=False)._jdf.queryExecution().executedPlan().toString()
        joined, _, rest = plan.partition("BroadcastHashJoin [batch")
        assert "Exchange" not in joined and "SortMergeJoin" not in plan
        scan = rest[: rest.index("FileScan parquet")]
        assert "Exchange" not in scan
        more = manifest.unionByName(spark.createDataFrame([("gone", 9)], "seg_id string, pos long"))
        with pytest.raises(Exception, match="no file for segment gone"):
            read_ingested(spark, out, more).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_huber_and_gbt_regressors_run(spark):
    rows = [(i, [float(i), float(i % 3)], 2.0 * i + 1.0 + (50.0 if i == 7 else 0.0)) for i in range(40)]
    df = frame(spark, rows, "seg long, features array<double>, label double")
    huber = mdl.predict(mdl.fit_regressor(df, "huber"), df)
    assert mdl.error_metrics(huber.where("seg != 7")).first().mae < 0.5
    gbt = mdl.predict(mdl.fit_regressor(df, "gbt"), df)
    assert gbt.count() == 40
