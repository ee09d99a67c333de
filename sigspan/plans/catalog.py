"""Query catalogue: one function per query key, ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (mostly ``events`` as the signal, ``embeddings`` for ready
vectors, ``lineitem`` for many-group profiles), so its work grows with them. Output columns are
long form for vectors (0-based ``k``), integral columns are BIGINT and doubles are rounded to 6
decimals, the same convention as the SQL in :mod:`sigspan.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import labels as lab
from ..operators import model as mdl
from ..operators import moments as mom
from ..operators import profile as prof
from ..operators import scaler as sc
from ..operators import sequence as sq
from ..operators import slices as sl
from ..operators import spectral as sp
from ..operators.blocked import blocked_spectrum
from ..operators.robust import fit_absolute
from ..operators.shared_windows import scaled_window_spectra
from ..functions.arrays import band, overlapped_bins, stride
from ..functions.stats import PROFILE_20
from ..session import scratch_path, shuffle_partitions, stage_table
from ..sources import files as fl
from ..sources import sinks as sk
from ..sources.views import profile_sql
from ..sources.tables import embeddings_vectors, read_keys, read_signal, read_table
from ..spec import SMOKE, TAIL, TEST, BinSpec, SegmentSpec
from ..streaming.segment_stream import ingest_segment_files
from .stages import ingest_test

# Embedding spectral-bin shape used by the vector queries: 31 bins, hop 2, width 4, divisor 4.
EMB_BINS = BinSpec(31, 2, 4, 4.0)
EMB_BAND = (10, 26)
LONG_KEEP = 300  # coefficients of the one long segment
NAMES_SPEC = SMOKE.with_(length=1, slice_len=1)  # one sample per segment: many names, past 9999 at sf0.1
MODEL_SPEC = SMOKE  # L = 100: enough segments for 13 features
LOOKUP_NAMES = [md5(str(seg).encode()).hexdigest()[:12] for seg in (*range(0, 10, 3), *range(10, 200, 13))]


def finalize(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Integral columns to BIGINT, doubles rounded (the oracle applies the same)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), decimals) + F.lit(0.0)  # no negative zero
        cols.append(c.alias(f.name))
    return df.select(*cols)


def seq_of(spark: SparkSession, sf_dir: str, spec: SegmentSpec = TEST, stored: bool = True) -> DataFrame:
    return sq.sequence_signal(read_signal(spark, sf_dir), spec, stored=stored)


def _long(df: DataFrame, keys: list[str], col: str, k: str = "k", v: str = "v") -> DataFrame:
    return sl.to_long(df, keys, col, k, v)


# ---------------------------------------------------------------- sequence and names


def q_row_index(spark, sf):
    return finalize(sq.row_index(read_signal(spark, sf), ["ts", "uid"], keep=["uid"], stored=False).select("uid", "idx"))


def q_sequenced_signal(spark, sf):
    return finalize(seq_of(spark, sf, stored=False).select("uid", "seg", "no", "x", "y"))


def q_rank_in_segment(spark, sf):
    ev = read_table(spark, sf, "events")
    out = sq.row_index(ev, ["ts", "event_id"], ["user_id"], name="no", keep=["user_id", "event_id"])
    return finalize(out.select("user_id", F.col("event_id").alias("uid"), "no"))


def q_rank_in_segment_nulls(spark, sf):
    """Row numbers in groups whose key can be NULL (it forms a group)."""
    ev = read_table(spark, sf, "events").select("ts", "event_id", F.expr("nullif(user_id % 7, 0)").alias("grp"))
    out = sq.row_index(ev, ["ts", "event_id"], ["grp"], name="no", keep=["grp", "event_id"])
    return finalize(out.select("grp", F.col("event_id").alias("uid"), "no"))


def q_segment_names(spark, sf):
    seq = seq_of(spark, sf, NAMES_SPEC, stored=False)
    return finalize(seq.where(F.col("no") == 1).select("seg", sq.segment_name("seg").alias("name")))


def q_complete_segments(spark, sf):
    return finalize(sq.complete_segments(seq_of(spark, sf, TAIL, stored=False), TAIL))


def q_global_max(spark, sf):
    return finalize(sq.max_scalar(read_signal(spark, sf), "uid", "m"))


# ---------------------------------------------------------------- profiles


def q_moments_profile(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return finalize(prof.moments_profile(li, ["l_suppkey"], "l_extendedprice"))


def q_supplier_quantiles(spark, sf):
    """Exact percentiles per supplier: groups without a size bound."""
    li = read_table(spark, sf, "lineitem")
    return finalize(prof.exact_quantiles_distributed(li, ["l_suppkey"], "l_extendedprice"))


def q_supplier_quantiles_nulls(spark, sf):
    """Exact percentiles of groups whose key can be NULL (it forms a group)."""
    li = read_table(spark, sf, "lineitem").select(F.expr("nullif(l_suppkey % 7, 0)").alias("grp"), "l_extendedprice")
    return finalize(prof.exact_quantiles_distributed(li, ["grp"], "l_extendedprice"))


def q_selected_quantiles(spark, sf):
    """Exact percentiles of a few large groups, each selected by histogram refinement."""
    li = read_table(spark, sf, "lineitem").select(F.expr("nullif(l_quantity % 3, 0)").cast("long").alias("grp"), "l_extendedprice")
    return finalize(prof.exact_quantiles_distributed(li, ["grp"], "l_extendedprice", large=1000))


def q_segment_quantiles(spark, sf):
    return finalize(prof.quantile_profile(seq_of(spark, sf, stored=False), ["seg"], "x"))


def q_segment_profile_20(spark, sf):
    return finalize(prof.segment_profile(seq_of(spark, sf), "moments"))


def q_segment_profile_14(spark, sf):
    return finalize(prof.segment_profile(seq_of(spark, sf), "tails"))


def q_bucket_profile(spark, sf):
    return finalize(prof.bucket_profile(seq_of(spark, sf), TEST))


def q_bucket_vectors(spark, sf):
    vec = prof.bucket_vectors(prof.bucket_profile(seq_of(spark, sf), TEST))
    out = vec.select("seg", F.posexplode(F.arrays_zip("stx1", "stx2", "stx3", "stx4")).alias("k", "_z"))
    return finalize(out.select("seg", "k", "_z.stx1", "_z.stx2", "_z.stx3", "_z.stx4"))


def q_bucket_features(spark, sf):
    """Bucket vectors of complete segments, each scaled by its own per-dimension std."""
    seq = sq.keep_complete(seq_of(spark, sf), TEST)
    vec = prof.bucket_vectors(prof.bucket_profile(seq, TEST))
    raw = [f"stx{i}" for i in range(1, 5)]
    vec = sc.standard_scale(vec, raw, [f"stxn{i}" for i in range(1, 5)]).drop(*raw)
    out = vec.select("seg", F.posexplode(F.arrays_zip("stxn1", "stxn2", "stxn3", "stxn4")).alias("k", "_z"))
    return finalize(out.select("seg", "k", "_z.stxn1", "_z.stxn2", "_z.stxn3", "_z.stxn4"))


def _profile_vector(spark, sf):
    stats = [s[0] for s in PROFILE_20]
    p = prof.segment_profile(seq_of(spark, sf), "moments")
    return prof.assemble(p, stats, "stat", handle_invalid="keep").select("seg", "stat")


def q_profile_vector(spark, sf):
    return finalize(_long(_profile_vector(spark, sf), ["seg"], "stat"))


def q_profile_scaled(spark, sf):
    """The 20-statistic vector scaled on its own set (fit and transform on the same frame)."""
    scaled = sc.standard_scale(_profile_vector(spark, sf), "stat")
    return finalize(_long(scaled, ["seg"], "stat"))


def q_scaler_params(spark, sf):
    stds = sc.fit_scaler(embeddings_vectors(spark, sf), "vx")
    return finalize(_long(stds, [], "std", "k", "std"))


def q_scaled_self(spark, sf):
    emb = embeddings_vectors(spark, sf)
    return finalize(_long(sc.standard_scale(emb, "vx"), ["vec_id"], "vx"))


def q_scaled_train_test(spark, sf):
    emb = embeddings_vectors(spark, sf).withColumn("is_train", (F.col("vec_id") % 5 < 4).cast("int"))
    scaled = sc.standard_scale(emb, "vx", fit_on=emb.where(F.col("is_train") == 1))
    return finalize(_long(scaled, ["vec_id", "is_train"], "vx"))


def q_scaler_merge(spark, sf):
    """The scaler from states: two batches of vectors, the second stored twice (it replaces itself), merged."""
    emb = embeddings_vectors(spark, sf)
    path = scratch_path(spark, "scaler-states")
    states = None
    for batch, part in ((0, emb.where(F.col("vec_id") % 3 > 0)), (1, emb.where(F.col("vec_id") % 3 == 0)), (1, emb.where(F.col("vec_id") % 3 == 0))):
        states = mom.scaler_state(part, "vx")
        sk.write_batch(states, path, batch)
    merged = mom.merge_states(sk.read_batches(spark, path, states.schema), ["k"])
    return finalize(_long(mom.scaler_from_states(merged), [], "std", "k", "std"))


def q_segment_profile_rollup(spark, sf):
    """Moments of segments, of x and abs(x), rolled up from the states of their buckets."""
    seq = seq_of(spark, sf).withColumn("bucket", prof.bucket_of(TEST))
    out = None
    for prefix, value in (("x", F.col("x")), ("xa", F.abs("x"))):
        buckets = mom.moment_state(seq, ["seg", "bucket"], value)
        part = mom.state_statistics(mom.merge_states(buckets, ["seg"]), ["seg"], prefix)
        out = part if out is None else out.join(part, "seg")
    return finalize(out)


# ---------------------------------------------------------------- labels


def q_label_at_end(spark, sf):
    return finalize(lab.segment_label(seq_of(spark, sf, stored=False), TEST))


def q_window_labels(spark, sf):
    return finalize(lab.window_labels(seq_of(spark, sf, stored=False), TEST))


# ---------------------------------------------------------------- slices


def q_slice_rows(spark, sf):
    return finalize(sl.slice_rows(seq_of(spark, sf), TEST))


def q_slice_vectors(spark, sf):
    vec = sl.slice_vectors(sl.segment_slices(seq_of(spark, sf), TEST))
    return finalize(vec.select("seg", "slice", F.posexplode("vx").alias("k", "v")))


def q_slice_vectors_long(spark, sf):
    """Segments longer than the slices: samples past the last slice lie in none."""
    seq = seq_of(spark, sf, TEST.with_(length=TEST.length + 100))
    return finalize(sl.slice_vectors(sl.segment_slices(seq, TEST)).select("seg", "slice", F.posexplode("vx").alias("k", "v")))


def q_slice_join(spark, sf):
    return finalize(sl.slice_counts(seq_of(spark, sf, TAIL), TAIL))


def q_concat_slices(spark, sf):
    vec = sl.concat_slices(sl.segment_slices(seq_of(spark, sf), TEST))
    return finalize(_long(vec, ["seg"], "vx"))


def q_sliding_windows(spark, sf):
    win = sl.sliding_windows(sl.segment_slices(seq_of(spark, sf), TEST), TEST)
    out = win.select("seg", "win", F.size("vx").alias("n"), F.aggregate("vx", F.lit(0.0), lambda a, e: a + e).alias("x_sum"))
    return finalize(out)


# ---------------------------------------------------------------- spectra


def q_dct_spectrum(spark, sf):
    emb = embeddings_vectors(spark, sf)
    return finalize(_long(sp.dct(emb, "vx"), ["vec_id"], "vx"))


def _segment_vectors(seq: DataFrame, spec: SegmentSpec = TEST) -> DataFrame:
    return sl.concat_slices(sl.segment_slices(seq, spec))


def q_dct_lowpass(spark, sf):
    spec_df = sp.dct(_segment_vectors(seq_of(spark, sf)), "vx", keep=TEST.dct_keep)
    return finalize(_long(spec_df, ["seg"], "vx"))


def q_long_spectrum(spark, sf):
    """First coefficients of one segment as long as the signal allows (a power of ten), transformed in blocks."""
    sig = read_signal(spark, sf)
    length = 10 ** (len(str(sig.count())) - 1)
    seq = sq.row_index(sig, ["ts", "uid"], keep=["x"], stored=False).where(F.col("idx") <= length)
    spectrum = blocked_spectrum(seq.select(F.lit(0).alias("seg"), F.col("idx").alias("no"), "x"), length, min(LONG_KEEP, length))
    return finalize(spectrum.select("k", F.col("c").alias("v")))


def q_spectral_bins(spark, sf):
    emb = embeddings_vectors(spark, sf)
    return finalize(_long(emb.select("vec_id", overlapped_bins("vx", EMB_BINS).alias("f")), ["vec_id"], "f", "b"))


def q_band_slice(spark, sf):
    emb = embeddings_vectors(spark, sf)
    return finalize(_long(emb.select("vec_id", band("vx", *EMB_BAND).alias("f")), ["vec_id"], "f"))


def q_stride_slice(spark, sf):
    emb = embeddings_vectors(spark, sf)
    f = stride(band("vx", *EMB_BAND), 2)
    return finalize(_long(emb.select("vec_id", f.alias("f")), ["vec_id"], "f"))


def _spectral_features(seq: DataFrame, spec: SegmentSpec = TEST, fit_segments: DataFrame | None = None) -> DataFrame:
    """Segment vectors -> DCT, low pass, std scaler -> bins ``(seg, f)``.

    The scaler is fitted on ``fit_segments`` (a ``seg`` list, e.g. the training split) and applied
    to every segment; without it, on all segments.
    """
    vec = _segment_vectors(seq, spec)
    fit_on = vec.join(fit_segments.select("seg"), "seg", "left_semi") if fit_segments is not None else None
    scaled = sp.spectrum_scaled(vec, spec, fit_on=fit_on)
    return sp.spectral_bins(scaled, "vx", spec.bins, "f").drop("vx")


def q_spectral_pipeline(spark, sf):
    return finalize(_long(_spectral_features(seq_of(spark, sf)), ["seg"], "f", "b"))


def _window_spectra(spark, sf) -> DataFrame:
    wins = sl.sliding_windows(sl.segment_slices(seq_of(spark, sf), TEST), TEST)
    return sp.window_spectra(wins, TEST)


def q_window_spectra(spark, sf):
    return finalize(_long(_window_spectra(spark, sf), ["seg", "win"], "fn"))


def q_window_spectra_shared(spark, sf):
    """The same values, each slice transformed once for all windows that hold it."""
    shared = scaled_window_spectra(sl.segment_slices(seq_of(spark, sf), TEST), TEST)
    return finalize(_long(shared, ["seg", "win"], "fn"))


def q_window_spectral_bins(spark, sf):
    bins = sp.window_bins(_window_spectra(spark, sf), TEST)
    return finalize(_long(bins, ["seg", "win"], "f", "b"))


def q_window_features(spark, sf):
    feats = sp.window_features(sp.window_bins(_window_spectra(spark, sf), TEST), TEST)
    return finalize(_long(feats, ["seg"], "f"))


# ---------------------------------------------------------------- files and sinks


def q_csv_roundtrip(spark, sf):
    seq = seq_of(spark, sf)
    path = sk.write_signal_csv(seq, scratch_path(spark, "csv"), ["x", "y"], sort_by=["idx"])
    back = fl.read_signal_csv(spark, path)
    return finalize(back.agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")))


def q_csv_sequence(spark, sf):
    """Signal written as time-ordered CSV parts, read back and numbered in file order (no shuffle)."""
    seq = seq_of(spark, sf)
    path = sk.write_signal_csv(seq, scratch_path(spark, "csvseq"), ["x", "y"], sort_by=["idx"])
    indexed = fl.read_signal_csv_indexed(spark, path).withColumnRenamed("uid", "idx")
    return finalize(sq.assign_segments(indexed, TEST).select("seg", "no", "x", "y"))


def _segment_file_names(seq: DataFrame) -> DataFrame:
    """Names that are easy to lose: leading zeros for even segments, a space for odd ones."""
    even = F.format_string("%05d", F.col("seg"))
    return seq.withColumn("name", F.when(F.col("seg") % 2 == 0, even).otherwise(F.format_string("raw %04d", F.col("seg"))))


def _write_manifest(spark, seq) -> str:
    """Fixture: a manifest in reversed order, in ordered part files."""
    path = scratch_path(spark, "manifest")
    names = seq.where(F.col("no") == 1).select(F.col("name").alias("seg_id"), "seg")
    names.orderBy(F.col("seg").desc()).select("seg_id").write.option("header", True).csv(path)
    return path


def _write_segment_files(spark, sf) -> tuple[str, str]:
    """Fixture: a ``name=...`` folder of several CSV part files for each segment, and a manifest."""
    seq = _segment_file_names(seq_of(spark, sf))
    path = scratch_path(spark, "segfiles")
    parts = 3 * shuffle_partitions(spark)
    sk.write_signal_csv(seq, path, ["x"], partition_by=["name"], sort_by=["name", "no"], num_files=parts)
    return path, _write_manifest(spark, seq)


def _write_flat_files(spark, sf) -> tuple[str, str]:
    """Fixture: one flat folder of ``<seg_id>.csv`` files, and a manifest."""
    seq = _segment_file_names(seq_of(spark, sf))
    path = scratch_path(spark, "flatparts")
    sk.write_signal_csv(seq.repartition("name").sortWithinPartitions("name", "no"), path, ["x"], partition_by=["name"])
    flat = scratch_path(spark, "flat")
    jvm = spark.sparkContext._jvm
    to_path = jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(to_path(flat))
    for f in fs.globStatus(to_path(path + "/name=*/part-*")):  # the files of a test folder
        fs.rename(f.getPath(), to_path(flat, f.getPath().getParent().getName()[len("name="):] + ".csv"))
    return flat, _write_manifest(spark, seq)


def q_multi_file_segments(spark, sf):
    data_dir, man_dir = _write_segment_files(spark, sf)
    manifest = fl.read_manifest(spark, man_dir)
    return finalize(fl.read_segment_files(spark, data_dir, manifest, name_col="name"))


def q_flat_segment_files(spark, sf):
    data_dir, man_dir = _write_flat_files(spark, sf)
    return finalize(fl.read_segment_files(spark, data_dir, fl.read_manifest(spark, man_dir)))


def q_continued_file_ids(spark, sf):
    """Ids of segment files in manifest order, after the last id of the signal."""
    data_dir, man_dir = _write_segment_files(spark, sf)
    rows = ingest_test(spark, data_dir, fl.read_manifest(spark, man_dir), read_signal(spark, sf), name_col="name")
    return finalize(rows.select("uid", "set", "seg", "no", "x"))


def q_streamed_segment_files(spark, sf):
    data_dir, man_dir = _write_segment_files(spark, sf)
    manifest = fl.read_manifest(spark, man_dir)
    return finalize(ingest_segment_files(spark, data_dir, manifest, scratch_path(spark, "stream-out")))


def q_train_test_union(spark, sf):
    return finalize(sq.union_train_test(seq_of(spark, sf, TAIL), TAIL).select("uid", "set", "seg", "no", "y"))


def _union(spark, sf, spec) -> DataFrame:
    return sq.union_train_test(seq_of(spark, sf, spec), spec).withColumnRenamed("set", "grp")


def q_union_profile(spark, sf):
    """Segment profiles of a union of sets, keyed by (set, segment); the train tail included."""
    return finalize(prof.segment_profile(_union(spark, sf, TAIL), "moments", keys=["grp", "seg"]))


def q_union_slice_vectors(spark, sf):
    """Slice vectors of a union of sets, keyed by (set, segment)."""
    keys = ["grp", "seg"]
    vec = sl.slice_vectors(sl.segment_slices(_union(spark, sf, TEST), TEST, keys=keys), keys=keys)
    return finalize(vec.select("grp", "seg", "slice", F.posexplode("vx").alias("k", "v")))


def q_sql_profile(spark, sf):
    """The 14-statistic profile as SQL text over the registered relation."""
    return finalize(profile_sql(spark, seq_of(spark, sf), "tails"))


def q_single_file_export(spark, sf):
    """Result CSV in one file, read back with the number of files."""
    path = sk.write_submission(_submission(spark, sf), scratch_path(spark, "single"), single_file=True)
    schema = T.StructType([T.StructField("seg_id", T.StringType()), T.StructField("time_to_failure", T.DoubleType())])
    back = spark.read.csv(path, header=True, schema=schema).withColumn("file", F.input_file_name())
    return finalize(back.agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("n"), F.round(F.sum("time_to_failure"), 4).alias("total")))


def q_sorted_stage(spark, sf):
    """A stage table sorted by (segment, position), read back in file order."""
    path = sk.write_stage(seq_of(spark, sf).select("seg", "no", "x"), scratch_path(spark, "sorted"), sort_by=["seg", "no"])
    back = sq.file_order_index(spark.read.parquet(path), name="place")
    return finalize(back.select("place", "seg", "no"))


def q_segment_lookup(spark, sf):
    """Samples of a few segments by name, from a table in which other row groups are skipped."""
    seq = seq_of(spark, sf, MODEL_SPEC, stored=False).select(F.substring(F.md5(F.col("seg").cast("string").cast("binary")), 1, 12).alias("name"), "no", "x")
    path = sk.write_lookup_table(seq, scratch_path(spark, "lookup"), "name", files=4 * shuffle_partitions(spark), keys_per_file=1000)
    return finalize(read_keys(spark.read.parquet(path), "name", LOOKUP_NAMES))


def q_parquet_roundtrip(spark, sf):
    tagged = sq.split_train_test(seq_of(spark, sf, TAIL), TAIL, keep_tail=True).select("set", F.col("set_seg").alias("seg"), "no", "x")
    path = sk.write_stage(tagged, scratch_path(spark, "pq"), partition_by=["set"], sort_by=["seg", "no"])
    back = spark.read.parquet(path)
    return finalize(back.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x_sum")))


def q_append_batches(spark, sf):
    """Two batches appended by their names; the second one is written twice, as after a failure."""
    seq = seq_of(spark, sf).select("seg", "no", "x")
    last = seq.agg(F.max("seg")).scalar()
    path = scratch_path(spark, "append")
    first, second = seq.where(F.col("seg") * 2 <= last), seq.where(F.col("seg") * 2 > last)
    for batch, part in (("first", first), ("second", second), ("second", second)):
        sk.write_batch(part, path, batch)
    back = sk.read_batches(spark, path, seq.schema)
    return finalize(back.groupBy("seg").agg(F.count(F.lit(1)).alias("n")))


def q_guarded_write(spark, sf):
    """A sink that fails if its table is present: the second write is refused, the first one's rows stay."""
    sig = read_signal(spark, sf).select("uid", "x")
    path = sk.write_stage(sig, scratch_path(spark, "guarded"), mode="errorifexists")
    try:
        sk.write_stage(sig.withColumn("x", F.lit(0.0)), path, mode="errorifexists")
        refused = 0
    except AnalysisException:
        refused = 1
    back = spark.read.parquet(path)
    return finalize(back.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x_sum")).withColumn("refused", F.lit(refused)))


# ---------------------------------------------------------------- model


def q_training_set(spark, sf):
    seq = seq_of(spark, sf)
    feats = sp.band_slice(_spectral_features(seq), "f", TEST)
    labels = lab.segment_label(seq, TEST)
    ts = mdl.training_set(feats, labels, TEST)
    return finalize(ts.select("seg", F.posexplode("features").alias("k", "v"), "label"))


def q_training_set_union(spark, sf):
    """Training set of a union of sets, by (set, segment); test labels are NULL."""
    keys = ["grp", "seg"]
    union = _union(spark, sf, TEST)
    vec = sl.concat_slices(sl.segment_slices(union, TEST, keys=keys), keys=keys)
    feats = sp.band_slice(sp.spectral_bins(sp.spectrum_scaled(vec, TEST), "vx", TEST.bins, "f"), "f", TEST)
    ts = mdl.training_set(feats, lab.segment_label(union, TEST, keys), TEST, keys=keys)
    return finalize(ts.select(*keys, F.posexplode("features").alias("k", "v"), "label"))


def q_ordered_features(spark, sf):
    """Segments numbered in the order of a statistic."""
    p = finalize(prof.segment_profile(seq_of(spark, sf, MODEL_SPEC), "moments").select("seg", "x_avg"))
    ranked = sq.row_index(p, ["x_avg", "seg"], name="pos").withColumn("pos", F.col("pos") - 1)
    return finalize(ranked.select("pos", "seg", "x_avg"))


def q_target_scaled(spark, sf):
    labels = lab.segment_label(seq_of(spark, sf), TEST).withColumnRenamed("y", "label")
    return finalize(mdl.scale_target(labels).select("seg", "label", "scaled", "back"))


def _model_frames(spark, sf):
    """Per segment: 13 features, label, set name (first 80 % of complete segments train)."""
    spec = MODEL_SPEC
    seq = seq_of(spark, sf, spec)
    split = sq.split_train_test(seq, spec).where(F.col("no") == 1).select("seg", "set")
    # scaler fitted on the training segments, applied to train and hold-out
    feats = sp.band_slice(_spectral_features(seq, spec, split.where(F.col("set") == 0)), "f", spec)
    labels = lab.segment_label(seq, spec)
    ts = mdl.training_set(feats, labels, spec).join(split, "seg")
    named = ts.withColumn("set_name", F.when(F.col("set") == 0, F.lit("train")).otherwise(F.lit("holdout")))
    return mdl.materialize(named)  # one row per segment; fit and scoring reuse it


def q_mae_metric(spark, sf):
    spec = MODEL_SPEC
    seq = seq_of(spark, sf, spec)
    split = sq.split_train_test(seq, spec).where(F.col("no") == spec.length).select("seg", "set", F.col("y").alias("label"))
    named = split.withColumn("set_name", F.when(F.col("set") == 0, F.lit("train")).otherwise(F.lit("holdout")))
    pred = mdl.mean_label_prediction(named, named.where(F.col("set") == 0))
    return finalize(mdl.error_metrics(pred, ["set_name"]))


def q_regression_fit(spark, sf):
    """Least squares: the residuals are orthogonal to the constant and to every feature."""
    ts = _model_frames(spark, sf)
    train = ts.where(F.col("set") == 0)
    model = mdl.fit_regressor(train, "linear", cut_lineage=False)
    res = mdl.predict(model, train).select("features", (F.col("label") - F.col("prediction")).alias("e"))
    terms = F.concat(F.array(F.lit(1.0)), F.col("features"))
    sums = res.select(F.posexplode(terms).alias("term", "v"), "e").groupBy("term").agg(
        F.count(F.lit(1)).alias("n_train"), F.avg(F.col("v") * F.col("e")).alias("moment"))
    return finalize(sums.select("term", "n_train", F.round("moment", 4).alias("moment")))


def q_regression_predict(spark, sf):
    """Least absolute error on the scaled target; predictions for train and hold-out beside their labels."""
    ts = _model_frames(spark, sf)
    model = fit_absolute(ts.where(F.col("set") == 0), MODEL_SPEC.n_features)
    return finalize(mdl.predict(model, ts).select("seg", "set_name", "label", "prediction"))


def _submission(spark, sf) -> DataFrame:
    """One aggregate per segment, kept as a table, gives the manifest, the label, the feature and the line."""
    spec = MODEL_SPEC
    split = sq.split_train_test(seq_of(spark, sf, spec), spec)
    feats = stage_table(split.groupBy("set", "set_seg").agg(
        F.min("seg").alias("seg"), F.avg("x").alias("x_avg"), F.max(F.when(F.col("no") == spec.length, F.col("y"))).alias("label")), "segments")
    test = feats.where(F.col("set") == 1)
    manifest = test.select(sq.segment_name("seg").alias("seg_id"), F.col("set_seg").alias("pos"))
    line = feats.where(F.col("set") == 0).agg(F.struct(F.regr_slope("label", "x_avg").alias("a"), F.regr_intercept("label", "x_avg").alias("b"))).scalar()
    preds = test.withColumn("_line", line).select(F.col("set_seg").alias("seg"), (F.col("_line.a") * F.col("x_avg") + F.col("_line.b")).alias("prediction"))
    return mdl.submission(manifest, preds)


def q_submission_join(spark, sf):
    return finalize(_submission(spark, sf).select("seg_id", "time_to_failure"))


def q_submission_export(spark, sf):
    """The result CSV as text; values rounded to 6 first so both engines format the same double."""
    sub = _submission(spark, sf).withColumn("time_to_failure", F.round("time_to_failure", 6) + F.lit(0.0))
    path = sk.write_submission(sub, scratch_path(spark, "result"))
    schema = T.StructType([T.StructField("seg_id", T.StringType()), T.StructField("time_to_failure", T.StringType())])
    return spark.read.csv(path, header=True, schema=schema)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "row_index": q_row_index,
    "sequenced_signal": q_sequenced_signal,
    "rank_in_segment": q_rank_in_segment,
    "rank_in_segment_nulls": q_rank_in_segment_nulls,
    "segment_names": q_segment_names,
    "complete_segments": q_complete_segments,
    "global_max": q_global_max,
    "moments_profile": q_moments_profile,
    "segment_quantiles": q_segment_quantiles,
    "supplier_quantiles": q_supplier_quantiles,
    "supplier_quantiles_nulls": q_supplier_quantiles_nulls,
    "selected_quantiles": q_selected_quantiles,
    "segment_profile_20": q_segment_profile_20,
    "segment_profile_14": q_segment_profile_14,
    "bucket_profile": q_bucket_profile,
    "bucket_vectors": q_bucket_vectors,
    "bucket_features": q_bucket_features,
    "profile_vector": q_profile_vector,
    "profile_scaled": q_profile_scaled,
    "scaler_params": q_scaler_params,
    "scaled_self": q_scaled_self,
    "scaled_train_test": q_scaled_train_test,
    "scaler_merge": q_scaler_merge,
    "segment_profile_rollup": q_segment_profile_rollup,
    "label_at_end": q_label_at_end,
    "window_labels": q_window_labels,
    "slice_rows": q_slice_rows,
    "slice_vectors": q_slice_vectors,
    "slice_vectors_long": q_slice_vectors_long,
    "slice_join": q_slice_join,
    "concat_slices": q_concat_slices,
    "sliding_windows": q_sliding_windows,
    "dct_spectrum": q_dct_spectrum,
    "dct_lowpass": q_dct_lowpass,
    "long_spectrum": q_long_spectrum,
    "spectral_bins": q_spectral_bins,
    "band_slice": q_band_slice,
    "stride_slice": q_stride_slice,
    "spectral_pipeline": q_spectral_pipeline,
    "window_spectra": q_window_spectra,
    "window_spectra_shared": q_window_spectra_shared,
    "window_spectral_bins": q_window_spectral_bins,
    "window_features": q_window_features,
    "csv_roundtrip": q_csv_roundtrip,
    "csv_sequence": q_csv_sequence,
    "multi_file_segments": q_multi_file_segments,
    "flat_segment_files": q_flat_segment_files,
    "continued_file_ids": q_continued_file_ids,
    "streamed_segment_files": q_streamed_segment_files,
    "train_test_union": q_train_test_union,
    "union_profile": q_union_profile,
    "union_slice_vectors": q_union_slice_vectors,
    "sql_profile": q_sql_profile,
    "single_file_export": q_single_file_export,
    "sorted_stage": q_sorted_stage,
    "segment_lookup": q_segment_lookup,
    "parquet_roundtrip": q_parquet_roundtrip,
    "append_batches": q_append_batches,
    "guarded_write": q_guarded_write,
    "training_set": q_training_set,
    "training_set_union": q_training_set_union,
    "ordered_features": q_ordered_features,
    "target_scaled": q_target_scaled,
    "mae_metric": q_mae_metric,
    "regression_fit": q_regression_fit,
    "regression_predict": q_regression_predict,
    "submission_join": q_submission_join,
    "submission_export": q_submission_export,
}
