"""The staged feature flow, end to end, with parquet stage tables between stages.

Stages (each a function of DataFrames, plus ``run_stages`` that wires them to files):

1. ingest: a signal CSV (``x, y`` in time order) becomes the train set; a directory of
   per-segment CSVs ordered by a manifest becomes the test set, ids continuing after the train
   ids and labels NULL;
2. spectral features: segment vectors -> DCT -> low pass -> scaler fitted on train -> bins -> band;
3. statistics: the 20- and 14-statistic profiles, each scaled on its own set;
4. labels: ``y`` at the end of each segment, and at the end of every sliding window;
5. window features: per-window spectra with one scaler per window position fitted on train,
   bins, the bands of all windows concatenated; bucket statistics of complete segments;
6. model: every ``stride``-th band value ⋈ label -> Spark ML regressor -> MAE on train and
   hold-out -> predictions for the test segments, written in manifest order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import PROFILE_14, PROFILE_20
from ..operators import labels as lab
from ..operators import model as mdl
from ..operators import profile as prof
from ..operators import scaler as sc
from ..operators import sequence as sq
from ..operators import slices as sl
from ..operators import spectral as sp
from ..sources import files as fl
from ..sources import sinks as sk
from ..spec import SegmentSpec

Store = Callable[[DataFrame, str], DataFrame]  # (frame, table name) -> the frame, or the table it was written to


def ingest_train(spark: SparkSession, train_csv: str, spec: SegmentSpec) -> DataFrame:
    """Train signal CSV -> ``(uid, set, seg, no, name, x, y)``; ``uid`` = 0-based file position."""
    indexed = fl.read_signal_csv_indexed(spark, train_csv).withColumnRenamed("uid", "idx")
    seq = sq.assign_segments(indexed, spec)
    return seq.select(
        (F.col("idx") - 1).alias("uid"),
        F.lit(0).alias("set"),
        "seg",
        "no",
        sq.segment_name("seg").alias("name"),
        "x",
        "y",
    )


def ingest_test(spark: SparkSession, test_dir: str, manifest: DataFrame, train: DataFrame, name_col: str | None = None) -> DataFrame:
    """Per-segment CSVs -> test rows: ``seg`` = manifest position, ``uid`` after the last train id."""
    segs = fl.read_segment_files(spark, test_dir, manifest, name_col=name_col)
    numbered = segs.join(sq.group_offsets(segs, "seg", "no", "_off"), "seg")
    max_train_uid = train.agg(F.max("uid")).scalar()
    return numbered.select(
        (max_train_uid + F.col("_off") + F.col("no")).alias("uid"),
        F.lit(1).alias("set"),
        "seg",
        "no",
        "name",
        "x",
        F.lit(None).cast("double").alias("y"),
    )


def _lazy(df: DataFrame, name: str) -> DataFrame:
    return df


def slice_table(train: DataFrame, test: DataFrame, spec: SegmentSpec, store: Store = _lazy) -> tuple[DataFrame, DataFrame]:
    """``(seg, slices)`` of both sets, the one source of spectra and window spectra."""
    return (store(sl.segment_slices(train, spec), "train.vector"), store(sl.segment_slices(test, spec), "test.vector"))


def spectral_features(
    slices_train: DataFrame, slices_test: DataFrame, spec: SegmentSpec, store: Store = _lazy
) -> tuple[DataFrame, DataFrame]:
    """``(seg, f)`` band of the spectral bins for both sets; the scaler is fitted on train only.

    ``store`` keeps each step as a table: the train spectra before scaling (fit and apply read them),
    the scaled spectra, the bins and their band.
    """
    low = [sp.dct(sl.concat_slices(s), "vx", keep=spec.dct_keep) for s in (slices_train, slices_test)]
    low[0] = store(low[0], "train.vector.low")
    stds = sc.fit_scaler(low[0], "vx")
    out = []
    for name, spectra in zip(("train", "test"), low):
        scaled = store(sc.apply_scaler(spectra, "vx", stds), f"{name}.vector.dct")
        binned = store(sp.spectral_bins(scaled, "vx", spec.bins, "f").drop("vx"), f"{name}.bins")
        out.append(store(sp.band_slice(binned, "f", spec), f"{name}.fbin"))
    return out[0], out[1]


def stat_features(seq: DataFrame, name: str = "train", store: Store = _lazy) -> tuple[DataFrame, DataFrame]:
    """``(seg, stat)`` of the 20- and of the 14-statistic profile, each scaled on its own set.

    One aggregation computes the statistics of both profiles. With a ``store`` it runs once, and the
    scaler fits read its table (one row a segment).
    """
    both = store(prof.segment_profile(seq, "both"), f"{name}.profile")
    out = []
    for stats in (PROFILE_20, PROFILE_14):
        names = [s[0] for s in stats]
        vec = prof.assemble(both, names, "stat", handle_invalid="keep").select("seg", "stat")
        out.append(sc.standard_scale(vec, "stat"))
    return out[0], out[1]


def window_features(
    slices_train: DataFrame, slices_test: DataFrame, spec: SegmentSpec, store: Store = _lazy
) -> tuple[DataFrame, DataFrame]:
    """``(seg, f)`` of ``windows * band`` values; one scaler per window position, fitted on train."""
    low = [sp.dct(sl.sliding_windows(s, spec), "vx", keep=spec.win_dct_keep) for s in (slices_train, slices_test)]
    low[0] = store(low[0], "train.win.vector.low")
    stds = sc.fit_scaler(low[0], "vx", by=["win"])
    out = []
    for name, spectra in zip(("train", "test"), low):
        scaled = store(sc.apply_scaler(spectra, "vx", stds, by=["win"], groups_bound=spec.n_windows), f"{name}.win.vector.dct")
        binned = store(sp.window_bins(scaled, spec, col="vx"), f"{name}.win.bins")
        out.append(store(sp.window_features(binned, spec), f"{name}.win.fbin"))
    return out[0], out[1]


def bucket_features(train: DataFrame, spec: SegmentSpec) -> DataFrame:
    """Bucket statistics of complete train segments as 4 vectors, each scaled on the set."""
    complete = train.join(sq.complete_segments(train, spec).select("seg"), "seg", "left_semi")
    vec = prof.bucket_vectors(prof.bucket_profile(complete, spec))
    raw = [f"stx{i}" for i in range(1, 5)]
    return sc.standard_scale(vec, raw, [f"stxn{i}" for i in range(1, 5)]).drop(*raw)


@dataclass
class ModelResult:
    metrics: DataFrame  # set_name, mae, mse
    predictions: DataFrame  # seg, prediction (test)
    submission: DataFrame  # seg_id, pos, time_to_failure


def fit_and_score(
    train_f: DataFrame,
    train_labels: DataFrame,
    test_f: DataFrame,
    manifest: DataFrame,
    spec: SegmentSpec,
    kind: str = "gbt",
    holdout_fraction: float = 0.2,
) -> ModelResult:
    """Fit on the first segments of train, report MAE on train and hold-out, predict test."""
    ts = mdl.materialize(mdl.training_set(train_f, train_labels, spec))
    n = ts.agg(F.max("seg")).scalar()
    cut = F.floor((n + 1) * F.lit(1.0 - holdout_fraction).cast("decimal(10,6)"))
    named = ts.withColumn("set_name", F.when(F.col("seg") < cut, F.lit("train")).otherwise(F.lit("holdout")))
    # the target is divided by its largest value for the fit, and predictions are multiplied by it
    train = named.where(F.col("set_name") == "train")
    top = mdl.target_top(train)
    model = mdl.fit_regressor(train.withColumn("label", F.col("label") / top), kind, cut_lineage=False)

    def predicted(df: DataFrame) -> DataFrame:
        return mdl.predict(model, df).withColumn("prediction", F.col("prediction") * top)

    metrics = mdl.error_metrics(predicted(named), ["set_name"])
    test_rows = mdl.training_set(test_f, test_f.select("seg", F.lit(None).cast("double").alias("y")), spec)
    preds = predicted(test_rows).select("seg", "prediction")
    return ModelResult(metrics, preds, mdl.submission(manifest, preds))


def run_stages(
    spark: SparkSession,
    train_csv: str,
    test_dir: str,
    manifest_csv: str,
    out_dir: str,
    spec: SegmentSpec,
    kind: str = "gbt",
    name_col: str | None = None,
) -> ModelResult:
    """Run every stage, writing each stage table below ``out_dir``; returns the model result.

    Each later stage reads the tables of the earlier ones: the samples of a set are collected to
    slices once, aggregated to profiles once, transformed once.
    """
    out = out_dir.rstrip("/")
    manifest = fl.read_manifest(spark, manifest_csv)
    # each set is written once bucketed by segment: every stage below groups by seg shuffle-free
    train = sk.write_segment_table(ingest_train(spark, train_csv, spec), f"{out}/train.parquet")
    test = sk.write_segment_table(ingest_test(spark, test_dir, manifest, train, name_col), f"{out}/test.parquet")

    def store(df: DataFrame, name: str) -> DataFrame:
        return spark.read.schema(df.schema).parquet(sk.write_stage(df, f"{out}/{name}.parquet"))

    slices = slice_table(train, test, spec, store)
    f_train, f_test = spectral_features(*slices, spec, store)
    labels = {}
    for name, seq in (("train", train), ("test", test)):
        s20, s14 = stat_features(seq, name, store)
        store(s20, f"{name}.stat")
        store(s14, f"{name}.stat.2")
        labels[name] = store(lab.segment_label(seq, spec), f"{name}.target")
    if spec.win_bins is not None:
        window_features(*slices, spec, store)
        store(lab.window_labels(train, spec), "train.win.target")
        store(bucket_features(train, spec), "train.win.stat")

    result = fit_and_score(f_train, labels["train"], f_test, manifest, spec, kind)
    sk.write_submission(result.submission, f"{out}/result")
    return result
