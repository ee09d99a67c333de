"""Training set, target scaling, Spark ML regression, error metrics and the submission table.

The reference trains a single-machine network on collected features; here the same data task
(fit on features + label, score, measure MAE) stays in Spark ML, so nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import stride
from ..session import checkpoint_dir
from ..spec import SegmentSpec
from .robust import AbsoluteFit, fit_absolute


def training_set(features: DataFrame, labels: DataFrame, spec: SegmentSpec, col: str = "f", keys: Sequence[str] = ("seg",)) -> DataFrame:
    """``(keys..., features array<double>, label)``: every ``stride``-th value of the band, joined with the label.

    Keyed join (never by position) on ``seg``, or on ``("set", "seg")`` in a union of sets, each key as a long;
    segments without a label are dropped, one whose label is NULL stays.
    """
    on = [F.col(f"`{k}`").cast("long").alias(k) for k in keys]
    feats = features.select(*on, stride(col, spec.stride, spec.band_size).alias("features"))
    labs = labels.select(*on, F.col("y").alias("label"))
    return feats.join(labs, list(keys))


def target_top(df: DataFrame, label: str = "label") -> float:
    """The largest label, by which the target is divided for a fit; 1.0 if there is none or it is 0."""
    top = df.agg(F.max(label)).first()[0]
    return float(top) if top else 1.0


def scale_target(df: DataFrame, label: str = "label") -> DataFrame:
    """``scaled = label / max(label)`` and ``back = scaled * max(label)``; the max is a scalar subquery."""
    m = df.agg(F.max(label)).scalar()
    scaled = F.when(m != 0, F.col(label) / m)  # NULL rather than a division by zero (ANSI mode)
    return df.withColumn("scaled", scaled).withColumn("back", F.col("scaled") * m)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder: cuts the lineage before iterative fits."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fit_regressor(
    train: DataFrame, kind: str = "gbt", features: str = "features", label: str = "label", seed: int = 7, cut_lineage: bool = True
):
    """Fit a regressor on ``features`` (array or vector) -> ``label``.

    ``absolute``: linear fit of least absolute error (MAE, as the reference's training loss), repeatable;
    ``gbt``: gradient-boosted trees with absolute loss;
    ``linear``: least squares, deterministic; ``huber``: robust linear fit, deterministic. The fit runs several jobs over the training rows
    (one row per segment), so with ``cut_lineage`` they are checkpointed first instead of
    recomputing the feature pipeline in every job.
    """
    data = train.withColumn("_fv", array_to_vector(F.col(features))) if dict(train.dtypes)[features].startswith("array") else train.withColumn("_fv", F.col(features))
    data = data.where(F.col(label).isNotNull()).select("_fv", label)
    if cut_lineage:
        data = materialize(data)
    if kind == "absolute":
        first = train.select(F.size(features) if dict(train.dtypes)[features].startswith("array") else F.size(vector_to_array(features))).first()
        return fit_absolute(data.select(vector_to_array("_fv").alias("features"), F.col(label).alias("label")), first[0] if first else 0)
    if kind == "gbt":
        est = GBTRegressor(featuresCol="_fv", labelCol=label, lossType="absolute", maxIter=10, maxDepth=3, seed=seed)
    elif kind == "linear":
        est = LinearRegression(featuresCol="_fv", labelCol=label, regParam=0.0, solver="normal")
    elif kind == "huber":
        # robust linear fit: squared loss near zero, absolute loss in the tails
        est = LinearRegression(featuresCol="_fv", labelCol=label, loss="huber", epsilon=1.35, regParam=0.0, maxIter=100)
    else:
        raise ValueError(f"unknown regressor {kind!r}")
    return est.fit(data)


def predict(model, df: DataFrame, features: str = "features") -> DataFrame:
    """``df`` with ``prediction``."""
    if isinstance(model, AbsoluteFit):
        if dict(df.dtypes)[features].startswith("array"):
            return model.transform(df, features)
        cols = [F.col(f"`{c}`") for c in df.columns if c != "prediction"]
        return model.transform(df.withColumn("_fa", vector_to_array(F.col(features))), "_fa").select(*cols, "prediction")
    data = df.withColumn("_fv", array_to_vector(F.col(features))) if dict(df.dtypes)[features].startswith("array") else df.withColumn("_fv", F.col(features))
    return model.transform(data).drop("_fv")


def error_metrics(pred: DataFrame, by: list[str] | None = None, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean absolute and mean squared error (per ``by`` group)."""
    err = F.col(label) - F.col(prediction)
    aggs = [F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse")]
    return pred.groupBy(*by).agg(*aggs) if by else pred.agg(*aggs)


def mean_label_prediction(df: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    """Baseline prediction: the mean training label, attached as a scalar subquery."""
    return df.withColumn("prediction", train.agg(F.avg(label)).scalar())


def submission(manifest: DataFrame, predictions: DataFrame, value: str = "prediction") -> DataFrame:
    """``(seg_id, time_to_failure, pos)``: one row for each manifest entry, matched by key (position =
    test ``seg``). An entry without a prediction fails the job instead of leaving the result."""
    preds = predictions.select(F.col("seg").cast("long").alias("pos"), F.col(value).alias("time_to_failure"))
    out = manifest.select("seg_id", F.col("pos").cast("long").alias("pos")).join(preds, "pos", "left")
    missing = F.raise_error(F.concat(F.lit("no prediction for "), "seg_id")).cast("double")
    return out.withColumn("time_to_failure", F.coalesce("time_to_failure", missing))
