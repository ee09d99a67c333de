"""Spectra: orthonormal DCT-II, low pass, overlapped bins, band and stride, spectral pipelines.

The DCT is Spark ML's ``DCT`` transformer (JVM, FFT based, per row). Vectors are kept as
``array<double>`` between stages and converted to ML vectors only around the ML stages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import DCT, StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import band, checked_prefix, overlapped_bins, stride
from ..spec import BinSpec, SegmentSpec
from .scaler import apply_scaler, fit_scaler


def dct(df: DataFrame, col: str, out: str | None = None, keep: int | None = None) -> DataFrame:
    """Orthonormal DCT-II of an array column: ``c_k = a_k sum_n x_n cos(pi/N (n + 1/2) k)``.

    ``keep`` retains the first coefficients (low pass) and fails on shorter inputs.
    """
    out = out or col
    tmp_in, tmp_out = f"_{col}_vec", f"_{col}_dct"
    vec = df.withColumn(tmp_in, array_to_vector(F.col(col)))
    res = DCT(inverse=False, inputCol=tmp_in, outputCol=tmp_out).transform(vec)
    coeffs = vector_to_array(F.col(tmp_out))
    if keep is not None:
        coeffs = checked_prefix(coeffs, keep, "spectrum")
    keep_cols = [F.col(f"`{c}`") for c in df.columns if c != out]
    return res.select(*keep_cols, coeffs.alias(out))


def spectral_bins(df: DataFrame, col: str, bins: BinSpec, out: str = "f") -> DataFrame:
    return df.withColumn(out, overlapped_bins(col, bins))


def band_slice(df: DataFrame, col: str, spec: SegmentSpec, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, band(col, spec.band_start, spec.band_size))


def stride_slice(df: DataFrame, col: str, spec: SegmentSpec, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, stride(col, spec.stride, spec.band_size))


def spectrum_scaled(
    vectors: DataFrame, spec: SegmentSpec, col: str = "vx", fit_on: DataFrame | None = None, out: str = "vx"
) -> DataFrame:
    """DCT -> low pass -> std scaling (fitted on ``fit_on``, default the input), lazily."""
    spec_df = dct(vectors, col, "_spec", keep=spec.dct_keep)
    fit_src = dct(fit_on, col, "_spec", keep=spec.dct_keep) if fit_on is not None else spec_df
    stds = fit_scaler(fit_src, "_spec")
    return apply_scaler(spec_df, "_spec", stds, out).drop(*{col, "_spec"} - {out})


def fit_spectral_pipeline(train: DataFrame, spec: SegmentSpec, col: str = "vx") -> PipelineModel:
    """Spark ML pipeline DCT -> slicer (first K) -> StandardScaler(withStd, no mean), fitted on ``train``.

    ``train`` holds ``col`` as an ML vector (see :func:`as_vector`). Fitting runs one job.
    """
    stages = [
        DCT(inverse=False, inputCol=col, outputCol="_dct"),
        VectorSlicer(inputCol="_dct", outputCol="_low", indices=list(range(spec.dct_keep))),
        StandardScaler(inputCol="_low", outputCol="_scaled", withStd=True, withMean=False),
    ]
    return Pipeline(stages=stages).fit(train)


def as_vector(df: DataFrame, col: str = "vx") -> DataFrame:
    return df.withColumn(col, array_to_vector(F.col(col)))


def apply_spectral_pipeline(model: PipelineModel, vectors: DataFrame, spec: SegmentSpec, col: str = "vx") -> DataFrame:
    """Transform with a fitted pipeline and bin: ``(keys..., f array<double>)`` with ``n_bins`` values."""
    res = model.transform(vectors).withColumn("_spec", vector_to_array(F.col("_scaled")))
    res = res.drop(col, "_dct", "_low", "_scaled")
    return spectral_bins(res, "_spec", spec.bins, "f").drop("_spec")


def window_spectra(
    windows: DataFrame, spec: SegmentSpec, col: str = "vx", fit_on: DataFrame | None = None, out: str = "fn"
) -> DataFrame:
    """Per window: DCT, first ``win_dct_keep`` coefficients, a std scaler per window position.

    All window positions are fitted in one grouped aggregate (one row per position, broadcast).
    """
    spec_df = dct(windows, col, "_spec", keep=spec.win_dct_keep)
    fit_src = dct(fit_on, col, "_spec", keep=spec.win_dct_keep) if fit_on is not None else spec_df
    stds = fit_scaler(fit_src, "_spec", by=["win"])
    res = apply_scaler(spec_df, "_spec", stds, out, by=["win"], groups_bound=spec.n_windows)
    return res.drop(col, "_spec") if col != out else res.drop("_spec")


def window_bins(win_spectra: DataFrame, spec: SegmentSpec, col: str = "fn", out: str = "f") -> DataFrame:
    return spectral_bins(win_spectra, col, spec.win_bins, out).drop(col)


def window_features(win_bins: DataFrame, spec: SegmentSpec, col: str = "f", keys: Sequence[str] = ("seg",)) -> DataFrame:
    """Band of every window, concatenated in window order: ``(seg, f)`` of ``windows * band`` values."""
    keys = list(keys)
    banded = win_bins.select(*keys, "win", band(col, spec.band_start, spec.band_size).alias("_b"))
    packed = banded.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("win", "_b"))).alias("_w"), F.count(F.lit(1)).alias("_nw")
    )
    return packed.where(F.col("_nw") == spec.n_windows).select(
        *keys, F.flatten(F.transform("_w", lambda e: e["_b"])).alias("f")
    )
