"""Spectra of overlapping windows from slices that are transformed once and shared.

A window is ``win_slices`` consecutive slices, so an inner slice lies in several windows. Its part of a
window's DCT-II is its own partial sum ``P(k) = sum_i x_i exp(-i pi i k / N)``, turned by a phase that depends on
its offset in the window alone. Windows of equal length N share the partial sums of their slices. Only the
first ``win_dct_keep`` coefficients are computed: a chirp transform takes n samples to K frequencies with
FFTs of n + K points, not 2 N.

Windows differ in length where slices do (the first slice of an inclusive cut is one sample shorter, a gap
shortens any): a slice is transformed once for each such length, at most ``win_slices`` times.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import SegmentSpec
from .scaler import apply_scaler, fit_scaler

OUT_VALUES = 1 << 20  # coefficients in an output batch


@lru_cache(maxsize=8)
def _chirp(n: int, total: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Phases ``exp(-i pi j^2 / (2 total))``, and the transformed kernel for ``n`` samples and ``keep`` frequencies."""
    j = np.arange(max(n, keep), dtype=np.int64)
    phase = np.exp(-0.5j * np.pi / total * (j * j % (4 * total)))
    size = 1 << (n + keep - 1).bit_length()
    kernel = np.zeros(size, complex)
    kernel[:keep] = np.conj(phase[:keep])
    kernel[size - n + 1 :] = np.conj(phase[1:n][::-1])
    return phase, np.fft.fft(kernel)


def partial_sums(x: np.ndarray, total: int, keep: int) -> np.ndarray:
    """``sum_i x_i exp(-i pi i k / total)`` for ``k < keep``."""
    n = len(x)
    if not n:
        return np.zeros(keep, complex)
    phase, kernel = _chirp(n, total, keep)
    return np.fft.ifft(np.fft.fft(x * phase[:n], len(kernel)) * kernel)[:keep] * phase[:keep]


def window_coefficients(slices: Sequence[np.ndarray], win_slices: int, keep: int) -> list[np.ndarray]:
    """First ``keep`` coefficients of the orthonormal DCT-II of every window, in order."""
    k = np.arange(keep, dtype=np.int64)
    sums: dict[tuple[int, int], np.ndarray] = {}
    out = []
    for j in range(len(slices) - win_slices + 1):
        total = sum(len(s) for s in slices[j : j + win_slices])
        if total < keep:
            raise ValueError(f"spectrum shorter than {keep} elements")
        z, offset = np.zeros(keep, complex), 0
        for i in range(j, j + win_slices):
            if (i, total) not in sums:
                sums[i, total] = partial_sums(slices[i], total, keep)
            # offset and the half sample of the DCT in one phase
            z += sums[i, total] * np.exp(-0.5j * np.pi / total * ((2 * offset + 1) * k % (4 * total)))
            offset += len(slices[i])
        out.append(z.real * np.sqrt(np.where(k == 0, 1.0, 2.0) / total))
        sums = {key: v for key, v in sums.items() if key[0] > j}
    return out


def _transform(batches: Iterator[pa.RecordBatch], win_slices: int, n_windows: int, keep: int, n_keys: int) -> Iterator[pa.RecordBatch]:
    step = max(1, OUT_VALUES // (n_windows * keep))
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            found = []
            for row in part.column(n_keys):
                slices = [np.asarray(s.values.to_numpy(zero_copy_only=False), float) for s in row.values]
                if len(slices) != n_windows + win_slices - 1:
                    raise ValueError(f"a segment has {len(slices)} slices, not {n_windows + win_slices - 1}")
                found += window_coefficients(slices, win_slices, keep)
            rows = pa.array(np.repeat(np.arange(part.num_rows), n_windows))
            offsets = pa.array(np.arange(0, len(found) * keep + 1, keep, dtype=np.int32))
            win = pa.array(np.tile(np.arange(n_windows, dtype=np.int32), part.num_rows))
            values = pa.array(np.concatenate(found))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(i).take(rows) for i in range(n_keys)], win, pa.ListArray.from_arrays(offsets, values)],
                names=[*b.schema.names[:n_keys], "win", "c"])


def shared_window_spectra(seg_slices: DataFrame, spec: SegmentSpec, keys: Sequence[str] = ("seg",)) -> DataFrame:
    """``(keys..., win, c)``: the first ``win_dct_keep`` DCT-II coefficients of every sliding window.

    Equals :func:`sigspan.operators.spectral.dct` of :func:`sigspan.operators.slices.sliding_windows`.
    ``seg_slices`` holds ``slices``, all of a segment's; a segment with another number of slices, or a window
    shorter than ``win_dct_keep``, fails. A null sample counts as NaN and makes its windows NaN. Tables without
    rows give none.
    """
    keys = list(keys)
    source = seg_slices.select(*keys, F.col("slices").cast("array<array<double>>").alias("slices"))
    schema = T.StructType([*[source.schema[k] for k in keys], T.StructField("win", T.IntegerType()), T.StructField("c", T.ArrayType(T.DoubleType()))])
    run = partial(_transform, win_slices=spec.win_slices, n_windows=spec.n_windows, keep=spec.win_dct_keep, n_keys=len(keys))
    return source.mapInArrow(run, schema)


def scaled_window_spectra(
    seg_slices: DataFrame, spec: SegmentSpec, fit_on: DataFrame | None = None, out: str = "fn", keys: Sequence[str] = ("seg",)
) -> DataFrame:
    """As :func:`sigspan.operators.spectral.window_spectra`, from slices: a std scaler for each window position."""
    found = shared_window_spectra(seg_slices, spec, keys)
    fit_src = shared_window_spectra(fit_on, spec, keys) if fit_on is not None else found
    stds = fit_scaler(fit_src, "c", by=["win"])
    res = apply_scaler(found, "c", stds, out, by=["win"], groups_bound=spec.n_windows)
    return res if out == "c" else res.drop("c")
