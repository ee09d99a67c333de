"""Spectra of segments that are too long for one row: a blocked transform in four steps.

A segment of L = A x B samples is laid out as A columns of every A-th sample. (1) Each column is transformed by itself
(B samples, to frequencies 0 .. B); (2) its values are turned by a phase that depends on column and
frequency; (3) the values are regrouped from columns to frequencies; (4) the A values of a frequency are
transformed across the columns. Step 4 gives the coefficients k = q + 2 B m of frequency q, and, mirrored,
those of 2 B - q. With A near the root of L no row or group holds more than a multiple of the root:
columns have B samples, and a regrouped row a few frequencies of one column.

Only frequencies that lead to one of the first K coefficients are regrouped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FREQUENCIES = 64  # of one column in a regrouped row


def columns_of(length: int) -> int:
    """The largest divisor of ``length`` up to its root: the number of columns. 1 for a prime length."""
    return next(a for a in range(int(length**0.5), 0, -1) if length % a == 0)


def _column_spectrum(batches, a_count: int, length: int, wanted: np.ndarray, n_keys: int):
    """Steps 1 and 2 for ``(keys..., a, xs)``, cut to rows of a few wanted frequencies."""
    rows = length // a_count
    starts = range(0, len(wanted), FREQUENCIES)
    for b in batches:
        if not b.num_rows:
            continue
        a = b.column(n_keys).to_numpy()
        x = b.column(n_keys + 1).flatten().to_numpy(zero_copy_only=False).reshape(len(a), rows)
        y = np.fft.rfft(x, 2 * rows, axis=1)[:, wanted] * np.exp(-1j * np.pi / length * (a[:, None] * wanted[None, :]))
        for part, s in enumerate(starts):
            cut = np.ascontiguousarray(y[:, s : s + FREQUENCIES])
            offs = pa.array(np.arange(0, cut.size + 1, cut.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(n_keys)], pa.array(np.full(len(a), part, np.int32)), b.column(n_keys),
                 pa.ListArray.from_arrays(offs, pa.array(cut.real.ravel())), pa.ListArray.from_arrays(offs, pa.array(cut.imag.ravel()))],
                names=[*b.schema.names[:n_keys], "part", "a", "re", "im"])


def _across(table: pa.Table, a_count: int, length: int, keep: int, wanted: np.ndarray, n_keys: int) -> pa.Table:
    """Step 4 for one segment and a few frequencies: ``(keys..., k, c)``; nothing if a column is missing."""
    names = [*table.schema.names[:n_keys], "k", "c"]
    rows = length // a_count
    a = table.column("a").to_numpy()
    if len(a) != a_count:
        k, c = np.zeros(0, np.int64), np.zeros(0)
    else:
        flat = [table.column(x).combine_chunks().flatten().to_numpy().reshape(len(a), -1)[np.argsort(a)] for x in ("re", "im")]
        d = np.fft.fft(flat[0] + 1j * flat[1], axis=0)  # [m, frequency]
        s = table.column("part")[0].as_py() * FREQUENCIES
        q = wanted[s : s + FREQUENCIES]
        m = np.arange(keep // (2 * rows) + 1)
        direct, mirrored = q[None, :] + 2 * rows * m[:, None], 2 * rows - q[None, :] + 2 * rows * m[:, None]
        use, other = direct < keep, (mirrored < keep) & (q > 0) & (q < rows)
        k = np.concatenate([direct[use], mirrored[other]])
        z = np.concatenate([d[m[:, None] % a_count, np.arange(len(q))][use], np.conj(d[(a_count - 1 - m[:, None]) % a_count, np.arange(len(q))])[other]])
        c = np.sqrt(np.where(k == 0, 1.0, 2.0) / length) * (z * np.exp(-0.5j * np.pi * k / length)).real
    keys = [pa.array([table.column(i)[0].as_py()] * len(k), table.schema.field(i).type) for i in range(n_keys)]
    return pa.table([*keys, pa.array(k.astype(np.int64)), pa.array(c)], names=names)


def blocked_spectrum(
    seq: DataFrame, length: int, keep: int, value: str = "x", keys: Sequence[str] = ("seg",), columns: int | None = None
) -> DataFrame:
    """``(keys..., k, c)``: the first ``keep`` coefficients of the orthonormal DCT-II of each segment of ``length`` samples.

    Equals :func:`sigspan.operators.spectral.dct` of the whole vector. ``seq`` numbers the samples of a segment 1 ..
    ``length`` in ``no``; later positions are left out, and segments that lack a position have no
    spectrum. ``columns`` must divide ``length``; a length without a divisor near its root gives long columns.
    """
    a_count = columns or columns_of(length)
    if length % a_count or not 0 < keep <= length:
        raise ValueError("columns must divide the length, and keep lie within it")
    keys, rows = list(keys), length // a_count
    q = np.arange(rows + 1)
    wanted = q[(q < keep) | (2 * rows - q < keep)]
    at = F.col("no").cast("long") - 1
    samples = seq.where((F.col("no") >= 1) & (F.col("no") <= length)).select(
        *keys, (at % a_count).cast("int").alias("a"), F.expr(f"(cast(no as bigint) - 1) div {a_count}").cast("int").alias("b"), F.col(value).cast("double").alias("v"))
    cols = samples.groupBy(*keys, "a").agg(F.array_sort(F.collect_list(F.struct("b", "v"))).alias("_s")).where(F.size("_s") == rows)
    cols = cols.select(*keys, "a", F.transform("_s", lambda e: e["v"]).alias("xs"))
    fields = [cols.schema[k] for k in keys]
    list_type = T.ArrayType(T.DoubleType())
    turned_type = T.StructType([*fields, T.StructField("part", T.IntegerType()), T.StructField("a", T.IntegerType()), T.StructField("re", list_type), T.StructField("im", list_type)])
    first: Callable = partial(_column_spectrum, a_count=a_count, length=length, wanted=wanted, n_keys=len(keys))
    turned = cols.mapInArrow(first, turned_type)
    last: Callable = partial(_across, a_count=a_count, length=length, keep=keep, wanted=wanted, n_keys=len(keys))
    out_type = T.StructType([*fields, T.StructField("k", T.LongType()), T.StructField("c", T.DoubleType())])
    return turned.groupBy(*keys, "part").applyInArrow(lambda t: last(t), out_type)
