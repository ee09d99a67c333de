"""Approximate nearest neighbours by shifted space-filling curves.

Method. Every vector is projected to ``DIMS`` dimensions, several times, each time with its own
orthonormal projection and shift, and gets the Hilbert index of its projected point: one ordering
of all vectors for each curve. The orderings are made by range partitioning in Spark and cut into
blocks of neighbouring keys. A query looks at the window of keys around its own on every curve;
the blocks of its windows are merged, and all vectors met are ranked by the exact inner product.
Equal vectors are merged first and take one place of a curve, however many rows hold them: distinct
vectors are searched, each with its smallest ids (one more than asked, as a row never answers
itself), and the answers of a vector are then spelled out for all of its queries.
For inner products on vectors of different length the points get one more coordinate,
sqrt(M^2 - |x|^2), which makes the nearest point the one with the largest product.

``WINDOW`` is the share of all keys in a window. On directions without structure (the tables here
are such) near vectors differ in nearly every coordinate, curves keep few of them close, and a
recall of 0.9 takes wide windows; on clustered vectors narrow windows do. See README for the
recall measured.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
without id, neither ask nor answer; vectors of another length than the query's are not
candidates; equal vectors are candidates each, ties go to the smaller id; fewer candidates than
asked give all of them; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sequence import row_index
from .common import batch, read, stage

CURVES, DIMS, BITS = 6, 6, 10
WINDOW = 0.3
BLOCK_ROWS = 8192
LEAST_BLOCKS = 16
LEAST_WINDOW = 4  # x nearest: least places on each side of a query, so small groups are searched whole
NEAREST, QUERY_EVERY, SEED = 20, 20, 11


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, v)``: vectors that can be compared, components in double precision."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    )


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of integer points (rows) of a grid of ``2**bits`` cells a side.

    The points' bits are transposed in place (Skilling's transform), then interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(v: np.ndarray, top: float, curve: int, dims: int = DIMS, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Keys of rows on one curve; ``top`` is the largest norm of all vectors."""
    aug = np.sqrt(np.maximum(top * top - (v * v).sum(1), 0))
    x = np.concatenate([v, aug[:, None]], 1) / top
    r = np.random.default_rng([seed, curve, x.shape[1]])
    k = min(dims, x.shape[1])
    basis = np.linalg.qr(r.normal(size=(x.shape[1], k)))[0]
    # projections of unit vectors lie within a few times 1/sqrt(d); the shift moves the grid
    y = (x @ basis) * np.sqrt(x.shape[1]) / 8 + 0.5 + r.uniform(-0.1, 0.1, k)
    return hilbert(np.clip((y * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1), bits)


def merged(vectors: DataFrame, is_query: str, k: int) -> DataFrame:
    """``(rep, v, asks, ids)``: each distinct vector once, with its ``k`` smallest ids in order and
    whether a query holds it; ``rep`` numbers them in the order of their smallest ids."""
    rows = vectors.groupBy("vec_id", "v").agg(F.lit(1)).select("vec_id", "v", F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"))
    # limited before the shuffle too, so a vector of many rows sends few to its task
    low = F.row_number().over(Window.partitionBy("v", "asks").orderBy("vec_id"))
    rows = rows.withColumn("low", low).filter(F.col("low") <= k)
    ids = F.slice(F.array_sort(F.collect_list("vec_id")), 1, k)
    groups = rows.groupBy("v").agg(F.max("asks").alias("asks"), ids.alias("ids")).withColumn("first", F.col("ids")[0])
    return row_index(groups, ["first", "v"], name="rep", keep=["v", "asks", "ids"])


def search(
    vectors: DataFrame, is_query: str = f"vec_id % {QUERY_EVERY} = 0", nearest: int = NEAREST,
    curves: int = CURVES, window: float = WINDOW, block_rows: int = BLOCK_ROWS, least_blocks: int = LEAST_BLOCKS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for :func:`usable` vectors; queries by a SQL condition."""
    k = nearest + 1  # a query's own vector is met too, and its own id left out last
    groups = stage(merged(vectors, is_query, k), "distinct-vectors")
    facts = groups.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"))
    # one row for each vector length: a few numbers
    sizes = {r["d"]: (r["n"], float(np.sqrt(r["top"]))) for r in facts.collect()}
    tops = {d: t for d, (_, t) in sizes.items()}
    schema = "d int, curve int, key bigint, rep bigint, asks boolean, v array<double>"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.diff(b.column(2).offsets.to_numpy()) if b.num_rows else np.zeros(0, int)
            for d in np.unique(lengths):
                part = b.filter(pa.array(lengths == d))
                v = matrix(part.column(2))
                for c in range(curves):
                    yield batch({
                        "d": pa.array(np.full(len(v), d, np.int32)), "curve": pa.array(np.full(len(v), c, np.int32)),
                        "key": pa.array(curve_keys(v, tops[d], c)), "rep": part.column(0), "asks": part.column(1), "v": part.column(2),
                    })

    keys = row_index(groups.select("rep", "asks", "v").mapInArrow(keyed, schema), ["d", "curve", "key", "rep"])
    # each (length, curve) holds n consecutive places of the order
    before = 0
    first, count = F.lit(0), F.lit(1)
    for d in sorted(sizes):
        first = F.when(F.col("d") == d, F.lit(before)).otherwise(first)
        count = F.when(F.col("d") == d, F.lit(sizes[d][0])).otherwise(count)
        before += sizes[d][0] * curves
    keys = keys.withColumn("n", count.cast("long")).withColumn("place", F.col("idx") - 1 - first - F.col("curve") * F.col("n"))
    blocks = F.greatest(F.lit(least_blocks), F.ceil(F.col("n") / block_rows))
    keys = keys.withColumn("size", F.ceil(F.col("n") / blocks).cast("long"))
    half = F.greatest(F.ceil(F.col("n") * (window / 2)), F.lit(LEAST_WINDOW * nearest)).cast("long")
    lo = F.greatest(F.lit(0), F.least(F.col("place") - half, F.col("n") - 2 * half))
    hi = F.least(F.col("n") - 1, F.greatest(F.col("place") + half, 2 * half))
    block = lambda c: F.floor(c / F.col("size")).cast("int")
    at = F.col("rep"), F.col("v")
    answers = keys.select("d", "curve", block(F.col("place")).alias("block"), F.lit(False).alias("asks"), *at)
    asks = keys.filter("asks").select("d", "curve", F.explode(F.sequence(block(lo), block(hi))).alias("block"), F.lit(True).alias("asks"), *at)
    sides = answers.unionByName(asks).repartition("d", "curve", "block").sortWithinPartitions("d", "curve", "block", "asks", "rep")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, held = None, None, None
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            code = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], 1)
            cut = np.append(0, np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1)
            for s, e in zip(cut, np.append(cut[1:], b.num_rows), strict=True):
                part, here = b.slice(s, e - s), tuple(code[s, :3])
                own, v = part.column(4).to_numpy(), matrix(part.column(5))
                if not code[s, 3]:  # vectors of a block come first, at most block_rows or so
                    parts = [*parts, (own, v)] if here == place else [(own, v)]
                    place, ids = here, None
                    continue
                if here != place:
                    parts, place, ids = [], here, None
                    continue
                if ids is None and parts:
                    ids, held = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                for q in range(0, len(own) if ids is not None else 0, 512):
                    yield top_of_block(own[q : q + 512], v[q : q + 512], ids, held, k)

    found = sides.mapInArrow(ranked, "asker bigint, rep array<bigint>, score array<double>")
    found = found.select("asker", F.explode(F.arrays_zip("rep", "score")).alias("x")).select("asker", "x.rep", "x.score").distinct()
    # of k distinct vectors in the order of score and smallest id, at most the asker's own gives a query nothing
    order = Window.partitionBy("asker").orderBy(F.col("score").desc(), "rep")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")
    found = found.join(groups.select("rep", "ids"), "rep").select("asker", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("asker").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    lists = found.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("list"))
    lists = groups.select("rep", "v").join(lists, F.col("rep") == F.col("asker")).select("v", "list")
    asking = vectors.filter(is_query).select(F.col("vec_id").alias("query_id"), "v").distinct().join(lists, "v")
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, nearest)
    found = asking.select("query_id", F.explode(others).alias("x")).select("query_id", "x.vec_id", "x.score").distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def top_of_block(own: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pa.RecordBatch:
    """The ``k`` nearest of a block for each query (itself too), ties to the smaller number.

    A matrix product finds the contenders (with a margin for its rounding); their scores are then
    summed in the order of the components, alike wherever a vector stands.
    """
    s = q @ v.T
    if len(ids) > k:
        bar = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
    else:
        bar = np.full(len(q), -np.inf)
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(bar), bar, 0)))
    row, col = np.nonzero(s >= (bar - slack)[:, None])
    exact = np.empty(len(row))
    for a in range(0, len(row), 1 << 16):
        r, c = row[a : a + (1 << 16)], col[a : a + (1 << 16)]
        exact[a : a + (1 << 16)] = np.einsum("ij,ij->i", q[r], v[c])
    order = np.lexsort((ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    start = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - start[row] < k
    row, col, exact = row[keep], col[keep], exact[keep]
    offs = pa.array(np.searchsorted(row, np.arange(len(q) + 1)), pa.int32())
    return batch({"asker": pa.array(own), "rep": pa.ListArray.from_arrays(offs, pa.array(ids[col])), "score": pa.ListArray.from_arrays(offs, pa.array(exact))})


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(usable(read(spark, sf_dir, "embeddings")))


SQL = {}
