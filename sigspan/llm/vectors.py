"""Near-duplicates among embeddings by PCA-ordered tiled comparison.

Method. Equal vectors are merged first. The distinct unit vectors are rotated to the principal
axes of all of them, largest first (one pass sums the moment matrix, d x d numbers reach the
driver). They are ordered by the first axis and cut into tiles of ``TILE`` rows. Two tiles meet in
one task unless their angles on the first axis alone keep every cosine below the threshold. In a
task leading dimensions are accumulated first; a pair goes on only while its partial product plus
the product of the two suffix norms can still reach the threshold, so most pairs end after the
first segment. Every pair of distinct vectors is compared, or shut out by a bound: no link is lost.

A tile pair holds at most 2 x ``TILE`` vectors; links leave a task as counts for each vector and as a
spanning forest, never as pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing (``n_links`` 0, their own component); vectors of different length do not link; a row
without id takes no part (0 links, null component, not kept); rows that repeat an id are vectors
of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sequence import row_index
from .common import Forest, batch, components, read, runs, stage
from .curves import matrix, usable

COSINE = 0.95
TILE = 4096
FIRST_DIMS = 16
INNER = 512


def principal_axes(distinct: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the rotation to principal axes, largest first (columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, v in by_length(b.column(0)):
                u = v / np.linalg.norm(v, axis=1)[:, None]
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, m in sums.items():
            i, j = np.triu_indices(d)
            yield batch({"d": pa.array(np.full(len(i), d, np.int32)), "i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "s": pa.array(m[i, j])})

    cells = distinct.select("v").mapInArrow(run, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = {}
    for d, g in cells.groupby("d"):
        m = np.zeros((d, d))
        m[g["i"], g["j"]] = g["s"]
        m[g["j"], g["i"]] = g["s"]
        out[int(d)] = np.linalg.eigh(m)[1][:, ::-1].copy()
    return out


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of a list column by length: length, their places, their matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    lengths = np.diff(column.offsets.to_numpy())
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, matrix(column if len(at) == len(column) else column.take(pa.array(at)))


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, cosine: float, first: int = FIRST_DIMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``a``, row of ``b``) with cosine >= ``cosine``; one side of the diagonal if ``same``.

    Dimensions are added segment by segment: ``first``, then twice as many as so far.
    """
    d = a.shape[1]
    cuts = [0]
    while cuts[-1] < d:
        cuts.append(min(d, max(first, 3 * cuts[-1])))
    ta = [np.sqrt((a[:, c:] ** 2).sum(1)) for c in cuts]
    tb = [np.sqrt((b[:, c:] ** 2).sum(1)) for c in cuts]
    eps = 1e-12
    for i in range(0, len(a), INNER):
        for j in range(i if same else 0, len(b), INNER):
            x, y = a[i : i + INNER], b[j : j + INNER]
            s = x[:, : cuts[1]] @ y[:, : cuts[1]].T
            alive = s + ta[1][i : i + INNER, None] * tb[1][None, j : j + INNER] >= cosine - eps
            if same and i == j:
                alive = np.triu(alive, 1)
            r, c = np.nonzero(alive)
            if not len(r):
                continue
            part = s[r, c]
            for k in range(1, len(cuts) - 1):
                lo, hi = cuts[k], cuts[k + 1]
                if len(r) * 8 > s.size:  # many are left: one dense product
                    part = part + (x[:, lo:hi] @ y[:, lo:hi].T)[r, c]
                else:
                    part = part + np.concatenate([np.einsum("ij,ij->i", x[r[t : t + 8192], lo:hi], y[c[t : t + 8192], lo:hi]) for t in range(0, len(r), 8192)])
                go = part + ta[k + 1][r + i] * tb[k + 1][c + j] >= cosine - eps
                r, c, part = r[go], c[go], part[go]
                if not len(r):
                    break
            go = part >= cosine - 1e-15
            if go.any():
                yield r[go] + i, c[go] + j


def near_links(distinct: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """``(rep, links, root)`` for ``distinct(rep, mult, v)``: links by multiplicity, and forest edges."""
    axes = distinct.sparkSession.sparkContext.broadcast(principal_axes(distinct))

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, v in by_length(b.column(2)):
                u = (v / np.linalg.norm(v, axis=1)[:, None]) @ axes.value[d]
                offs = pa.array(np.arange(0, (len(u) + 1) * d, d), pa.int32())
                take = pa.array(at)
                yield batch({
                    "rep": b.column(0).take(take), "mult": b.column(1).take(take), "d": pa.array(np.full(len(u), d, np.int32)),
                    "angle": pa.array(np.arcsin(np.clip(u[:, 0], -1, 1))), "u": pa.ListArray.from_arrays(offs, pa.array(u.ravel())),
                })

    turned = distinct.select("rep", "mult", "v").mapInArrow(rotate, "rep bigint, mult bigint, d int, angle double, u array<double>")
    rows = row_index(turned, ["d", "angle", "rep"]).withColumn("tile", F.floor((F.col("idx") - 1) / tile).cast("int"))
    # tiles in the order of (d, angle): the partners of a tile are those up to the last one whose
    # smallest angle lies within reach of its largest (one row a tile)
    tiles = rows.groupBy("tile", "d").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    reach = math.acos(cosine) + 1e-9
    marks = tiles.select("d", F.col("lo").alias("at"), "tile", F.lit(0).alias("ask"), F.col("tile").alias("seen")).union(
        tiles.select("d", (F.col("hi") + reach).alias("at"), "tile", F.lit(1).alias("ask"), F.lit(None).cast("int").alias("seen")))
    up_to = Window.partitionBy("d").orderBy("at", "ask", "tile").rowsBetween(Window.unboundedPreceding, 0)
    last = marks.withColumn("last", F.max("seen").over(up_to)).filter("ask = 1").select("d", "tile", "last")
    pairs = last.select("d", "tile", F.explode(F.sequence("tile", "last")).alias("other"))
    left = pairs.select("d", "tile", F.col("tile").alias("p"), F.col("other").alias("q"), F.lit(0).alias("side"))
    right = pairs.filter("tile <> other").select("d", F.col("other").alias("tile"), F.col("tile").alias("p"), F.col("other").alias("q"), F.lit(1).alias("side"))
    sides = rows.select("rep", "mult", "d", "tile", "u").join(left.union(right), ["d", "tile"])
    sides = sides.select("d", "p", "q", "side", "rep", "mult", "u").repartition("d", "p", "q").sortWithinPartitions("d", "p", "q", "side", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["d", "p", "q"]):
            side = t.column("side").to_numpy()
            rep, mult, u = t.column("rep").to_numpy(), t.column("mult").to_numpy(), matrix(t.column("u"))
            n = int((side == 0).sum())
            same = t.column("p")[0].as_py() == t.column("q")[0].as_py()
            links, forest = np.zeros(len(rep), np.int64), Forest(len(rep))
            for r, c in tile_links(u[:n], u if same else u[n:], same, cosine):
                c = c if same else c + n
                np.add.at(links, r, mult[c])
                np.add.at(links, c, mult[r])
                # a row needs one link to each tree only: its partners' roots, once each
                low = np.fromiter((forest.find(x) for x in range(len(rep))), np.int64, len(rep))
                for x, y in np.unique(np.stack([low[r], low[c]], 1), axis=0).tolist():
                    forest.union(x, y)
            at = np.flatnonzero(links)
            if len(at):
                root = np.array([forest.find(x) for x in at.tolist()])
                yield batch({"rep": pa.array(rep[at]), "links": pa.array(links[at]), "root": pa.array(rep[root])})

    return sides.mapInArrow(compare, "rep bigint, links bigint, root bigint")


def dedup(vectors: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding)``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    distinct = stage(usable(vectors).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")), "vectors")
    links = stage(near_links(distinct, cosine, tile), "vector-links")
    parts = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = (
        distinct.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
        .select("v", "mult", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    out = rows.join(classes, "v", "left")
    known = F.col("vec_id").isNotNull()
    component = F.when(known, F.coalesce("component", "vec_id"))
    return out.select(
        "vec_id",
        F.when(known, F.coalesce(F.col("links") + F.col("mult") - 1, F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "embeddings"))


SQL = {
    "op3_near_vectors": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component FROM r GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id,
  coalesce(coalesce(component, vec_id) = vec_id, false) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id"""
}
