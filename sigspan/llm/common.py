"""Helpers shared by the operators of this subpackage.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` (the separators are ASCII, so UTF-8 bytes can be
split directly). Everything here works on Arrow batches inside tasks; a batch is cut into chunks
of a few MB of text first, so memory does not depend on the batch that Spark sends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

CHUNK_BYTES = 2 << 20
_U = np.uint64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back (cuts the lineage)."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- hashing -----------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (wraps modulo 2**64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_R = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_RINV = pow(_R, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {"r": np.ones(1, _U), "i": np.ones(1, _U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["r"]) < n:
        for k, base in (("r", _R), ("i", _RINV)):
            p = np.full(n, base, _U)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW["r"][:n], _POW["i"][:n]


def position_factors(k: int, seed: int) -> np.ndarray:
    """``k`` odd multipliers, one for each position in a window of words."""
    return mix(np.arange(1, k + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


class Words:
    """Word starts, ends and 64-bit hashes of a chunk of texts, with word offsets by text."""

    __slots__ = ("data", "starts", "ends", "hashes", "offsets")

    def __init__(self, texts: pa.Array, lower: bool):
        data, offs = text_bytes(texts)
        if lower:
            up = (data >= 65) & (data <= 90)
            data = np.where(up, data + np.uint8(32), data).astype(np.uint8, copy=False)
        self.data = data
        n = len(data)
        word = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(n + 1, bool)
        edge[offs] = True  # a text's first byte; no word crosses it
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
            after[-1] = False
            after[:-1] = word[1:]
        self.starts = np.flatnonzero(word & (~before | edge[:n]))
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        r, inv = _powers(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[data] * r[:n], out=total[1:])
        self.hashes = mix((total[self.ends] - total[self.starts]) * inv[self.starts] + (self.ends - self.starts).astype(_U))
        self.offsets = np.searchsorted(self.starts, offs)

    def windows(self, k: int, factors: np.ndarray) -> np.ndarray:
        """Hash of the ``k`` words from each word on; valid only where they lie in one text."""
        h = self.hashes
        n = max(0, len(h) - k + 1)
        out = np.zeros(n, _U)
        for j in range(k):
            out += h[j : j + n] * factors[j]
        return mix(out)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an array of strings and its offsets (null counts as empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    bufs = texts.buffers()
    offs = np.frombuffer(bufs[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of ``column`` (or one longer text)."""
    for b in batches:
        if not b.num_rows:
            continue
        _, offs = text_bytes(b.column(b.schema.get_field_index(column)))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == _U else x.astype(np.int64), pa.int64())


def long_lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """``array<bigint>`` column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), signed(flat))


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal ``keys`` (input sorted by them), one table each.

    Holds one group at a time; callers bound the groups.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.append(np.flatnonzero(new), b.num_rows)
        for s, e in zip(at[:-1], at[1:], strict=True):
            key = tuple(c[s] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


# --- fixed-size bit filters ---------------------------------------------------------------------

def bit_filter(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Fixed bitmap of ``2**bits`` bits with the top bits of every value of ``column`` set.

    A value in the frame is always hit; others may be. The size is fixed by ``bits`` (2**26 bits
    are 8 MB) whatever the data, so the bitmap may be broadcast; a fuller one only filters less.
    """
    words = hashes.select(
        F.expr(f"shiftrightunsigned(`{column}`, {64 - bits + 6})").cast("int").alias("w"),
        F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {64 - bits}) & 63 as int))").alias("b"),
    )
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view(_U)


def bit_hits(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes >> _U(64 - bits)
    return (bitmap[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) != 0


# --- union-find and connected components ---------------------------------------------------------

class Forest:
    """Union-find over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges(a, b)``: ``(node, component)``.

    ``component`` is the smallest node reachable. Alternating large-star and small-star steps; each
    round is checkpointed, links stay on the executors, a hub's links are spread by skewed joins. Rounds go on until
    nothing changes, which takes a number of them that grows with the logarithm of the longest chain.
    Only nodes with a link to another node appear.
    """
    def signature(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    was = signature(e)
    while True:
        # large star: neighbours above a node go to the smallest of its neighbours and itself
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m", "a")
        e = small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct().checkpoint()
        now = signature(e)
        if now == was:
            break
        was = now
    roots = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
