"""SentencePiece encoding and decoding by suffix-array matching.

Method. The texts of a chunk are cut into units that no piece crosses: a run of spaces with the
word after it, and single characters that no longer piece holds. The distinct units are
concatenated and indexed by a suffix array (order of the first 16 bytes, built by doubling). Every piece
of the vocabulary is searched in it by bisection, which gives its range of occurrences; the
occurrences of all pieces are the edges (position, length, piece) of a lattice, sorted by position.
The lattice is relaxed as the model asks: the vocabulary here is a BPE model, so the units start
as characters and in each round every unit takes the edge over two neighbouring symbols with the
best score, the leftmost of equals, until none is left. Symbols without a piece become bytes.
The ids of a text are the ids of its units. They equal those of the sentencepiece library.

The model file is read on the driver and its pieces are broadcast (their number is fixed by the
file). A chunk has a few MB of text, so memory does not grow with the table; encoding is one pass
without a shuffle.

Defined cases: null and empty texts have no ids and decode to the empty string; a literal U+2581
is read as a space, as by the library; repeated rows are encoded each by itself; an empty table
gives no rows; extra columns are ignored unless kept.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, _powers, batch, chunks, mix, read, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TABLE_LENGTHS = 16  # pieces of 2 .. 17 bytes are looked up in a table, longer ones by bisection
LONG_UNIT = 64  # bytes; longer units are relaxed with a heap
_U = np.uint64
_SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Vocabulary:
    """Pieces as bytes (spaces for U+2581) with their scores, and what decoding needs."""

    text: list[bytes]  # what an id decodes to
    match: np.ndarray  # ids that can match, in the order of their bytes
    score: np.ndarray
    byte_ids: np.ndarray  # id of each byte, -1 without byte fallback
    unknown: int
    dummy_prefix: bool
    inner: np.ndarray  # bytes that stand in a piece of two characters or more

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        trainer = {k: v for n, m in message if n == 2 for k, v in _fields(m)}
        normal = {k: v for n, m in message if n == 3 for k, v in _fields(m)}
        if trainer.get(3, 1) != 2:
            raise ValueError("the model is not a BPE model")
        if normal.get(2) or normal.get(4, 1):
            raise ValueError("the model normalises texts: not supported")
        text, kinds, scores = [], [], []
        for n, m in message:
            if n == 1:
                p = dict(_fields(m))
                text.append(p[1].decode())
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, 1))
        byte_ids = np.full(256, -1, np.int32)
        out, match = [], []
        inner = np.zeros(256, bool)
        for i, (t, k) in enumerate(zip(text, kinds, strict=True)):
            if k == 6:  # byte
                byte_ids[int(t[3:5], 16)] = i
                out.append(bytes([int(t[3:5], 16)]))
            elif k == 1:
                b = t.replace(_SPACE, " ").encode()
                out.append(b)
                match.append(i)
                if len(t) > 1:
                    inner[list(b)] = True
                    if _SPACE in t.lstrip(_SPACE):
                        raise ValueError("a piece holds a space after other characters: not supported")
            elif k in (2, 3):
                out.append(b"")
            else:
                raise ValueError("user-defined and unused pieces are not supported")
        match.sort(key=lambda i: out[i])
        return cls(out, np.array(match), np.array(scores), byte_ids, kinds.index(2), bool(normal.get(3, 1)), inner)


def packed(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number (zeros beyond the end)."""
    d = np.concatenate([data, np.zeros(8, np.uint8)]).astype(_U)
    out = np.zeros(len(data), _U)
    for k in range(8):
        out = (out << _U(8)) | d[k : k + len(data)]
    return out


class SuffixArray:
    """Positions of a byte string in the order of the 16 bytes from there on."""

    def __init__(self, data: np.ndarray):
        self.key = packed(data)
        values, rank = np.unique(self.key, return_inverse=True)
        after = np.concatenate([rank[8:], np.zeros(min(8, len(rank)), rank.dtype)])
        pair = (rank.astype(_U) << _U(32)) | after.astype(_U)
        self.order = np.argsort(pair)
        self.first, self.pair, self.values = self.key[self.order], pair[self.order], values

    def ranges(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each piece the range of its occurrences in the order; of a piece longer than 16
        bytes the range of its first 16."""
        n = np.array([min(8, len(p)) for p in pieces], np.int64)
        head = np.array([int.from_bytes(p[:8].ljust(8, b"\0"), "big") for p in pieces], _U)
        span = (_U(1) << (8 * (8 - n)).astype(_U)) - _U(1)
        lo, hi = np.searchsorted(self.first, head), np.searchsorted(self.first, head | span, "right")
        long = np.flatnonzero([len(p) > 8 for p in pieces])
        if len(long):
            rank = np.searchsorted(self.values, head[long]).astype(_U)
            tail = np.array([int.from_bytes(pieces[i][8:16].ljust(8, b"\0"), "big") for i in long], _U)
            m = np.array([min(8, len(pieces[i]) - 8) for i in long])
            span = (_U(1) << (8 * (8 - m)).astype(_U)) - _U(1)
            a, b = np.searchsorted(self.values, tail).astype(_U), np.searchsorted(self.values, tail | span, "right").astype(_U)
            found = hi[long] > lo[long]
            lo[long] = np.where(found, np.searchsorted(self.pair, (rank << _U(32)) | a), 0)
            hi[long] = np.where(found, np.searchsorted(self.pair, (rank << _U(32)) + b), 0)
        return lo, np.maximum(lo, hi)


class Encoder:
    """Encodes and decodes chunks of texts with a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.pieces = [v.text[i] for i in v.match]
        self.lengths = np.array([len(p) for p in self.pieces])
        self.byte_text = np.array(v.text, object)
        # a space starts a unit; a byte that no longer piece holds is a unit with its character
        self.alone = ~v.inner

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of all pieces, sorted by position: position, length, id."""
        sa = SuffixArray(data)
        lo, hi = sa.ranges(self.pieces)
        size = hi - lo
        piece = np.repeat(np.arange(len(size)), size)
        at = sa.order[np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        long = np.flatnonzero(self.lengths[piece] > 16)
        if len(long):
            text = data.tobytes()
            keep = np.ones(len(at), bool)
            for k in long.tolist():
                p = self.pieces[piece[k]]
                keep[k] = text[at[k] : at[k] + len(p)] == p
            at, piece = at[keep], piece[keep]
        length = self.lengths[piece]
        order = np.argsort((at.astype(_U) << _U(16)) | length.astype(_U))
        return at[order], length[order], self.v.match[piece[order]]

    def relax(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units that start at ``first`` (a zero byte ends each), and their offsets by unit."""
        at, length, ids = self.edges(data)
        table = np.full((len(data), TABLE_LENGTHS), -1, np.int32)
        mid = (length >= 2) & (length < 2 + TABLE_LENGTHS)
        table[at[mid], length[mid] - 2] = ids[mid]
        one = np.full(256, -1, np.int32)
        single = length == 1
        one[data[at[single]]] = ids[single]
        far = length >= 2 + TABLE_LENGTHS
        far_key, far_id = (at[far].astype(np.int64) << 16) | length[far], ids[far]

        def piece(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            n = b - a
            out = table[a, np.clip(n - 2, 0, TABLE_LENGTHS - 1)]
            out = np.where(n == 1, one[data[a]], out)
            over = np.flatnonzero(n >= 2 + TABLE_LENGTHS)
            if len(over):
                out[over] = -1
                if len(far_key):
                    key = (a[over].astype(np.int64) << 16) | np.minimum(n[over], 65535)
                    k = np.minimum(np.searchsorted(far_key, key), len(far_key) - 1)
                    out[over] = np.where(far_key[k] == key, far_id[k], -1)
            return out

        score = np.append(self.v.score, -np.inf)
        # symbols: characters, by start; a unit's end is a symbol of its own that joins nothing
        sym = np.flatnonzero((data & 0xC0) != 0x80)
        unit = np.searchsorted(first, sym, "right") - 1
        stop = data[sym] == 0
        stop &= np.append(sym[1:], len(data)) == np.append(first[1:], len(data))[unit]
        nbytes = np.diff(np.append(first, len(data)))
        done_sym = []
        for u in np.flatnonzero(nbytes > LONG_UNIT).tolist():
            own = sym[np.searchsorted(unit, u) : np.searchsorted(unit, u, "right")]
            done_sym.append(self._heap(own[:-1], int(own[-1]), piece))
            done_sym.append(own[-1:])
        short = nbytes[unit] <= LONG_UNIT
        sym, unit, stop = sym[short], unit[short], stop[short]

        def pair_score(i: np.ndarray) -> np.ndarray:
            """Score of the edge over symbols i and i + 1."""
            out = np.full(len(i), -np.inf)
            ok = ~stop[i] & ~stop[np.minimum(i + 1, len(sym) - 1)]
            k = i[ok]
            if len(k):
                out[ok] = score[piece(sym[k], sym[k + 2])]
            return out

        pair = pair_score(np.arange(len(sym))) if len(sym) else np.zeros(0)
        while len(sym):
            heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.maximum.reduceat(pair, heads)
            count = np.diff(np.append(heads, len(sym)))
            live = np.repeat(best > -np.inf, count)
            done_sym.append(sym[~live])
            if not live.any():
                break
            top = np.repeat(best, count)
            if not live.all():
                sym, unit, stop, pair, top = sym[live], unit[live], stop[live], pair[live], top[live]
                heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            place = np.where(pair == top, np.arange(len(sym)), len(sym))
            join = np.minimum.reduceat(place, heads)  # the leftmost best pair of each unit
            keep = np.ones(len(sym), bool)
            keep[join + 1] = False
            join = join - np.arange(len(join))  # places after the joined symbols are gone
            sym, unit, stop, pair = sym[keep], unit[keep], stop[keep], pair[keep]
            changed = np.concatenate([join, join[join > 0] - 1])
            pair[changed] = pair_score(changed)
        sym = np.sort(np.concatenate(done_sym)) if done_sym else np.zeros(0, np.int64)
        end = np.append(sym[1:], len(data))
        unit = np.searchsorted(first, sym, "right") - 1
        real = end < np.append(first[1:], len(data))[unit]
        sym, end, unit = sym[real], end[real], unit[real]
        got = piece(sym, end)
        # symbols without a piece: their bytes, or the unknown id
        missing = got < 0
        many = np.where(missing & (self.v.byte_ids[0] >= 0), end - sym, 1)
        out = np.repeat(got, many)
        if missing.any():
            where = np.repeat(sym - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            out = np.where(out < 0, self.v.byte_ids[data[np.minimum(where, len(data) - 1)]] if self.v.byte_ids[0] >= 0 else self.v.unknown, out)
        n = np.bincount(unit, many, len(first)).astype(np.int64)
        return out.astype(np.int32), np.concatenate([[0], np.cumsum(n)])

    def _heap(self, sym: np.ndarray, end: int, piece) -> np.ndarray:
        """Symbol starts of one long unit after all joins."""
        at = sym.tolist()
        nxt = [*range(1, len(at)), -1]
        prev = [-1, *range(len(at) - 1)]
        stop = [*at[1:], end]
        alive = [True] * len(at)
        heap: list[tuple[float, int, int, int]] = []

        def push_all(left: list[int]) -> None:
            left = [i for i in left if i >= 0 and nxt[i] >= 0]
            if not left:
                return
            got = piece(np.array([at[i] for i in left]), np.array([stop[nxt[i]] for i in left]))
            for i, p in zip(left, got.tolist(), strict=True):
                if p >= 0:
                    heapq.heappush(heap, (-float(self.v.score[p]), i, stop[i], stop[nxt[i]]))

        push_all(list(range(len(at))))
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if not alive[i] or stop[i] != a or nxt[i] < 0 or stop[nxt[i]] != b:
                continue
            j = nxt[i]
            alive[j] = False
            stop[i], nxt[i] = stop[j], nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            push_all([prev[i], i])
        return np.array([a for a, ok in zip(at, alive, strict=True) if ok], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their offsets by text."""
        data, offs = text_bytes(texts)
        n_texts = len(offs) - 1
        mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, int)
        if len(mark):  # U+2581 is a space
            keep = np.ones(len(data), bool)
            keep[mark + 1] = keep[mark + 2] = False
            data = data.copy()
            data[mark] = 32
            offs = offs - 2 * np.searchsorted(mark, offs)
            data = data[keep]
        if self.v.dummy_prefix:
            full = np.diff(offs) > 0
            data = np.insert(data, offs[:-1][full], 32)
            offs = offs + np.concatenate([[0], np.cumsum(full)])
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(n_texts + 1, np.int64)
        lead = (data & 0xC0) != 0x80
        space = data == 32
        begin = np.zeros(n, bool)
        begin[offs[:-1][np.diff(offs) > 0]] = True
        begin[1:] |= space[1:] & ~space[:-1]
        lone = self.alone[data]
        begin |= lone & lead
        begin[1:] |= lone[:-1] & lead[1:]
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        # distinct units by a 64-bit hash of their bytes
        r, inv = _powers(n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[data] * r[:n], out=total[1:])
        h = mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(_U))
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        size = ends[first] - starts[first] + 1
        at = np.concatenate([[0], np.cumsum(size)])
        text = np.zeros(at[-1], np.uint8)
        place = np.repeat(starts[first] - at[:-1], size) + np.arange(at[-1])
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        text[inside] = data[place[inside]]
        ids, by_unit = self.relax(text, at[:-1])
        n_ids = np.diff(by_unit)[inverse]
        ends_ids = np.concatenate([[0], np.cumsum(n_ids)])
        out = ids[np.repeat(by_unit[:-1][inverse] - ends_ids[:-1], n_ids) + np.arange(ends_ids[-1])]
        return out, ends_ids[np.searchsorted(starts, offs)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        out = b"".join(self.byte_text[ids].tolist()) if len(ids) else b""
        if self.v.dummy_prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, default ``doc_id``) with ``ids array<int>`` of their texts."""
    return _run(docs, model, text_col, keep or ["doc_id"], "ids array<int>", lambda e, ids, offs, texts: {
        "ids": pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids))})


def decode(tokens: DataFrame, model: str = MODEL, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default ``doc_id``) with ``text``; null ids decode to null."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value)
        for b in batches:
            texts = [None if x is None else e.decode(np.asarray(x, np.int64)) for x in b.column(0).to_pylist()]
            yield batch({"text": pa.array(texts, pa.string())} | {f"k{i}": b.column(i + 1) for i in range(len(keep))})

    kept = [T.StructField(f"k{i}", tokens.schema[c].dataType) for i, c in enumerate(keep)]
    out = tokens.select(F.col(ids_col).alias("ids"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    out = out.mapInArrow(run, T.StructType([T.StructField("text", T.StringType()), *kept]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")


def _run(docs: DataFrame, model: str, text_col: str, keep: list[str], schema: str, columns) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value)
        for b in chunks(batches, "t"):
            ids, offs = e.encode(b.column(0))
            yield batch({f"k{i}": b.column(i + 1) for i in range(len(keep))} | columns(e, ids, offs, b.column(0)))

    kept = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    out = docs.select(F.col(text_col).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    out = out.mapInArrow(run, T.StructType([*kept, *T.StructType.fromDDL(schema).fields]))
    named = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*named, *[F.col(c) for c in out.columns[len(keep):]])


def _digests(e: Encoder, ids: np.ndarray, offs: np.ndarray, texts: pa.Array) -> dict[str, pa.Array]:
    digest, same = [], []
    for a, b, t in zip(offs[:-1].tolist(), offs[1:].tolist(), texts.to_pylist(), strict=True):
        own = ids[a:b]
        digest.append(sha256(own.astype("<i4").tobytes()).hexdigest())
        same.append(e.decode(own) == (t or "").replace(_SPACE, " "))
    return {"n_tokens": pa.array(np.diff(offs).astype(np.int64)), "ids_sha256": pa.array(digest, pa.string()), "round_trip": pa.array(same, pa.bool_())}


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, round_trip)``: number of ids, SHA-256 of the ids as
    little-endian 32-bit numbers, and whether decoding them gives the text back."""
    docs = read(spark, sf_dir, "documents")
    return _run(docs, model, "text", ["doc_id"], "n_tokens bigint, ids_sha256 string, round_trip boolean", _digests)


SQL = {}
