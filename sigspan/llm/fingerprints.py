"""Document fingerprints by randomised edit embedding.

Method. A text is walked character by character on a clock of steps: at each step a shared random bit for
(step, character) says whether the walk goes on to the next character or stays. The embedding of the text is the
sequence of what the walk sees at every step (the character it stands on, with the few after it). Texts that differ by few edits
see the same again soon after each edit, so their edit distance turns into a Hamming distance. The fingerprint is a
bit sample of the embedding: each of ``SLOTS`` slots takes one step of the walk, drawn evenly and
consistently (the last record of a shared random sequence before the walk's end, so walks of nearly
equal length take the same steps), and keeps four bits of what is seen there, one hexadecimal digit. The share of equal
digits, corrected for chance, is the likeness of two fingerprints: about the share of steps that agree.

:func:`near_classes` finds alike documents: equal fingerprints are one, sampled digits are banded, documents
that share a band are verified on the whole fingerprint. Band groups larger than a block are compared
block by block in tasks of bounded size, and links leave a task as spanning forests.

:func:`edited_copies` compares each text with an edited one and with the next document. Documents are dealt
once to ranges of doc_id on fixed bounds; the first document of a range is copied to the range before it, so every
task meets the next document of all of its own.

Every walk covers the whole text; the texts of a chunk are walked side by side, the few longest
ones each by itself at the end, in time linear in the text.

Defined cases: a null text is empty; an empty text has the fingerprint of ``SLOTS`` dashes, alike to another empty one (1)
and to no other (0); equal texts have equal fingerprints; repeated ids come in the order of xxhash64 of
their text; rows without id stand in no order: no next document, the edited text keeps the first half, near_next 0;
a single document is its own next; an empty table gives no rows; extra columns are ignored unless kept. Memory follows
the chunk, or one longer text (about 40 bytes a character).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranges import fit_ranges
from ..session import shuffle_partitions, sized_broadcast
from .common import Forest, batch, chunks, components, mix, read, runs, stage

SLOTS = 256
CONTEXT = 6  # characters seen at a step
CLOCK_BITS, CLASS_BITS = 12, 8  # the random bits repeat after 2**12 steps; characters are hashed to 2**8 classes
CHUNK, CHUNK_ROWS = 2 << 20, 1024  # bytes of text, and texts, walked side by side
NARROW = 48  # so few texts left are walked one by one
BAND_SLOTS, LIKENESS, BLOCK = 6, 0.8, 2048
RANGES_PER_PARTITION = 4
_U = np.uint64
_EMPTY = ord("-")
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


@lru_cache(maxsize=1)
def step_table(seed: int = 5) -> np.ndarray:
    """``[class << CLOCK_BITS | clock]`` -> steps that the walk spends on a character reached at that time."""
    n = 1 << CLOCK_BITS
    go = np.random.default_rng([seed, 1]).random((1 << CLASS_BITS, n)) < 0.5
    out = np.empty((1 << CLASS_BITS, n), np.int64)
    last = np.full(1 << CLASS_BITS, -1, np.int64)
    for t in range(2 * n - 1, -1, -1):  # round the clock twice, so that the next move after its end is known
        last = np.where(go[:, t % n], t, last)
        if t < n:
            out[:, t] = last - t + 1
    if out.max() > 255 or out.min() < 1:
        raise ValueError("a class without moves")
    return out.astype(np.uint8).ravel()


@lru_cache(maxsize=1)
def slot_records(slots: int = SLOTS, seed: int = 5) -> list[np.ndarray]:
    """For each slot the rising steps at which a shared random sequence sets records, from step 0 on.

    The last record before a length L is a step drawn evenly from 0 .. L - 1, and the same for most lengths near L.
    """
    r = np.random.default_rng([seed, 2])
    out = []
    for _ in range(slots):
        at = [int(r.integers(1 << 45))]
        while at[-1]:
            at.append(int(r.integers(at[-1])))
        out.append(np.array(at[::-1], np.int64))
    return out


class Fingerprinter:
    """Walks and samples chunks of texts; the same ``seed`` everywhere gives comparable fingerprints."""

    def __init__(self, seed: int = 5, slots: int = SLOTS):
        self.slots = slots
        self.step = step_table(seed)
        self.records = slot_records(slots, seed)
        self.factors = mix(np.arange(1, CONTEXT + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)
        self.salts = mix(np.arange(1, slots + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F) + _U(seed))

    def walk(self, keys: np.ndarray, starts: np.ndarray, lens: np.ndarray, clock: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Clock after every character of the stretches ``keys[start : start + len]``, each begun at its
        ``clock``; stretches one after the other, with their offsets."""
        offs = np.concatenate([[0], np.cumsum(lens)])
        out = np.empty(offs[-1], np.int64)
        order = np.argsort(-lens, kind="stable")
        sorted_lens = lens[order]
        pos, to, t = starts[order].copy(), offs[:-1][order].copy(), clock[order].astype(np.int64)
        mask = (1 << CLOCK_BITS) - 1
        done, n = 0, int((sorted_lens > 0).sum())
        ends = -sorted_lens
        while n > NARROW:
            # up to the end of the shortest of those left, in lockstep
            upto = int(sorted_lens[n - 1])
            p, q, now = pos[:n], to[:n], t[:n]
            for _ in range(done, upto):
                now += self.step[keys[p] | (now & mask)]
                out[q] = now
                p += 1
                q += 1
            done = upto
            n = int(np.searchsorted(ends, -upto, "left"))
        table = self.step.tobytes()
        for i in range(n):
            now, times = int(t[i]), []
            for k in keys[pos[i] : starts[order[i]] + sorted_lens[i]].tolist():
                now += table[k | (now & mask)]
                times.append(now)
            out[to[i] : to[i] + len(times)] = times
        return out, offs

    def sampled_steps(self, lengths: np.ndarray) -> np.ndarray:
        """Steps (text x slot) that the slots take of walks of these lengths (at least 1)."""
        out = np.empty((len(lengths), self.slots), np.int64)
        for k, r in enumerate(self.records):
            out[:, k] = r[np.searchsorted(r, lengths, "left") - 1]
        return out

    def digits(self, seen: Iterator[np.ndarray], empty: np.ndarray) -> np.ndarray:
        """ASCII digits (text x slot) from the characters seen: one array (text x slot) for each place of the context."""
        h = np.broadcast_to(self.salts, (len(empty), self.slots)).copy()
        for f, codes in zip(self.factors, seen, strict=True):
            h += codes.astype(_U) * f
        out = _HEX[(mix(h) >> _U(60)).astype(np.int64)]
        out[empty] = _EMPTY
        return out


class Chunk:
    """Texts walked side by side."""

    def __init__(self, f: Fingerprinter, texts: list[str]):
        self.f = f
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        self.lens = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])[:-1]
        classes = mix(self.codes.astype(_U) + _U(1)) >> _U(64 - CLASS_BITS)
        self.keys = classes.astype(np.int32) << CLOCK_BITS
        self.clock, self.offs = f.walk(self.keys, self.starts, self.lens, np.zeros(len(texts), np.int64))

    def clock_at(self, counts: np.ndarray) -> np.ndarray:
        """Clock after the first ``counts`` characters of each text."""
        at = np.maximum(self.starts + counts - 1, 0)
        return np.where(counts > 0, self.clock[at] if len(self.clock) else 0, 0)

    def _after(self, clock: np.ndarray, offs: np.ndarray, totals: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Place, from the start of its stretch on, of the character that stands at each step."""
        base = np.concatenate([[0], np.cumsum(totals)])[:-1]
        line = clock + np.repeat(base, np.diff(offs))
        return np.searchsorted(line, (steps + base[:, None]).ravel(), "right").reshape(steps.shape) - offs[:-1, None]

    def _code(self, start: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Character ``at`` of texts that begin at ``start`` and have ``size`` characters, plus 1; 0 beyond the end."""
        if not len(self.codes):
            return np.zeros(at.shape, np.int64)
        inside = at < size
        return np.where(inside, self.codes[np.where(inside, start + at, 0)].astype(np.int64) + 1, 0)

    def fingerprints(self) -> np.ndarray:
        total = self.clock_at(self.lens)
        at = self._after(self.clock, self.offs, total, self.f.sampled_steps(np.maximum(total, 1)))
        col = lambda x: x[:, None]
        return self.f.digits((self._code(col(self.starts), at + j, col(self.lens)) for j in range(CONTEXT)), self.lens == 0)

    def edited(self, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts whose last half is replaced by the first characters of the text ``follow`` (-1: by nothing).

        Returns the number of own characters, the number of others, and the fingerprints. The walk of the own half is taken
        over; only the new half is walked.
        """
        own = self.lens - self.lens // 2
        has = follow >= 0
        take = np.where(has, np.minimum(self.lens // 2, self.lens[np.maximum(follow, 0)]), 0)
        start = self.starts[np.maximum(follow, 0)]
        cut = self.clock_at(own)
        clock, offs = self.f.walk(self.keys, start, take, cut)
        total = np.where(take > 0, clock[np.maximum(offs[1:] - 1, 0)] if len(clock) else 0, cut)
        steps = self.f.sampled_steps(np.maximum(total, 1))
        col = lambda x: x[:, None]
        first = self._after(self.clock, self.offs, self.clock_at(self.lens), np.minimum(steps, col(np.maximum(cut - 1, 0))))
        second = self._after(clock, offs, total, steps) if len(clock) else np.zeros_like(steps)
        at = np.where(steps < col(cut), first, second + col(own))

        def seen() -> Iterator[np.ndarray]:
            for j in range(CONTEXT):
                p = at + j
                yield np.where(p < col(own), self._code(col(self.starts), p, col(own)), self._code(col(start), np.maximum(p - col(own), 0), col(take)))

        return own, take, self.f.digits(seen(), self.lens == 0)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal digits above chance, 0 to 1, row by row."""
    return np.clip(((a == b).mean(-1) * 16 - 1) / 15, 0, 1)


def _strings(digits: np.ndarray) -> pa.Array:
    offs = np.arange(0, digits.size + 1, digits.shape[1], dtype=np.int32)
    return pa.StringArray.from_buffers(len(digits), pa.py_buffer(offs.tobytes()), pa.py_buffer(np.ascontiguousarray(digits).tobytes()))


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text", CHUNK):
        for i in range(0, b.num_rows, CHUNK_ROWS):
            yield b.slice(i, CHUNK_ROWS)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _kept(df: DataFrame, keep: Sequence[str]) -> tuple[list, list, list]:
    """Kept columns under names that clash with none, their fields, and their names back."""
    return (
        [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
        [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)],
        [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, n_chars, fingerprint, *keep)`` of every row of ``docs``; one pass without a shuffle."""
    inner, fields, outer = _kept(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fingerprinter()
        for b in _chunks(batches):
            c = Chunk(f, _texts(b.column(1)))
            yield batch({"doc_id": b.column(0), "n_chars": pa.array(c.lens), "fingerprint": _strings(c.fingerprints()), **{x.name: b.column(2 + i) for i, x in enumerate(fields)}})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *inner)
    out = rows.mapInArrow(run, T.StructType([*T.StructType.fromDDL("doc_id long, n_chars long, fingerprint string").fields, *fields]))
    return out.select("doc_id", "n_chars", "fingerprint", *outer)


def in_order(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, text, ...)`` with ``piece`` and ``ahead``, dealt so that the next row by doc_id follows each in its
    piece. The row after a piece's last one is there once more with ``ahead`` 1 (after the last of all: the first)."""
    n = shuffle_partitions(rows.sparkSession)
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    known = keyed.filter("doc_id is not null")
    ranges = fit_ranges(known, ["doc_id", "tie"], RANGES_PER_PARTITION * n)
    placed = ranges.assign(known, "piece")
    # the first row of each piece (one row a piece), and the piece that it follows
    heads = placed.groupBy("piece").agg(F.min(F.struct("doc_id", "tie")).alias("head"))
    order = Window.orderBy("piece")
    before = F.coalesce(F.lag("piece").over(order), F.last("piece").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("head.doc_id").alias("h_id"), F.col("head.tie").alias("h_tie"), before.alias("before"))
    small = sized_broadcast(heads, ranges.count, 32)
    ahead = placed.join(small, (F.col("doc_id") == F.col("h_id")) & (F.col("tie") == F.col("h_tie")))
    ahead = ahead.withColumn("piece", F.col("before")).drop("h_id", "h_tie", "before").withColumn("ahead", F.lit(1))
    # rows without id have pieces of one row each
    loose = keyed.filter("doc_id is null").withColumn("piece", F.lit(-1) - F.monotonically_increasing_id()).withColumn("ahead", F.lit(0))
    whole = placed.withColumn("ahead", F.lit(0)).unionByName(ahead).unionByName(loose)
    return whole.repartition(n, "piece").sortWithinPartitions("piece", "ahead", "doc_id", "tie")


def edited_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Every text beside its edited one: the last half of its characters replaced by the first of the next document.

    ``(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, *keep)``.
    """
    inner, fields, outer = _kept(docs, keep)

    def compare(f: Fingerprinter, b: pa.RecordBatch, last: bool) -> pa.RecordBatch:
        """All rows but the one after the chunk (``last``: all) that stand for themselves."""
        texts = _texts(b.column(1))
        piece, ahead = b.column(2).to_numpy(), b.column(3).to_numpy()
        c = Chunk(f, texts)
        follow = np.arange(1, len(texts) + 1)
        follow[-1] = -1
        follow[:-1] = np.where(piece[1:] == piece[:-1], follow[:-1], -1)
        own, take, changed = c.edited(follow)
        marks = c.fingerprints()
        near_next = np.where(follow >= 0, likeness(marks, marks[np.maximum(follow, 0)]), 0.0)
        show = np.flatnonzero((ahead == 0) & ((np.arange(len(texts)) < len(texts) - 1) | last))
        edited = [texts[i][: own[i]] + (texts[follow[i]][: take[i]] if take[i] else "") for i in show.tolist()]
        at = pa.array(show)
        return batch({
            "doc_id": b.column(0).take(at), "n_chars": pa.array(c.lens[show]), "edited": pa.array(edited, pa.string()),
            "fingerprint": _strings(marks[show]), "edited_fingerprint": _strings(changed[show]),
            "near_edited": pa.array(likeness(marks, changed)[show]), "near_next": pa.array(near_next[show]),
            **{x.name: b.column(4 + i).take(at) for i, x in enumerate(fields)},
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fingerprinter()
        held: pa.RecordBatch | None = None  # rows not shown yet; the next chunk's first row follows its last
        for b in _chunks(batches):
            if held is not None:
                joined = pa.Table.from_batches([held, b.slice(0, 1)]).combine_chunks().to_batches()[0]
                yield compare(f, joined, False)
            if b.num_rows > 1:
                yield compare(f, b, False)
            held = b.slice(b.num_rows - 1, 1)
        if held is not None:
            yield compare(f, held, True)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *inner)
    dealt = in_order(rows).select("doc_id", "text", "piece", "ahead", *[x.name for x in fields])
    own = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = dealt.mapInArrow(run, T.StructType([*T.StructType.fromDDL(own).fields, *fields]))
    return out.select(*T.StructType.fromDDL(own).names, *outer)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LIKENESS, block: int = BLOCK) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: documents linked by a likeness of at least ``least``.

    Two fingerprints are compared when all digits of one band of ``BAND_SLOTS`` sampled slots agree. Rows without id, and
    empty texts, link with nothing.
    """
    marks = stage(fingerprints(docs, id_col, text_col).select("doc_id", "fingerprint"), "fingerprints")
    known = marks.filter(F.col("doc_id").isNotNull() & (F.substring("fingerprint", 1, 1) != "-"))
    distinct = stage(known.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    slots = np.random.default_rng(9).permutation(SLOTS)
    bands = [slots[i : i + BAND_SLOTS] for i in range(0, SLOTS - BAND_SLOTS + 1, BAND_SLOTS)]
    keys = F.array(*[F.concat(F.lit(f"{k}:"), *[F.substring("fingerprint", int(s) + 1, 1) for s in band]) for k, band in enumerate(bands)])
    banded = distinct.select("rep", "fingerprint", F.explode(keys).alias("band"))
    groups = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    groups = groups.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    member = banded.join(groups, "band").withColumn("own", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    # each pair of blocks of a group meets in one task
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q")))
    sides = member.select("band", "rep", "fingerprint", "own", F.explode(pair).alias("at")).select("band", "at.p", "at.q", "rep", "fingerprint", "own")
    sides = sides.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q", "own", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["band", "p", "q"]):
            rep, own = t.column("rep").to_numpy(), t.column("own").to_numpy()
            data = np.frombuffer("".join(t.column("fingerprint").to_pylist()).encode(), np.uint8).reshape(len(rep), SLOTS)
            same = t.column("p")[0].as_py() == t.column("q")[0].as_py()
            forest = Forest(len(rep))
            first = len(rep) if same else int((own == t.column("p")[0].as_py()).sum())
            for i in range(first):
                start = i + 1 if same else first
                for j in (np.flatnonzero(likeness(data[i], data[start:]) >= least) + start).tolist():
                    forest.union(i, j)
            root = np.array([forest.find(i) for i in range(len(rep))])
            at = np.flatnonzero(root != np.arange(len(rep)))
            yield batch({"a": pa.array(rep[at]), "b": pa.array(rep[root[at]])})

    links = sides.mapInArrow(compare, "a long, b long")
    parts = components(links)
    classes = distinct.join(parts, F.col("rep") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "rep").alias("component_id"))
    named = known.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")
    rest = marks.filter(F.col("doc_id").isNull() | (F.substring("fingerprint", 1, 1) == "-"))
    return named.unionByName(rest.withColumn("component_id", F.col("doc_id")))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; the digest is taken of the edited text itself."""
    out = edited_copies(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    return out.select("doc_id", "n_chars", digest.alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


SQL = {}
