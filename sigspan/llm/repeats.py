"""Substring dedup: repeated runs of words by prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one document. A window goes if its word sequence also
starts earlier (smaller doc_id, or the same document at an earlier start); a word goes if a window
that goes covers it. Windows are judged on the input.

Method. The trees are sparse: they hold the suffixes that start at an anchor, the leftmost smallest hash among
the runs of ``GRAM`` words of a window. Equal windows have their anchor at the same offset, so
every repeat of ``WINDOW`` words meets at an anchored suffix. A suffix's prefix decides its subtree:

* ``GRAM`` words long, as a rule. Prefixes are counted (on each chunk, then over all data); one that
  occurs once cannot repeat and goes with its suffixes.
* Under a prefix with more than ``GROUP`` occurrences the suffixes of the windows themselves are taken,
  with a prefix of ``WINDOW`` words, so a subtree fits in memory. Where even that is frequent (a passage that
  a third of all documents share) the subtree is built in two steps: first for ``SALTS`` parts of the documents,
  of which only the first suffix of each node goes on.

A subtree gets the word hashes of its suffixes, and of the words before them that windows reach back to. It is kept
as a suffix array with common-prefix lengths: suffixes sorted by words, the length shared with the one before,
and for a depth D the nodes are the intervals between lengths below D. The words to the left form a
second array in the same way. A window that starts d words before its anchor belongs to the node
of depth ``WINDOW`` - d to the right and to that of depth d to the left; internal nodes with two or more windows are
the repeats, compared word by word (64-bit hashes of words). Their first window stays, the others go, and runs
of windows that go are joined to spans, which are the maximal repeats less their first place.

A chunk of documents settles its own copies before anything is shuffled: of equal windows in a
chunk only the first can be the earliest of all. So a passage that a third of all documents share
leaves one row a chunk. Which prefixes recur travels as a bitmap of fixed size; a value hit by
chance only costs a needless row.

Defined cases: null text has no words; texts shorter than a window keep all words; very long texts are
read whole, in a chunk of their own (memory of a task follows the longest text); rows without
doc_id lose nothing and cost others nothing; rows that repeat a doc_id are taken as the same
document (windows at one start are not earlier than each other); an empty table gives no rows;
extra columns are ignored unless kept, and one with the name of a count gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, batch, bit_filter, bit_hits, chunks, position_factors, read, signed

WINDOW, GRAM = 20, 10
GROUP = 50_000
SALTS = 256
RECUR_BITS, LONG_BITS = 26, 20
_U = np.uint64


def sliding(op: np.ufunc, x: np.ndarray, k: int) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``k`` consecutive values."""
    n, have, out = len(x) - k + 1, 1, x
    if n <= 0:
        return x[:0]
    while have * 2 <= k:
        out = op(out[: len(out) - have], out[have:])
        have *= 2
    return op(out[:n], out[k - have : k - have + n])


def anchored(w: Words, window: int, gram: int, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the gram at each word, starts of the windows, and each window's anchor."""
    g = w.windows(gram, factors[:gram])
    low = sliding(np.minimum, g, window - gram + 1)
    counts = np.diff(w.offsets)
    n = np.maximum(0, counts - window + 1)
    starts = np.repeat(w.offsets[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return g, starts, low[starts] if len(starts) else np.zeros(0, _U)


def anchor_counts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``(h, n)``: anchors by hash and how often they occur, for those that recur."""
    factors = position_factors(window, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            w = Words(b.column(1), lower=False)
            g, starts, anchor = anchored(w, window, gram, factors)
            if not len(starts):
                continue
            # a gram is an anchor if it is the smallest of some window that holds it
            span = window - gram + 1
            low = np.zeros(len(g) + 2 * span, _U)
            low[starts + span - 1] = anchor
            best = sliding(np.maximum, low, span)[: len(g)]
            values, n = np.unique(g[(best == g) & (best != 0)], return_counts=True)
            yield batch({"h": signed(values), "n": pa.array(n.astype(np.int32))})

    found = docs.mapInArrow(run, "h bigint, n int").groupBy("h").agg(F.sum("n").alias("n"))
    return found.filter("n > 1")


def spans(doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word spans covered by windows at sorted (doc, start): overlapping or touching ones merged."""
    if not len(doc):
        return doc, start, start
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + window)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], start[last] + window


def later(h: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (window, doc, start), and which of that order are not the first of their window."""
    order = np.lexsort((start, doc, h))
    h, doc, start = h[order], doc[order], start[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, int)
    return order, (doc != doc[first]) | (start != start[first])


_ROW = "label bigint, doc_id bigint, start int, stop int, anchor int, words array<bigint>"


def fragments(label, doc, start, stop, anchor, offsets, words) -> pa.RecordBatch:
    """Rows of windows ``start`` .. ``stop`` - 1 of a document with the words they cover, and the anchor's place among these."""
    ints = {"start": start, "stop": stop, "anchor": anchor}
    return batch({
        "label": label, "doc_id": pa.array(doc.astype(np.int64)), **{k: pa.array(v.astype(np.int32)) for k, v in ints.items()},
        "words": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), signed(words)),
    })


def span_rows(doc: np.ndarray, start: np.ndarray, window: int) -> pa.RecordBatch | None:
    """Settled rows (without label): word spans of windows that go."""
    o = np.lexsort((start, doc))
    d, lo, hi = spans(doc[o], start[o], window)
    if not len(d):
        return None
    return fragments(pa.nulls(len(d), pa.int64()), d, lo, hi, np.zeros(len(d)), np.zeros(len(d) + 1), np.zeros(0, _U))


def shared_depths(label: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the rows of ``words``, by label: their order, and how many words each shares with the one before."""
    order = np.lexsort((*words.T[::-1], label))
    same = np.zeros((len(order), words.shape[1] + 1), bool)
    w, first = words[order], label[order]
    same[1:, 0] = first[1:] == first[:-1]
    same[1:, 1:] = w[1:] == w[:-1]
    return order, np.logical_and.accumulate(same, axis=1).sum(1) - 1  # -1: another label


def nodes(order: np.ndarray, depths: np.ndarray, depth: int) -> np.ndarray:
    """For each row the number of its node at ``depth``: the interval of suffixes that share that many words."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(depths < depth)
    return out


def tree_repeats(label, doc, start, stop, anchor, offsets, words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, window start, gone)`` of every window of the rows: gone if an earlier one is in its node."""
    n, reach = len(label), window - gram
    length = np.diff(offsets)
    padded = np.concatenate([words, np.zeros(1, _U)])
    at = offsets[:-1] + anchor
    right, left = np.arange(window)[None, :], np.arange(reach)[None, :]
    end = len(words)
    right = padded[np.where(right < (length - anchor)[:, None], at[:, None] + right, end)]
    left = padded[np.where(left < anchor[:, None], at[:, None] - 1 - left, end)]
    right, left = shared_depths(label, right), shared_depths(label, left)
    rows, begins, gone = [], [], []
    for d in range(reach + 1):  # windows that start d words before their anchor
        row = np.flatnonzero((anchor >= d) & (start + anchor - d < stop))
        if not len(row):
            continue
        node = nodes(*right, window - d)[row] * (n + 1) + nodes(*left, d)[row]
        begin = start[row] + anchor[row] - d
        order, late = later(node, doc[row], begin)
        rows.append(row[order])
        begins.append(begin[order])
        gone.append(late)
    return np.concatenate(rows), np.concatenate(begins), np.concatenate(gone)


def subtrees(batches: Iterator[pa.RecordBatch], window: int, gram: int, first_step: bool) -> Iterator[pa.RecordBatch]:
    """Settle the subtrees of rows sorted by label; in a first step what stays goes on as rows of one window."""

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        label, doc, start, stop, anchor = (rows.column(k).to_numpy() for k in ("label", "doc_id", "start", "stop", "anchor"))
        lists = rows.column("words").combine_chunks()
        words = lists.flatten().to_numpy().view(_U)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        row, begin, gone = tree_repeats(label, doc, start, stop, anchor, offsets, words, window, gram)
        out = span_rows(doc[row[gone]], begin[gone], window)
        if out is not None:
            yield out
        if first_step:
            row, begin = row[~gone], begin[~gone]
            at = (offsets[row] + begin - start[row])[:, None] + np.arange(window)
            yield fragments(signed(label[row]), doc[row], begin, begin + 1, np.zeros(len(row)), np.arange(len(row) + 1) * window, words[at].ravel())

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if b.column(0).null_count:  # settled before
            yield b.filter(pa.compute.is_null(b.column(0)))
            b = b.filter(pa.compute.is_valid(b.column(0)))
            if not b.num_rows:
                continue
        # equal labels stand together; the last label of a batch may go on in the next
        values = b.column(0).to_numpy()
        change = np.flatnonzero(values[1:] != values[:-1]) + 1
        if held and values[0] != held[-1].column(0)[-1].as_py():
            yield from settle(pa.Table.from_batches(held))
            held = []
        cut = int(change[-1]) if len(change) else 0
        if cut:
            yield from settle(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held = []
        held.append(b.slice(cut))
    if held:
        yield from settle(pa.Table.from_batches(held))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, salts: int = SALTS) -> DataFrame:
    """``(doc_id, spans)``: word spans ``[from, to)`` that go, sorted, for documents that lose any."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    sc = docs.sparkSession.sparkContext
    counts = anchor_counts(docs, window, gram).persist()
    recur = sc.broadcast(bit_filter(counts, "h", RECUR_BITS))
    long_bits = bit_filter(counts.filter(F.col("n") > group), "h", LONG_BITS)
    long = sc.broadcast(long_bits)
    counts.unpersist()
    factors = position_factors(window, 5)
    whole = position_factors(window, 6)

    def suffixes(batches: Iterator[pa.RecordBatch], frequent: bool) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            w = Words(b.column(1), lower=False)
            g, at, anchor = anchored(w, window, gram, factors)
            hit = bit_hits(recur.value, anchor, RECUR_BITS)
            at, anchor = at[hit], anchor[hit]
            if not len(at):
                continue
            row = np.searchsorted(w.offsets, at, "right") - 1
            doc, start = b.column(0).to_numpy()[row], at - w.offsets[row]
            h = w.windows(window, whole)[at]
            order, gone = later(h, doc, start)
            out = order[gone]
            if not frequent:  # settled here
                settled = span_rows(doc[out], start[out], window)
                if settled is not None:
                    yield settled
            keep = np.sort(order[~gone])
            keep = keep[bit_hits(long.value, anchor[keep], LONG_BITS) == frequent]
            if not len(keep):
                continue
            at, doc, start, anchor = at[keep], doc[keep], start[keep], anchor[keep]
            if frequent:
                label, place, new = h[keep], np.zeros(len(keep), np.int64), np.ones(len(keep), bool)
            else:
                place = np.zeros(len(at), np.int64)  # the anchor's first place after the window's start
                for k in range(window - gram, -1, -1):
                    place[g[at + k] == anchor] = k
                label, new = anchor, np.ones(len(at), bool)
                new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (place[1:] != place[:-1] - 1)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(at)))
            offsets = np.concatenate([[0], np.cumsum(n + window - 1)])
            words = w.hashes[np.repeat(at[first] - offsets[:-1], n + window - 1) + np.arange(offsets[-1])]
            yield fragments(signed(label[first]), doc[first], start[first], start[first] + n, place[first], offsets, words)

    spread = F.coalesce("label", F.xxhash64("doc_id", "start"))
    rows = docs.mapInArrow(lambda batches: suffixes(batches, False), _ROW)
    if long_bits.any():
        often = docs.mapInArrow(lambda batches: suffixes(batches, True), _ROW)
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts))
        often = often.repartition(spread, salt).sortWithinPartitions("label").mapInArrow(lambda batches: subtrees(batches, window, gram, True), _ROW)
        rows = rows.union(often)
    parts = rows.repartition(spread).sortWithinPartitions("label").mapInArrow(lambda batches: subtrees(batches, window, gram, False), _ROW)
    return parts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def kept_words(text: bytes, places: list | None) -> tuple[list[bytes], int]:
    """Words outside the places, and how many there were. ASCII white space separates."""
    words = text.split()
    n = len(words)
    if not places:
        return words, n
    gone = np.zeros(n + 1, np.int32)
    for p in places:
        gone[min(p["start"], n)] += 1
        gone[min(p["stop"], n)] -= 1
    keep = np.cumsum(gone[:n]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()], n


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, counts: tuple[str, str] = ("n_words", "n_removed")
) -> DataFrame:
    """``docs`` with ``text`` without the words that go, and the two ``counts``: words and words that go.

    A text that loses nothing is kept as it is; kept words of others are joined by one space.
    """
    inner = docs.select(
        F.col("text").alias("t"), F.col("doc_id").cast("long").alias("d"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    found = repeated_spans(docs, window, gram, group)
    both = inner.join(found.withColumnRenamed("doc_id", "d"), "d", "left").select("t", "spans", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "t"):
            texts, total, gone = [], [], []
            for t, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words, n = kept_words((t or "").encode(), p)
                texts.append(b" ".join(words).decode() if len(words) < n else t)
                total.append(n)
                gone.append(n - len(words))
            yield batch({"text": pa.array(texts, pa.string()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "row": b.column(2)})

    fields = T.StructType.fromDDL("text string, n_words bigint, n_removed bigint").fields
    out = both.mapInArrow(run, T.StructType([*fields, T.StructField("row", inner.schema["row"].dataType)]))
    own = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in counts]
    return out.select(*own, F.col("n_words").alias(counts[0]), F.col("n_removed").alias(counts[1]))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated_spans(docs).withColumnRenamed("doc_id", "d")
    both = docs.join(found, docs.doc_id == F.col("d"), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            total, gone, digest = [], [], []
            for t, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words, n = kept_words((t or "").encode(), p)
                total.append(n)
                gone.append(n - len(words))
                digest.append(sha256(b" ".join(words)).hexdigest())
            yield batch({"doc_id": b.column(0), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    return both.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


SQL = {
    "op5_repeats": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS win
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS i) WHERE len(w) >= {WINDOW}),
f AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM v),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM f WHERE r > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.k) AS kept, count(*) AS n
  FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.k = g.k WHERE g.k IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y ON d.doc_id = y.doc_id"""
}
