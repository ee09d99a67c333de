"""N-gram Jaccard join by signature trees.

Two documents link when their sets of ``WORDS``-word shingles have a Jaccard similarity of
``PERCENT`` / 100 or more; the result is each document's class under these links. Exact: every pair
is compared or shut out by a bound.

Method.

1. A text's set is hashed on the executors; documents with equal sets are one from here on.
2. With t = ceil(0.8 n), linked sets of n shingles share l of the first n - t + l of any common order;
   l is a tenth of t (at least ``SHARED``, at most t). The order puts shingles that recur within a
   chunk of documents last (a bitmap of fixed size says which), so passages that many documents share
   seldom bring two sets together. Prefix shingles seen once drop out, and so do sets with fewer
   than l left (l of their smallest partner), twice over: a text with one common passage goes here.
   Pairs of sets are counted for shingles that at most ``FEW`` sets hold; a pair with half of l of
   them is an edge. If a linked pair has fewer, it shares more than half of l shingles that more
   sets hold; sets that have so many of these meet in a star for each. So a linked pair lies in
   one candidate class, and a group of g sets leaves g - 1 edges a shingle, or less than FEW x g / 2.
3. Each candidate class is joined exactly in one task, in blocks of at most ``BLOCK_DOCS`` sets when it
   is larger: a tree over the sets in the order of size, whose nodes hold the OR of their sets'
   token bitmaps, the range of sizes and the most tokens hidden by bits that share them. A dual
   traversal goes down from (root, root) and drops a pair of nodes whose largest possible overlap,
   common bits plus hidden tokens, is below what the sizes need. Pairs of sets that are left, and
   not yet in one class, are compared token by token.

Links leave a task as a spanning forest. A candidate class of b blocks is compared in b (b + 1) / 2
tasks of bounded memory; distinct near-copies of one text beyond ``BLOCK_DOCS`` cost that square.

Defined cases: null, blank or wordless texts have an empty set and link with nothing; a row
without doc_id links with nothing and has no component; rows that repeat a doc_id count as
documents of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, batch, bit_filter, bit_hits, chunks, components, long_lists, mix, position_factors, read, runs, signed, stage

WORDS, PERCENT = 5, 80
SHARED = 8
FEW = 12
COMMON_IN_CHUNK = 3
COMMON_BITS, SHARED_BITS, NEEDED_BITS = 24, 26, 26
BLOCK_DOCS, BLOCK_TOKENS = 2048, 4_000_000
LEAF, FAN = 8, 8
_U = np.uint64


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    w = Words(texts, lower=True)
    factors = position_factors(words, 3)
    s = w.windows(words, factors)
    out = []
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(s[a : b - words + 1]))
        elif b > a:
            out.append(mix((w.hashes[a:b] * factors[: b - a]).sum(keepdims=True) + _U(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def set_key(s: np.ndarray) -> np.uint64:
    """Fingerprint of a set."""
    return mix(mix(s ^ _U(0xA5A5A5A5)).sum(keepdims=True) + _U(len(s)))[0]


def shared_at_least(n: np.ndarray, percent: int) -> np.ndarray:
    """l: how many prefix shingles sets of ``n`` shingles share when they link."""
    t = (percent * n + 99) // 100
    return np.minimum(t, np.maximum(SHARED, t // 10))


def shared_with_any(n: np.ndarray, percent: int) -> np.ndarray:
    """l for the smallest partner of a set of ``n`` shingles."""
    return shared_at_least((percent * n + 99) // 100, percent)


def prefix(s: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which linked sets share some: rare ones first, then by hash."""
    n = len(s)
    last = bit_hits(common, s, COMMON_BITS)
    return np.concatenate([s[~last], s[last]])[: n - (percent * n + 99) // 100 + int(shared_at_least(n, percent))]


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Bitmap of shingles that recur within a chunk (a matter of speed only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            sets = {int(set_key(s)): s for s in shingle_sets(b.column(1), words) if len(s)}
            if sets:
                values, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                yield batch({"h": signed(values[n >= COMMON_IN_CHUNK])})

    return bit_filter(docs.mapInArrow(run, "h bigint"), "h", COMMON_BITS)


def sketches(docs: DataFrame, common: np.ndarray, words: int, percent: int) -> DataFrame:
    """``(doc_id, n, fp, prefix)``; ``fp`` is null for an empty set."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            sets = shingle_sets(b.column(1), words)
            n = np.array([len(s) for s in sets], np.int64)
            keys = np.array([set_key(s) for s in sets], _U)
            firsts = [prefix(s, shared.value, percent) if len(s) else s for s in sets]
            offs = np.concatenate([[0], np.cumsum([len(p) for p in firsts])])
            yield batch({
                "doc_id": b.column(0), "n": pa.array(n), "fp": pa.array(keys.view(np.int64), mask=n == 0),
                "prefix": long_lists(np.concatenate(firsts), offs),
            })

    return docs.mapInArrow(run, "doc_id bigint, n bigint, fp bigint, prefix array<bigint>")


def recurring(rows: DataFrame, percent: int) -> DataFrame:
    """Rows ``(fp, n, prefix, doc_id)`` with the prefix shingles that occur in several rows, without the
    sets that have too few of them to link."""
    counts = rows.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    shared = rows.sparkSession.sparkContext.broadcast(bit_filter(counts.filter("n > 1"), "h", SHARED_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            offs = lists.offsets.to_numpy()
            h = lists.flatten().to_numpy().view(_U)
            hit = bit_hits(shared.value, h, SHARED_BITS)
            upto = np.concatenate([[0], np.cumsum(hit)])[offs - offs[0]]
            found, n = np.diff(upto), b.column(1).to_numpy()
            keep = found >= shared_with_any(n, percent)
            if keep.any():
                hit &= np.repeat(keep, np.diff(offs))
                yield batch({"fp": b.column(0).filter(pa.array(keep)), "n": pa.array(n[keep]), "prefix": long_lists(h[hit], np.concatenate([[0], np.cumsum(found[keep])])), "doc_id": b.column(3).filter(pa.array(keep))})

    return rows.select("fp", "n", "prefix", "doc_id").mapInArrow(run, "fp bigint, n bigint, prefix array<bigint>, doc_id bigint")


def candidate_edges(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Edges ``(a, b)`` between sets that may link, from :func:`sketches` and the first document
    ``reps(fp, doc_id)`` of each set."""
    first = reps.select(F.col("fp").alias("rep_fp"), F.col("doc_id").alias("rep_id"))
    left = recurring(rows, percent).join(first, (F.col("doc_id") == F.col("rep_id")) & (F.col("fp") == F.col("rep_fp")), "left_semi")
    least = lambda n: F.ceil(n * percent / 100)
    shared = lambda n: F.least(least(n), F.greatest(F.lit(SHARED), F.floor(least(n) / 10)))
    members = recurring(stage(left, "recurring"), percent).select(F.explode("prefix").alias("h"), "fp", "n")
    held = members.groupBy("h").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    both = members.join(held, "h")
    many = both.filter(F.col("held") > FEW)
    enough = many.groupBy("fp").agg(F.count(F.lit(1)).alias("n_many"), F.first("n").alias("n"))
    enough = enough.filter(F.col("n_many") > F.floor(shared(least(F.col("n"))) / 2)).select("fp")
    many = many.select("h", "fp").join(enough, "fp")
    lowest = many.groupBy("h").agg(F.min("fp").alias("low"))
    star = many.join(lowest, "h").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    lists = both.filter(F.col("held") <= FEW).groupBy("h").agg(F.sort_array(F.collect_list(F.struct("fp", "n"))).alias("m"))
    partners = F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(
        x["fp"].alias("a"), y["fp"].alias("b"), F.least(x["n"], y["n"]).alias("n"), F.greatest(x["n"], y["n"]).alias("most"))))
    pairs = lists.select(F.inline(F.flatten(partners))).filter(f"100 * n >= {percent} * most and a <> b")
    close = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.min("n").alias("n"))
    close = close.filter(F.col("common") >= F.ceil(shared(F.col("n")) / 2))
    return star.union(close.select("a", "b"))


class SignatureTree:
    """Levels of nodes over sets in the order of size; level 0 are the sets themselves."""

    def __init__(self, sets: list[np.ndarray]):
        n = np.array([len(s) for s in sets], np.int64)
        width = 256
        while width < 4 * n.max() and width < 16384:
            width *= 2
        row = np.repeat(np.arange(len(sets)), n)
        bit = (np.concatenate(sets) >> _U(40)) & _U(width - 1)
        maps = np.zeros((len(sets), width // 64), _U)
        np.bitwise_or.at(maps, (row, (bit >> _U(6)).astype(np.int64)), _U(1) << (bit & _U(63)))
        hidden = n - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, n, n, hidden)]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            m, low, high, hid = self.levels[-1]
            at = np.arange(0, len(m), fan)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hid, at)))
            fan = FAN

    def possible(self, level: int, p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
        """Node pairs whose largest possible overlap reaches what their smallest sizes need."""
        maps, low, high, hidden = self.levels[level]
        ok = (100 * high[p] >= percent * low[q]) & (100 * high[q] >= percent * low[p])
        step = max(1, (1 << 20) // maps.shape[1])
        at = np.flatnonzero(ok)
        for k in range(0, len(at), step):
            i = at[k : k + step]
            most = np.bitwise_count(maps[p[i]] & maps[q[i]]).sum(1).astype(np.int64) + np.minimum(hidden[p[i]], hidden[q[i]])
            ok[i] = most * (100 + percent) >= percent * (low[p[i]] + low[q[i]])
        return ok

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets (p < q) that the dual traversal leaves, in the order of p."""
        top = len(self.levels) - 1
        p = q = np.zeros(1, np.int64)
        for level in range(top, -1, -1):
            ok = (p != q) | (level > 0)
            p, q = p[ok], q[ok]
            ok = self.possible(level, p, q, percent) | (p == q)
            p, q = p[ok], q[ok]
            if level == 0:
                break
            fan, n = LEAF if level == 1 else FAN, len(self.levels[level - 1][0])
            i, j = np.divmod(np.arange(fan * fan), fan)
            p, q = (p[:, None] * fan + i).ravel(), (q[:, None] * fan + j).ravel()
            ok = (p <= q) & (q < n)
            p, q = p[ok], q[ok]
        order = np.lexsort((q, p))
        return p[order], q[order]


def linked_forest(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each set the smallest position in its class under links."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
    own = [sets[i] for i in order]
    n = np.array([len(s) for s in own])
    label = np.arange(len(own))
    p, q = SignatureTree(own).pairs(percent)
    postings = None
    for a in np.unique(p).tolist():
        b = q[np.searchsorted(p, a) : np.searchsorted(p, a, "right")]
        b = b[label[b] != label[a]]
        if not len(b):
            continue
        if len(b) > 8:  # all overlaps at once, through the sets that hold each token of a
            postings = postings or _postings(own)
            overlap = _overlaps(postings, a, len(own))[b]
            b = b[overlap * (100 + percent) >= percent * (n[a] + n[b])]
            for x in b.tolist():
                label[label == label[x]] = label[a]
            continue
        for x in b.tolist():
            if label[x] != label[a]:
                overlap = len(np.intersect1d(own[a], own[x], assume_unique=True))
                if overlap * (100 + percent) >= percent * (n[a] + n[x]):
                    label[label == label[x]] = label[a]
    out = np.empty(len(sets), np.int64)
    place = np.array(order)
    lowest = np.full(len(own), len(own))
    np.minimum.at(lowest, label, place)
    out[place] = lowest[label]
    return out


def _postings(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    flat = np.concatenate(sets)
    ends = np.cumsum([len(s) for s in sets])
    _, token = np.unique(flat, return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[np.argsort(token, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(token))])
    return token, ends, holder, first


def _overlaps(postings: tuple[np.ndarray, ...], a: int, n: int) -> np.ndarray:
    token, ends, holder, first = postings
    t = token[ends[a - 1] if a else 0 : ends[a]]
    size = first[t + 1] - first[t]
    at = np.repeat(first[t] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return np.bincount(holder[at], minlength=n)


def join_blocks(members: DataFrame, words: int, percent: int) -> DataFrame:
    """Forest edges ``(a, b)`` of true links among ``members(class, fp, n, text)``."""
    rows = members.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("class", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "text")
    rows = rows.repartition("class", "i", "j").sortWithinPartitions("class", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["class", "i", "j"]):
            if t.num_rows < 2:
                continue
            fp = t.column("fp").to_numpy()
            sets = [s for c in chunks(t.select(["text"]).combine_chunks().to_batches(), "text") for s in shingle_sets(c.column(0), words)]
            # rows may repeat a doc_id with another text
            own = np.flatnonzero([set_key(s).view(np.int64) == k for s, k in zip(sets, fp.tolist(), strict=True)])
            fp, sets = fp[own], [sets[i] for i in own.tolist()]
            if len(sets) < 2:
                continue
            root = linked_forest(sets, percent)
            at = np.flatnonzero(root != np.arange(len(root)))
            if len(at):
                yield batch({"a": pa.array(fp[at]), "b": pa.array(fp[root[at]])})

    return rows.mapInArrow(run, "a bigint, b bigint")


def similar_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    rows = stage(sketches(docs, common_shingles(docs, words), words, percent), "sketches")
    linkable = rows.filter("fp is not null and doc_id is not null")
    reps = linkable.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    classes = components(candidate_edges(linkable, reps, percent))
    found = reps.join(classes, F.col("fp") == F.col("node")).select("doc_id", "fp", "n", F.col("component").alias("class"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int")
    needed = stage(found.join(found.groupBy("class").agg(blocks.alias("blocks")), "class"), "candidates")
    bits = spark.sparkContext.broadcast(bit_filter(needed.select(F.xxhash64("doc_id").alias("h")), "h", NEEDED_BITS))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0, 1]).filter(pa.array(bit_hits(bits.value, b.column(2).to_numpy().view(_U), NEEDED_BITS)))

    texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text", F.xxhash64("doc_id").alias("h")).mapInArrow(candidates, "id bigint, text string")
    members = needed.join(texts, needed.doc_id == texts.id).select("class", "blocks", "fp", "text")
    links = components(join_blocks(members, words, percent))
    parts = reps.join(links, F.col("fp") == F.col("node"), "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("part"))
    lowest = parts.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    by_set = parts.join(lowest, "part").select(F.col("fp").alias("set_fp"), "component_id")
    out = rows.select("doc_id", "n", "fp").join(by_set, F.col("fp") == F.col("set_fp"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(read(spark, sf_dir, "documents"))


SQL = {
    "op2_ngram_jaccard": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + {WORDS - 1}], ' ')) AS g
  FROM d, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - {WORDS - 1}) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= {PERCENT} * (p.n + q.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = d.doc_id"""
}
