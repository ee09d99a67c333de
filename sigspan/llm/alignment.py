"""Cross-tokenizer alignment by interval coalescing.

Method. Every text is encoded by tokenizer A (byte-level BPE) and tokenizer B (pieces with byte fallback); both cover the
same bytes, a space and the text. The tokens of both are intervals of byte offsets. All intervals of a chunk are sorted
by start (lexsort), the ends are accumulated to a running maximum, and a group breaks where a start reaches
the running maximum: there A and B both end a token. Inside a group every A token is linked with every B token (the
overlaps are expanded). How many documents hold a pair of ids linked is counted over the whole corpus, and each
document then gets the counts of its links.

On Spark: the texts are encoded once, in tasks, and never shuffled; a document keeps its distinct pairs with their
multiplicities in a written table. The pairs' document counts are summed up in a task before they are shuffled. The
``HOT`` most frequent pairs (a fixed number, whatever the corpus) are broadcast and serve nearly all links where
the documents lie; the links of all other pairs are joined with their counts by a shuffle. So no pair is hot
in that join, none is left out, and what is broadcast does not grow.

Encoders run in the installed tokenizer libraries. A's ids are those of its BPE file (its merges rank as its ids, which
is checked when it is loaded; special tokens' strings are plain text).

Defined cases: null and empty texts, and texts whose joined token bytes differ from the space and the text (a literal
U+2581, say), have no tokens: zeros and the empty digest; repeated rows, also of one id, are documents of their own; a null id is
kept; ties for the highest count all count as best; an empty table gives no rows; extra columns are ignored unless
kept. A chunk has ``CHUNK`` bytes of text or one longer text; a group of any length is expanded in slices, so memory
follows the chunk's tokens, not a group's pairs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, chunks, long_lists, read, stage, text_bytes

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 2 << 20
HOT = 1 << 18  # pairs broadcast, 16 bytes each
LINKS_AT_ONCE = 1 << 22
STEPS = 8  # count classes for each doubling, when the hot pairs are chosen
# fixed value: how the byte-level BPE cuts a text before its merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves, the
    rest, in order, from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_a(path: str = TOKENIZER_A) -> list[bytes]:
    """Bytes of every id of a byte-level BPE file; raises where merging by id would not be merging by its rules."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("not a plain byte-level BPE file")
    letters, vocab = byte_letters(), model["vocab"]
    ids = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(x >= y for x, y in zip(ids, ids[1:])) or (ids and max(vocab[c] for c in letters) >= ids[0]):
        raise ValueError("ids do not rank the merges")
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(letters[c] for c in token)
    return out


def piece_count(path: str = TOKENIZER_B) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


class Pieces:
    """Bytes of the ids of one vocabulary, in one run."""

    def __init__(self, entries: Sequence[bytes]):
        self.size = len(entries)
        self.lens = np.array([len(e) for e in entries], np.int64)
        self.offs = np.concatenate([[0], np.cumsum(self.lens)])
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        at = np.repeat(self.offs[ids] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)
        return self.data[at]


class Aligner:
    """Both tokenizers and the grouping of a chunk of texts; built in a task from the two files' contents."""

    def __init__(self, entries_a: list[bytes], model_b: bytes):
        import sentencepiece
        import tiktoken

        ranks = {e: i for i, e in enumerate(entries_a) if e}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        entries_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            entries_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode())
        self.pa, self.pb = Pieces(entries_a), Pieces(entries_b)
        digits = len(str(max(self.pa.size, self.pb.size)))
        names = np.array([str(i).rjust(digits) for i in range(max(self.pa.size, self.pb.size))], dtype=f"S{digits}")
        self.names = names.view(np.uint8).reshape(-1, digits)

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all texts, and the number of each by text; none for texts that do not come back."""
        use = [i for i, t in enumerate(texts) if t]
        whole = [" " + texts[i] for i in use]
        a = [self.a.encode_to_numpy(t, disallowed_special=()) for t in whole]
        b = self.b.encode([texts[i] for i in use], num_threads=1) if use else []
        na, nb = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        na[use], nb[use] = [len(x) for x in a], [len(x) for x in b]
        ida = np.concatenate(a).astype(np.int64) if a else np.zeros(0, np.int64)
        idb = np.fromiter((y for x in b for y in x), np.int64, int(nb.sum()))
        _, offs = text_bytes(pa.array([" " + t if t else "" for t in texts], pa.large_string()))
        good = np.ones(len(texts), bool)
        for ids, n, table in ((ida, na, self.pa), (idb, nb, self.pb)):
            total = np.concatenate([[0], np.cumsum(table.lens[ids])])[np.concatenate([[0], np.cumsum(n)])]
            good &= np.diff(total) == np.diff(offs)
        ida, na, idb, nb = _only(ida, na, good), np.where(good, na, 0), _only(idb, nb, good), np.where(good, nb, 0)
        data, offs = text_bytes(pa.array([" " + t if t and g else "" for t, g in zip(texts, good)], pa.large_string()))
        wrong = np.concatenate([[0], np.cumsum((self.pa.joined(ida) != data) | (self.pb.joined(idb) != data))])
        good = wrong[offs[1:]] == wrong[offs[:-1]]
        return _only(ida, na, good), np.where(good, na, 0), _only(idb, nb, good), np.where(good, nb, 0)

    def align(self, texts: list[str | None]) -> Groups:
        return Groups(self, *self.tokens(texts))


def _only(ids: np.ndarray, n: np.ndarray, good: np.ndarray) -> np.ndarray:
    return ids if good.all() else ids[np.repeat(good, n)]


class Groups:
    """Tokens of a chunk of texts, coalesced to groups. ``ga``/``gb``: group of each token, ``fa``/``fb``: tokens of
    earlier groups, ``ca``/``cb``: tokens of a group, ``doc``: text of a group."""

    def __init__(self, own: Aligner, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray):
        self.own, self.a, self.na, self.b, self.nb = own, a, na, b, nb
        self.end_a, self.end_b = np.cumsum(own.pa.lens[a]), np.cumsum(own.pb.lens[b])
        end = np.concatenate([self.end_a, self.end_b])
        start = np.concatenate([self.end_a - own.pa.lens[a], self.end_b - own.pb.lens[b]])
        kind = np.repeat(np.array([0, 1], np.int8), [len(a), len(b)])
        order = np.lexsort((kind, start))
        reach = np.maximum.accumulate(end[order])
        new = np.ones(len(order), bool)
        new[1:] = start[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        self.ga, self.gb = group[: len(a)], group[len(a) :]
        n = int(new.sum()) if len(order) else 0
        self.ca, self.cb = np.bincount(self.ga, minlength=n), np.bincount(self.gb, minlength=n)
        self.fa, self.fb = np.cumsum(self.ca) - self.ca, np.cumsum(self.cb) - self.cb
        self.doc = np.repeat(np.arange(len(na)), na)[self.fa] if n else np.zeros(0, np.int64)

    def by_text(self) -> np.ndarray:
        """Groups of each text."""
        return np.bincount(self.doc, minlength=len(self.na))

    def n_links(self) -> np.ndarray:
        out = np.zeros(len(self.na), np.int64)
        np.add.at(out, self.doc, self.ca * self.cb)
        return out

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3`` of all texts as bytes, and the texts' offsets."""
        n = len(self.a) + len(self.b)
        ids, mark = np.empty(n, np.int64), np.empty(n, np.uint8)
        at_a = np.arange(len(self.a)) + self.fb[self.ga]
        at_b = np.arange(len(self.b)) + (self.fa + self.ca)[self.gb]
        ids[at_a], ids[at_b] = self.a, self.b
        first = np.zeros(len(self.a), bool)
        first[self.fa] = True
        mark[at_a] = np.where(first, ord(";"), ord(","))
        first = np.zeros(len(self.b), bool)
        first[self.fb] = True
        mark[at_b] = np.where(first, ord("|"), ord(","))
        offs = np.concatenate([[0], np.cumsum(self.na + self.nb)])
        mark[offs[:-1][self.na > 0]] = ord(" ")  # a text's first group
        cells = np.concatenate([mark[:, None], self.own.names[ids]], 1)
        shown = cells != ord(" ")
        sizes = np.concatenate([[0], np.cumsum(shown.sum(1))])
        return cells[shown], sizes[offs]

    def digests(self) -> list[str]:
        data, offs = self.written()
        view = memoryview(data)
        return [sha256(view[i:j]).hexdigest() if j > i else "" for i, j in zip(offs[:-1].tolist(), offs[1:].tolist())]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked pairs of each text as ``a * |B| + b``, in order, how often each is linked, and the texts' offsets."""
        va, vb = self.own.pa.size, self.own.pb.size
        doc = np.repeat(np.arange(len(self.na)), self.na)
        reps = self.cb[self.ga]
        ends = np.cumsum(reps)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = 0
        while lo < len(reps):
            before = ends[lo] - reps[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, before + LINKS_AT_ONCE, "right")))
            r = reps[lo:hi]
            i = np.repeat(np.arange(lo, hi), r)
            j = self.fb[self.ga[i]] + np.arange(len(i)) - np.repeat(np.cumsum(r) - r, r)
            k, c = np.unique((doc[i] * va + self.a[i]) * vb + self.b[j], return_counts=True)
            if len(keys):
                k, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
                total = np.zeros(len(k), np.int64)
                np.add.at(total, at, np.concatenate([counts, c]))
                c = total
            keys, counts, lo = k, c, hi
        offs = np.searchsorted(keys, np.arange(len(self.na) + 1) * (va * vb))
        return keys % (va * vb), counts, offs


def _rows(docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str], tokenizer_a: str, tokenizer_b: str, schema: str, columns) -> DataFrame:
    """One pass over ``docs``: ``(doc_id, *schema, k0, k1, ...)``; the two files are read on the driver and broadcast."""
    with open(tokenizer_b, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast((load_a(tokenizer_a), f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Aligner(*shared.value)
        for b in chunks(batches, "text", CHUNK):
            got = columns(own.align(b.column(1).to_pylist()))
            yield batch({"doc_id": b.column(0), **got, **{f"k{i}": b.column(2 + i) for i in range(len(keep))}})

    kept = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    inner = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *inner)
    return rows.mapInArrow(run, T.StructType([*T.StructType.fromDDL("doc_id long, " + schema).fields, *kept]))


def _named(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*names, *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])


def _ints(flat: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.int32()))


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B
) -> DataFrame:
    """``(doc_id, a_ids, b_ids, a_ends, b_ends, group_ends, *keep)``: ids, and ends in bytes of the space and the text."""

    def columns(g: Groups) -> dict[str, pa.Array]:
        oa, ob = (np.concatenate([[0], np.cumsum(n)]) for n in (g.na, g.nb))
        og = np.concatenate([[0], np.cumsum(g.by_text())])
        size = np.diff(np.concatenate([[0], g.end_a])[oa])  # bytes of each text
        base = np.cumsum(size) - size
        last = g.end_a[g.fa + g.ca - 1] if len(g.fa) else g.end_a
        return {
            "a_ids": _ints(g.a, oa), "b_ids": _ints(g.b, ob), "a_ends": _ints(g.end_a - np.repeat(base, g.na), oa),
            "b_ends": _ints(g.end_b - np.repeat(base, g.nb), ob), "group_ends": _ints(last - base[g.doc], og),
        }

    names = ["a_ids", "b_ids", "a_ends", "b_ends", "group_ends"]
    out = _rows(docs, id_col, text_col, keep, tokenizer_a, tokenizer_b, ", ".join(f"{c} array<int>" for c in names), columns)
    return _named(out, ["doc_id", *names], keep)


def hot_pairs(counts: DataFrame, most: int = HOT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``most`` pairs of ``counts(code, n, best)``, those of the highest counts: codes in order, counts, best.

    Whole count classes are taken (``STEPS`` for each doubling), so one small histogram tells how far down to go.
    """
    level = F.floor(F.log2("n") * STEPS).cast("int")
    left, low = most, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        left -= r["count"]
        if left < 0:
            break
        low = r["level"]
    if low is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    t = counts.filter(level >= low).select("code", "n", "best").toArrow()
    code, n, best = (t.column(c).to_numpy() for c in ("code", "n", "best"))
    order = np.argsort(code)
    return code[order], n[order], best[order].astype(bool)


def linked_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (),
    tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, hot: int = HOT,
) -> tuple[DataFrame, DataFrame]:
    """Documents with the corpus counts of their links, and the counts themselves.

    ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, *keep)`` and ``(a, b, n, best)``: in how many
    documents the pair is linked, and whether no other B id has more with this A id.
    """

    entries, width = load_a(tokenizer_a), piece_count(tokenizer_b)
    short = len(entries) * width < 1 << 31  # codes of pairs fit an int

    def columns(g: Groups) -> dict[str, pa.Array]:
        codes, counts, offs = g.pairs()
        return {
            "n_a": pa.array(g.na), "n_b": pa.array(g.nb), "n_groups": pa.array(g.by_text()), "n_links": pa.array(g.n_links()),
            "groups_sha256": pa.array(g.digests(), pa.string()), "codes": _ints(codes, offs) if short else long_lists(codes, offs), "times": _ints(counts, offs),
        }

    schema = f"n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<{'int' if short else 'long'}>, times array<int>"
    rows = _rows(docs, id_col, text_col, keep, tokenizer_a, tokenizer_b, schema, columns)
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    a = F.expr(f"cast(code div {width} as int)")
    counts = stage(rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).select(F.col("code").cast("long").alias("code"), "n"), "pair-counts")
    # one row for each id of A at most
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    counts = counts.withColumn("a", a).join(F.broadcast(top), "a").select("code", "a", (F.col("code") % width).cast("int").alias("b"), "n", (F.col("n") == F.col("top")).alias("best"))
    shared = docs.sparkSession.sparkContext.broadcast(hot_pairs(counts, hot))

    def places(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, code and times of every pair of a batch, its place among the hot ones, and whether it is one."""
        known, lists, times = shared.value[0], b.column(1), b.column(2)
        codes = lists.flatten().to_numpy().astype(np.int64)
        text = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
        return text, codes, times.flatten().to_numpy(), at, known[at] == codes if len(known) else np.zeros(len(codes), bool)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = shared.value
        for b in batches:
            text, _, times, at, hit = places(b)
            sums = np.zeros((2, b.num_rows), np.int64)
            t, w, k = text[hit], times[hit].astype(np.int64), at[hit]
            np.add.at(sums[0], t, w * best[k])
            np.add.at(sums[1], t, w * n[k])
            yield batch({"row": b.column(0), "hot_best": pa.array(sums[0]), "hot_sum": pa.array(sums[1]), **{b.schema.names[i]: b.column(i) for i in range(3, b.num_columns)}})

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, codes, times, _, hit = places(b)
            rest = np.flatnonzero(~hit)
            yield batch({"row": b.column(0).take(pa.array(text[rest])), "code": pa.array(codes[rest]), "times": pa.array(times[rest], pa.int32())})

    kept = [f"k{i}" for i in range(len(keep))]
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *kept]
    fields = T.StructType([*T.StructType.fromDDL("row long, hot_best long, hot_sum long").fields, *[rows.schema[c] for c in own]])
    base = rows.select("row", "codes", "times", *own).mapInArrow(near, fields)
    rest = rows.select("row", "codes", "times").mapInArrow(far, "row long, code long, times int")
    rest = rest.join(counts.select("code", "n", "best"), "code").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("far_best"), F.sum(F.col("times") * F.col("n")).alias("far_sum"))
    out = base.join(rest, "row", "left")
    out = out.withColumn("n_best", F.col("hot_best") + F.coalesce("far_best", F.lit(0))).withColumn("count_sum", F.col("hot_sum") + F.coalesce("far_sum", F.lit(0)))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return _named(out, names, keep), counts.select("a", "b", "n", "best")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_counts(read(spark, sf_dir, "documents"))[0]


SQL = {}
