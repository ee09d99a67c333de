"""Toxicity scores: Levenshtein automata over a lexicon trie, weighed by context windows.

Method. A lexicon (terms, and stems that take any ending) is learned from labelled documents. Its
trie is intersected with the Levenshtein automata of its entries: a state is the set of (trie
node, edits) pairs that a word's letters can reach, and the sets are determinised into one table.
Every word of every text runs through the table, all words of a chunk at once, one letter a step;
words whose state dies leave the run. A match counts with the weight of its term at its number
of edits, learned from the same labels, times the weight of its context: a window of words around
it with quotation marks, reporting or defining words points to quotation, words of address point
to abuse. A document scores 1 - product of (1 - weight).

Edits allowed by length of a term: none below 5 letters, 1 below 9, then 2; stems allow one from
6 letters on. The fit uses at most ``TRAIN_DOCS`` labelled documents, those with the smallest
xxhash64 of their id. A term needs ``MIN_DOCS`` toxic documents, purity, and a likelihood ratio beyond chance for as
many tries as there are words; no share of the toxic documents, so rare terms of a long lexicon are learned.

Defined cases: a null or blank text scores the base rate of texts without a match; unlabelled
rows and null labels train nothing; without toxic labels the lexicon is empty; repeated rows are
scored each by itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, chunks, read, text_bytes
from .quality import held_out, labelled_sample

TRAIN_DOCS = 12_000
MIN_DOCS = 4
BEYOND = 1.0  # log-likelihood ratio asked above the logarithm of the number of words: about 0.04 words by chance
WORD_BYTES = (3, 200)  # of words that may become terms
PURITY = 0.8  # least share of toxic documents among those with the term, weighed to equal classes
STEM_LETTERS = (4, 8)
STEM_ENDINGS = 4  # different endings that make a stem of a shared beginning
BASE = 0.02
WINDOW = 6
THRESHOLD = 0.3
QUOTED, ADDRESSED = 0.35, 1.15
# Words that report or define, and words of address.
REPORTING = {b"said", b"says", b"quote", b"quoted", b"quotes", b"word", b"words", b"term", b"terms", b"means", b"meaning", b"called", b"defined", b"definition", b"mot", b"wort", b"palabra"}
ADDRESS = {b"you", b"your", b"youre", b"u", b"du", b"dich", b"tu", b"toi", b"vous", b"te"}
_QUOTES = np.frombuffer(b"\"'`", np.uint8)

# letters and digits are word bytes, and all bytes of characters beyond ASCII (see _typographic)
_FOLD = np.zeros(256, np.uint8)
_FOLD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = list(b"abcdefghijklmnopqrstuvwxyz0123456789")
_FOLD[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = list(b"abcdefghijklmnopqrstuvwxyz")
_FOLD[128:] = np.arange(128, 256)


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Raw bytes, folded bytes (0 between words), word starts, word ends, word offsets by text."""
    raw, offs = text_bytes(texts)
    f = _FOLD[raw]
    n = len(raw)
    if n > 2:  # general punctuation (U+2010..U+203F) and guillemets separate words
        p = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x80))
        for k in range(3):
            f[p + k] = 0
        g = np.flatnonzero((raw[:-1] == 0xC2) & ((raw[1:] == 0xAB) | (raw[1:] == 0xBB) | (raw[1:] == 0xA0)))
        f[g] = 0
        f[g + 1] = 0
    word = f != 0
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:] = word[:-1]
        after[:-1] = word[1:]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return raw, f, starts, ends, np.searchsorted(starts, offs)


def edits_allowed(entry: bytes, stem: bool) -> int:
    n = len(entry)
    if stem:
        return int(n >= 6)
    return 0 if n < 5 else 1 if n < 9 else 2


@dataclass
class Lexicon:
    """Entries, and for each entry and number of edits the weight of a match."""

    entries: list[tuple[bytes, bool]] = field(default_factory=list)  # (letters, is a stem)
    weights: dict[tuple[int, int], float] = field(default_factory=dict)

    @staticmethod
    def prior(edits: int) -> float:
        """Weight of a match that the labelled sample did not show."""
        return 0.9 * 0.6**edits

    def weight(self, entry: int, edits: int) -> float:
        return self.weights.get((entry, edits), self.prior(edits))


class Automaton:
    """Deterministic table of the lexicon trie intersected with its Levenshtein automata.

    ``table[state, letter class]`` is the next state (0 is dead); ``found[state]`` gives entry and
    edits of the best match of a word that ends in the state.
    """

    def __init__(self, entries: list[tuple[bytes, bool]]):
        letters = sorted({c for e, _ in entries for c in e})
        self.classes = np.zeros(256, np.int64)
        for k, c in enumerate(letters):
            self.classes[c] = k + 1
        # trie; each node knows the most edits that an entry below it allows
        child: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        room = [0]
        for i, (e, stem) in enumerate(entries):
            k, at = edits_allowed(e, stem), 0
            room[0] = max(room[0], k)
            for c in e:
                if c not in child[at]:
                    child[at][c] = len(child)
                    child.append({})
                    ends.append([])
                    room.append(0)
                at = child[at][c]
                room[at] = max(room[at], k)
            ends[at].append(i)

        def closed(pairs: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            """With letters left out; the fewest edits of each node; open stems absorb."""
            best: dict[int, int] = {}
            todo = list(pairs)
            while todo:
                at, e = todo.pop()
                if at < 0:
                    best[at] = min(best.get(at, 9), e)
                    continue
                if e > room[at] or best.get(at, 9) <= e:
                    continue
                best[at] = e
                for i in ends[at]:
                    if entries[i][1] and e <= edits_allowed(*entries[i]):
                        todo.append((-i - 1, e))
                todo.extend((to, e + 1) for to in child[at].values())
            return frozenset(best.items())

        def step(state: frozenset, c: int) -> frozenset:
            out = set()
            for at, e in state:
                if at < 0:
                    out.add((at, e))
                    continue
                out.add((at, e + 1))  # a letter too many
                for letter, to in child[at].items():
                    out.add((to, e + (letter != c)))
            return closed(out)

        def best(state: frozenset) -> tuple[int, int]:
            found = [(e, -at - 1) for at, e in state if at < 0]
            found += [(e, i) for at, e in state if at >= 0 for i in ends[at] if not entries[i][1] and e <= edits_allowed(*entries[i])]
            return (min(found)[1], min(found)[0]) if found else (-1, 0)

        start = closed({(0, 0)}) if entries else frozenset()
        number = {frozenset(): 0, start: 1}
        states = [frozenset(), start]
        rows = [[0] * (len(letters) + 1)]
        at = 1
        while at < len(states):
            row = []
            for c in [-1, *letters]:
                to = step(states[at], c)
                if to not in number:
                    number[to] = len(states)
                    states.append(to)
                row.append(number[to])
            rows.append(row)
            at += 1
        self.table = np.array(rows, np.int32)
        self.found = np.array([best(s) for s in states], np.int32)

    def matches(self, f: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of matching words, their entries and edits."""
        if len(self.table) < 2:
            return (np.zeros(0, np.int64),) * 3
        code = self.classes[f]
        live = np.arange(len(starts))
        state = np.ones(len(starts), np.int32)
        at = starts.copy()
        done_word, done_state = [], []
        while len(live):
            state = self.table[state, code[at]]
            at = at + 1
            over = (at == ends[live]) & (state != 0)
            done_word.append(live[over])
            done_state.append(state[over])
            go = (state != 0) & (at < ends[live])
            live, state, at = live[go], state[go], at[go]
        word, end = np.concatenate(done_word), np.concatenate(done_state)
        hit = self.found[end, 0] >= 0
        order = np.argsort(word[hit], kind="stable")
        end = end[hit][order]
        return word[hit][order], self.found[end, 0], self.found[end, 1]


def word_counts(sample: DataFrame) -> DataFrame:
    """``(word, toxic, clean)``: documents that hold each word of ``WORD_BYTES``, by label.

    A document counts a word once, and documents that have it after the same word count as one,
    so that copies of a document do not make its words look like terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            _, f, starts, ends, offs = folded(b.column(1))
            raw = f.tobytes()
            words, before, toxic = [], [], []
            for d, label in enumerate(b.column(0).to_pylist()):
                seen: dict[bytes, bytes] = {}
                last = b""
                for i, j in zip(starts[offs[d] : offs[d + 1]].tolist(), ends[offs[d] : offs[d + 1]].tolist(), strict=True):
                    w = raw[i:j]
                    if WORD_BYTES[0] <= j - i <= WORD_BYTES[1]:
                        seen.setdefault(w, last[:40])
                    last = w
                words += seen
                before += seen.values()
                toxic += [label] * len(seen)
            yield batch({"word": pa.array(words, pa.binary()), "before": pa.array(before, pa.binary()), "toxic": pa.array(toxic, pa.int32())})

    words = sample.select("label", "text").mapInArrow(run, "word binary, before binary, toxic int")
    once = words.groupBy("word", "before").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("all_toxic"))
    return once.groupBy("word").agg(F.sum("toxic").cast("long").alias("toxic"), F.sum(1 - F.col("all_toxic")).cast("long").alias("clean"))


def choose_entries(counts: DataFrame, toxic_docs: int, clean_docs: int) -> list[tuple[bytes, bool]]:
    """Terms and stems from :func:`word_counts`.

    An entry needs ``MIN_DOCS`` toxic documents and purity. A beginning is a stem if it is as pure as its words and
    at least ``STEM_ENDINGS`` words share it, none of them holding most of its support. Only
    entries reach the driver: words of the bounded sample, each in ``MIN_DOCS`` of its documents.
    """
    if not toxic_docs:
        return []
    balance = clean_docs / toxic_docs if clean_docs else 1.0
    pure = (F.col("toxic") >= MIN_DOCS) & (F.col("toxic") * balance >= PURITY * (F.col("toxic") * balance + F.col("clean")))
    counts = counts.persist(StorageLevel.DISK_ONLY)
    # more than chance: log-likelihood ratio against the toxic share, for as many tries as words
    share = toxic_docs / (toxic_docs + clean_docs)
    t, c = F.col("toxic"), F.col("clean")
    ratio = t * F.log(t / (t + c) / share) + F.when(c > 0, c * F.log(c / (t + c) / max(1 - share, 1e-9))).otherwise(0.0)
    tries = math.log(max(1, counts.count())) + BEYOND if clean_docs else 0.0
    terms = [bytes(r["word"]) for r in counts.filter(pure & (ratio >= tries)).select("word").collect()]
    sizes = F.sequence(F.lit(STEM_LETTERS[0]), F.least(F.lit(STEM_LETTERS[1]), F.length("word")))
    starts = counts.select(F.explode(F.transform(sizes, lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("stem"), "toxic", "clean")
    starts = starts.groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.max("toxic").alias("top"), F.count(F.when(F.col("toxic") > 0, 1)).alias("endings"))
    starts = starts.filter(pure & (ratio >= 1.5 * tries) & (F.col("endings") >= STEM_ENDINGS) & (F.col("top") <= 0.5 * F.col("toxic")))
    found = {bytes(r["stem"]): r["toxic"] for r in starts.select("stem", "toxic").collect()}
    counts.unpersist()
    stems: list[bytes] = []
    for p in sorted(found, key=lambda p: (len(p), p)):
        if any(p.startswith(s) or s.startswith(p) for s in stems):
            continue
        longer = p
        while longer:  # the longest beginning that keeps nearly all of the support
            p = longer
            longer = next((q for q in found if len(q) == len(p) + 1 and q.startswith(p) and found[q] >= 0.95 * found[p]), b"")
        if p[-1] < 128:
            stems.append(p)
    return [(w, False) for w in sorted(terms) if not any(w.startswith(s) for s in stems)] + [(s, True) for s in stems]


class Scorer:
    """A lexicon with its automaton; scores chunks of texts."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = Automaton(lexicon.entries)

    def found(self, texts: pa.Array) -> list[list[tuple[int, int, float]]]:
        """For each text its matches: entry, edits, weight of the context."""
        raw, f, starts, ends, offs = folded(texts)
        word, entry, edits = self.automaton.matches(f, starts, ends)
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(texts))]
        doc = np.searchsorted(offs, word, "right") - 1
        for w, d, i, e in zip(word.tolist(), doc.tolist(), entry.tolist(), edits.tolist(), strict=True):
            out[d].append((i, e, self.context(raw, f, starts, ends, int(offs[d]), int(offs[d + 1]), w)))
        return out

    @staticmethod
    def context(raw, f, starts, ends, first: int, last: int, w: int) -> float:
        lo, hi = max(first, w - WINDOW), min(last, w + WINDOW + 1)
        left = raw[starts[lo] : starts[w]]
        right = raw[ends[w] : ends[hi - 1]]
        tail = raw[ends[w] : min(len(raw), ends[hi - 1] + 3)]
        quoted = bool((np.isin(left, _QUOTES).any() and (np.isin(right, _QUOTES).any() or np.isin(tail, _QUOTES).any())) or
                      b"\xc2\xab" in left.tobytes() or b"\xe2\x80\x9c" in left.tobytes() or b"\xe2\x80\x9e" in left.tobytes())
        near = {f[starts[k] : ends[k]].tobytes() for k in range(lo, hi) if k != w}
        weight = QUOTED if quoted or not near.isdisjoint(REPORTING) else 1.0
        return weight * (ADDRESSED if not near.isdisjoint(ADDRESS) else 1.0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), BASE)
        for d, hits in enumerate(self.found(texts)):
            rest = 1 - BASE
            for i, e, c in hits:
                rest *= 1 - min(0.995, self.lexicon.weight(i, e) * c)
            out[d] = 1 - rest
        return out


def train(docs: DataFrame, labels: DataFrame, allowed: Column, bound: int = TRAIN_DOCS) -> Scorer:
    """Lexicon from the bounded sample, then the weight of each entry at each number of edits."""
    sample = labelled_sample(docs, labels, "toxic", allowed, bound).withColumn("label", F.col("label").cast("int"))
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    lexicon = Lexicon(choose_entries(word_counts(sample), toxic, clean))
    if not lexicon.entries:
        return Scorer(lexicon)
    draft = docs.sparkSession.sparkContext.broadcast(Scorer(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            seen: Counter = Counter()
            for label, hits in zip(b.column(0).to_pylist(), draft.value.found(b.column(1)), strict=True):
                seen.update({(i, e, label) for i, e, _ in hits})
            keys = list(seen)
            yield batch({n: pa.array([k[j] for k in keys], pa.int32()) for j, n in enumerate(("entry", "edits", "label"))} | {"n": pa.array([seen[k] for k in keys], pa.int64())})

    hits = sample.select("label", "text").mapInArrow(run, "entry int, edits int, label int, n bigint").groupBy("entry", "edits", "label").agg(F.sum("n").alias("n"))
    seen: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
    for r in hits.collect():  # at most entries x edits x labels
        seen[r["entry"], r["edits"]][r["label"]] += r["n"]
    share = toxic / (toxic + clean) if clean else 0.0
    for (i, e), (c, t) in seen.items():
        # share of toxic documents among those with the match, beyond the share among all
        precise = (t + 2 * (share + (1 - share) * Lexicon.prior(e))) / (t + c + 2)
        lexicon.weights[i, e] = max(0.0, (precise - share) / (1 - share))
    return Scorer(lexicon)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``(doc_id, score)`` of every row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            yield batch({"doc_id": b.column(0), "score": pa.array(shared.value.scores(b.column(1)))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    test = held_out(F.col("doc_id"), 4, 2)
    scorer = train(docs, read(spark, sf_dir, "labels"), ~test)
    return score(docs, scorer).select(
        "doc_id", test.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


SQL = {}
