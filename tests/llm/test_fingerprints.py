"""Fingerprints against a walk written step by step, and what the likeness means."""

import random
from hashlib import sha256

import numpy as np
import pytest

from sigspan.llm import fingerprints as fp
from tests.llm.conftest import prose

F = fp.Fingerprinter()
MASK = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def slow_fingerprint(text):
    """One step at a time, from the random bits themselves."""
    if not text:
        return "-" * fp.SLOTS
    n = 1 << fp.CLOCK_BITS
    go = np.random.default_rng([5, 1]).random((1 << fp.CLASS_BITS, n)) < 0.5
    seen, i, step = [], 0, 0
    while i < len(text):
        seen.append(i)
        if go[mix(ord(text[i]) + 1) >> (64 - fp.CLASS_BITS), step % n]:
            i += 1
        step += 1
    out = []
    for k, r in enumerate(fp.slot_records()):
        at = seen[max(int(x) for x in r if x < len(seen))]
        h = int(F.salts[k])
        for j in range(fp.CONTEXT):
            h += (ord(text[at + j]) + 1 if at + j < len(text) else 0) * int(F.factors[j])
        out.append("0123456789abcdef"[mix(h & MASK) >> 60])
    return "".join(out)


def near(a, b):
    x, y = (np.frombuffer(v.encode(), np.uint8) for v in (a, b))
    return float(fp.likeness(x, y))


def slow_edited(rows):
    """Rows (doc_id, text) in the order of ids: edited text of each."""
    out = []
    for i, (_, t) in enumerate(rows):
        h = len(t) // 2
        out.append(t[: len(t) - h] + rows[(i + 1) % len(rows)][1][:h])
    return out


TEXTS = ["", "a", "ab", "abc", "é你😀 x", "same " * 300, prose(1, 300), prose(2, 40), "x" * 9000, "\x00\n tab", prose(3, 3000)]


def test_walk_equals_the_slow_one_side_by_side_and_alone():
    texts = TEXTS + [prose(k, 5 + k) for k in range(120)]  # more than NARROW: both ways of walking
    many = fp._strings(fp.Chunk(F, texts).fingerprints()).to_pylist()
    assert many == [slow_fingerprint(t) for t in texts]
    for t in texts[:12]:
        assert fp._strings(fp.Chunk(F, [t]).fingerprints()).to_pylist() == [slow_fingerprint(t)]


def test_records_are_drawn_evenly_and_stay():
    steps = F.sampled_steps(np.array([1, 10, 1000, 1010]))
    assert (steps[0] == 0).all() and (steps < np.array([1, 10, 1000, 1010])[:, None]).all()
    assert (steps[2] == steps[3]).mean() > 0.95 and abs(steps[2].mean() / 1000 - 0.5) < 0.1


@pytest.fixture(scope="module")
def rows():
    texts = TEXTS + [prose(k, 5 + k % 50) for k in range(200)]
    random.Random(4).shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def test_edited_copies_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(fp, "CHUNK", 3000)  # many chunks, so that rows are held over
    df = spark.createDataFrame([(i, t, "e", "p", "a", "t") for i, t in rows], "doc_id long, text string, edited string, piece string, ahead string, tie string")
    got = {r["doc_id"]: r for r in fp.edited_copies(df.repartition(5), keep=["tie", "edited"]).toDF("doc_id", "n_chars", "new", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "tie", "edited").collect()}
    assert len(got) == len(rows)
    marks = [slow_fingerprint(t) for _, t in rows]
    for k, ((i, t), e) in enumerate(zip(rows, slow_edited(rows))):
        r = got[i]
        assert (r["n_chars"], r["new"], r["fingerprint"], r["edited_fingerprint"], r["tie"], r["edited"]) == (len(t), e, marks[k], slow_fingerprint(e), "t", "e")
        assert abs(r["near_edited"] - near(marks[k], slow_fingerprint(e))) < 1e-12
        assert abs(r["near_next"] - near(marks[k], marks[(k + 1) % len(rows)])) < 1e-12


def test_nulls_ties_single_and_empty_tables(spark, edge_rows, make_docs):
    got = fp.edited_copies(make_docs(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    known = sorted((r for r in edge_rows if r[0] is not None), key=lambda r: r[0])
    texts = [t or "" for _, t, _ in known]
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert (r.fingerprint == "-" * fp.SLOTS) == (r.n_chars == 0) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for r in by[None]:
        assert r.near_next == 0 and len(r.edited) == r.n_chars - r.n_chars // 2
    for k, (i, _, _) in enumerate(known):
        if i not in (42, 44, 45):  # next to the repeated id 44, or of it
            t, f = texts[k], texts[(k + 1) % len(texts)]
            assert by[i][0].edited == t[: len(t) - len(t) // 2] + f[: len(t) // 2]
    assert by[1][0].fingerprint == by[2][0].fingerprint and by[1][0].near_next == 1.0
    alone = fp.edited_copies(make_docs([(5, "abcdef", "a")])).collect()
    assert [(r.edited, r.near_next) for r in alone] == [("abcabc", 1.0)]
    assert fp.edited_copies(make_docs([])).collect() == []
    assert fp.fingerprints(make_docs(edge_rows), keep=["key"]).count() == len(edge_rows)


def test_hot_ids_are_spread_and_keep_their_order(spark):
    """A third of all rows repeat one id: they follow each other by hash, over several pieces."""
    data = [(7 if i % 3 == 0 else i, prose(i, 20)) for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    dealt = fp.in_order(df).filter("ahead = 0 and doc_id = 7").select("piece").distinct().count()
    assert dealt > 1
    from pyspark.sql import Window
    from pyspark.sql import functions as SF

    w = Window.orderBy("doc_id", SF.xxhash64("text"))
    want = {(r.text, r.nxt) for r in df.withColumn("nxt", SF.lead("text").over(w)).collect() if r.nxt is not None}
    got = {(r.text, r.edited) for r in fp.edited_copies(df, keep=["text"]).collect()}
    assert {(t, t[: len(t) - len(t) // 2] + n[: len(t) // 2]) for t, n in want} <= got


def test_likeness_follows_edits():
    base = prose(9, 800)
    words = base.split()
    few = " ".join("changed" if k == 700 else w for k, w in enumerate(words))
    many = " ".join("changed" if k % 20 == 3 else w for k, w in enumerate(words))
    half = base[: len(base) // 2] + prose(77, 800)[: len(base) // 2]
    m = {k: slow_fingerprint(t) for k, t in (("base", base), ("few", few), ("many", many), ("half", half), ("other", prose(10, 800)))}
    like = {k: near(m["base"], v) for k, v in m.items()}
    assert like["base"] == 1 and like["few"] > 0.8 and 0.4 < like["half"] < 0.6 and like["other"] < 0.1
    assert like["few"] > like["many"] > like["other"]


def test_near_classes_against_all_pairs(spark):
    texts = []
    for g in range(6):
        words = prose(50 + g, 250).split()
        for c in range(7):
            w = list(words)
            if c:
                w[-5 * c] = f"new{c}"
            texts.append(" ".join(w))
    texts += [texts[0]] * 30 + [prose(200 + k, 100) for k in range(20)] + ["", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    marks = [slow_fingerprint(t or "") for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] and texts[j] and near(marks[i], marks[j]) >= fp.LIKENESS:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(len(texts))}
    for block in (fp.BLOCK, 4):
        got = {r.doc_id: r.component_id for r in fp.near_classes(df, block=block).collect()}
        assert got.pop(None) is None and got == want
    assert len(set(want.values())) < len(texts) - 60


def test_query_over_a_whole_table(spark):
    import pyarrow.parquet as pq

    from sigspan.llm.queries import QUERIES

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows = sorted(zip(table["doc_id"], [t or "" for t in table["text"]]))
    edited = slow_edited(rows)
    got = {r.doc_id: r for r in QUERIES["op12_fingerprints"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for (i, t), e in zip(rows, edited):
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == sha256(e.encode()).hexdigest()
    for (i, t), e in list(zip(rows, edited))[::20]:
        assert got[i].fingerprint == slow_fingerprint(t) and got[i].edited_fingerprint == slow_fingerprint(e)
