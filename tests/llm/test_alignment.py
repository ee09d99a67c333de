"""Alignment against the tokenizer libraries and groups found one byte at a time."""

import random
from collections import Counter
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigspan.llm import alignment as al
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(al.TOKENIZER_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=al.TOKENIZER_B)


@pytest.fixture(scope="module")
def own():
    with open(al.TOKENIZER_B, "rb") as f:
        return al.Aligner(al.load_a(), f.read())


def brute(libraries, text):
    """Groups of one text: [([a ids], [b ids])]."""
    a, b = libraries
    if not text:
        return []
    want = (" " + text).encode()
    letters = al.byte_letters()
    ta = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    tb = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        tb.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    if b"".join(x for _, x in ta) != want or b"".join(x for _, x in tb) != want:
        return []
    ends = []
    for tokens in (ta, tb):
        at, e = 0, []
        for _, x in tokens:
            at += len(x)
            e.append(at)
        ends.append(e)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, low = [], 0
    for c in cuts:
        out.append(tuple([t[0] for t, e in zip(tokens, es) if low < e <= c] for tokens, es in zip((ta, tb), ends)))
        low = c
    return out


def brute_rows(libraries, texts):
    """The contract's columns of every text but the id."""
    groups = [brute(libraries, t) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    n = Counter(p for c in links for p in c)
    top = {}
    for (x, _), k in n.items():
        top[x] = max(top.get(x, 0), k)
    out = []
    for g, c in zip(groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(k for p, k in c.items() if n[p] == top[p[0]]),
            sum(k * n[p] for p, k in c.items()), sha256(text.encode()).hexdigest() if g else "",
        ))
    return out, n, top


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "", None, "a", " ", "  \t\n  ", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁literal", "naïve café 你好世界 😀👍🏽 ‍ é", "\x00\x01 \x7f", "x" * 5000, "ab " * 700,
    "\n" * 300, "1234567890 3.14", "don't we'll I'm", "日本語のテキスト" * 40, "tab\tand nbsp　wide", "end  ", " " * 40 + "x",
]


def test_odd_texts_together_and_alone(libraries, own):
    g = own.align(ODD)
    want = [brute(libraries, t) for t in ODD]
    assert g.by_text().tolist() == [len(x) for x in want] and g.na.tolist() == [sum(len(a) for a, _ in x) for x in want]
    text = [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in x) for x in want]
    assert g.digests() == [sha256(t.encode()).hexdigest() if t else "" for t in text]
    assert want[6] == [] and all(want[i] for i in range(2, 18) if i != 6)
    for t, x in zip(ODD, text):
        assert own.align([t]).written()[0].tobytes().decode() == x


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(libraries, own, texts):
    g = own.align(texts)
    assert g.digests() == [r[-1] for r in brute_rows(libraries, texts)[0]]


def test_links_in_slices(libraries, own, monkeypatch):
    texts = [prose(1, 60), "", "x" * 700, prose(2, 30) + " é你" * 30]
    for at_once in (1 << 22, 5):
        monkeypatch.setattr(al, "LINKS_AT_ONCE", at_once)
        codes, counts, offs = own.align(texts).pairs()
        for i, t in enumerate(texts):
            want = Counter((x, y) for a, b in brute(libraries, t) for x in a for y in b)
            got = {(int(c) // own.pb.size, int(c) % own.pb.size): int(k) for c, k in zip(codes[offs[i] : offs[i + 1]], counts[offs[i] : offs[i + 1]])}
            assert got == want


@pytest.mark.parametrize("hot", [al.HOT, 40, 0])
def test_counts_with_all_some_and_no_hot_pairs(spark, libraries, hot):
    texts = ODD + [prose(k, 30 + k) for k in range(25)] + [prose(3, 33)] * 20
    random.Random(1).shuffle(texts)
    rows, n, top = brute_rows(libraries, texts)
    df = spark.createDataFrame([(None if i == 4 else i // 2, t, "k", "c", "t") for i, t in enumerate(texts)], "doc_id long, text string, k0 string, codes string, times string")
    docs, counts = al.linked_counts(df.repartition(3), keep=["codes", "k0"], hot=hot)
    got = sorted(((r.doc_id is None, r.doc_id or 0), *[r[c] for c in COLUMNS]) for r in docs.collect())
    ids = [None if i == 4 else i // 2 for i in range(len(texts))]
    assert got == sorted(((i is None, i or 0), *r) for i, r in zip(ids, rows))
    assert docs.columns == ["doc_id", *COLUMNS, "codes", "k0"] and {(r.codes, r.k0) for r in docs.collect()} == {("c", "k")}
    assert {((r.a, r.b), r.n, r.best) for r in counts.collect()} == {(p, k, k == top[p[0]]) for p, k in n.items()}


def test_spans_and_empty_table(spark, libraries):
    texts = [prose(5, 20), "", "é你 x", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in al.align(df).collect():
        t, want = texts[r.doc_id], brute(libraries, texts[r.doc_id])
        assert r.a_ids == [x for a, _ in want for x in a] and r.b_ids == [x for _, b in want for x in b]
        assert (r.group_ends[-1:] or [0]) == [len((" " + t).encode()) if t else 0]
        assert r.group_ends == sorted(set(r.a_ends) & set(r.b_ends))
    empty = df.filter("doc_id < 0")
    assert al.align(empty).count() == 0 and al.linked_counts(empty)[0].count() == 0


def test_query_over_a_whole_table(spark, libraries):
    import pyarrow.parquet as pq

    from sigspan.llm.queries import QUERIES

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    rows, _, _ = brute_rows(libraries, table["text"])
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip(table["doc_id"], rows))
