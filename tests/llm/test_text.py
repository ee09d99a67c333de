import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sigspan.llm import licenses, mixing, pages, pieces, quality, toxicity
from sigspan.llm.queries import QUERIES

from .conftest import prose
from .test_dedup import WORD, brute_repeats, classes, shingles

SF = "/root/testdata/sf0.01"


# --- licences ---------------------------------------------------------------------------------
def test_license_scan(make_docs):
    mit = licenses.TEXTS[1][1]
    variant = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace("\n\n", "\n \n# ")
    rows = [(1, mit), (2, variant), (3, mit + " more"), (4, "a\n  * released under the MIT licence!\nb\nLicensed under CC BY-NC 4.0"), (5, None), (6, ""),
            (7, "x"), (7, "Released under the MIT License."), (None, "Released under the MIT License."), (8, "© 2020 X\nCopyright Y\nfoo")]
    got = {r.doc_id: r for r in licenses.scan(make_docs(rows)).collect()}
    assert got[1].license == got[2].license == "MIT" and got[1].digest == got[2].digest
    assert got[3].license is None and got[3].n_notices == 0
    assert (got[4].license, got[4].n_notices, got[4].notices) == (None, 2, "CC-BY-NC-4.0,MIT")
    assert got[5].digest == got[6].digest == hashlib.sha256(b"").hexdigest() and got[5].notices == ""
    assert got[7].n_notices == 1 and got[None].license == "MIT"
    assert got[8].digest == hashlib.sha256(b"foo").hexdigest()
    assert licenses.scan(make_docs([])).count() == 0


def test_license_scan_whole_texts_headers_and_own_table(spark, make_docs):
    text = {n: open(f"/usr/share/common-licenses/{n}").read() for n in ("Apache-2.0", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0")}
    gpl = ("/*\n * Copyright (C) 2020 X\n *\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General "
           "Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n"
           " * This program is distributed\n */\nint x;")
    apache = "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#   http"
    bsd = "Copyright (c) 2020, X\nAll rights reserved.\n\n" + licenses._BSD_GRANT.replace("modification,", "modification,\n") + "\n\n1. " + licenses._BSD_POINTS[0] + "\n\n2. " + licenses._BSD_POINTS[1] + "\n\n" + licenses._BSD_AS_IS.format("HOLDER")
    rows = [*enumerate(text.values()), (10, gpl), (11, apache), (12, bsd), (13, "The house rules.\nBe kind."), (14, "MIT\n\nyou may not\nuse this")]
    got = {r.doc_id: r for r in licenses.scan(make_docs(rows)).collect()}
    assert [got[i].license for i in range(5)] == ["Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"]
    assert (got[10].n_notices, got[10].notices) == (1, "GPL-3.0")
    assert (got[11].n_notices, got[11].notices) == (1, "Apache-2.0")
    assert got[12].license == "BSD-2-Clause" and got[13].license is None and got[14].n_notices == 0
    own = spark.createDataFrame([("House", "the HOUSE rules: be kind"), ("Empty", ""), (None, "x")], "license string, text string")
    with_own = {r.doc_id: r.license for r in licenses.scan(make_docs(rows), texts=own).collect()}
    assert with_own == {i: r.license for i, r in got.items()} | {13: "House"}


# --- mixing -----------------------------------------------------------------------------------
def brute_targets(sizes, weights=mixing.WEIGHTS, share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            free.remove(s)
    return out


def brute_seats(claims, total):
    seats = dict.fromkeys(claims, 0)
    for _ in range(total):
        best = max(claims, key=lambda s: (claims[s] / (2 * seats[s] + 1), [-ord(c) for c in s]))
        seats[best] += 1
    return seats


def test_mix(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    got = mixing.mix(docs, shard_docs=5).collect()
    assert len(got) == len(edge_rows)
    size = {}
    for _, t, *s in edge_rows:
        s = s[0] if s else "a"
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(size)
    by_size = {(r.source_size, round(r.target, 3)) for r in got}
    assert by_size == {(size[s], round(want[s], 3)) for s in size}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
    for s in size:
        taken = sum(r.taken for r in got if r.source_size == size[s])
        assert abs(taken - want[s]) <= 64 * 12, (s, taken, want[s])
    again = mixing.mix(docs.repartition(7), shard_docs=5).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert mixing.mix(make_docs([])).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(make_docs([(1, None), (2, "", None)])).collect())


def test_mix_small_source_of_short_documents(make_docs):
    # about one short document of "a" in each of 226 shards, beside a hot source
    rows = [(k, prose(k, 10 + k % 21), "a") for k in range(300)] + [(1000 + k, prose(k, 100), "b") for k in range(600)]
    got = mixing.mix(make_docs(rows), shard_docs=4).collect()
    size = {"a": sum(10 + k % 21 for k in range(300)), "b": 60000}
    want = brute_targets(size)
    assert want["a"] == 2 * size["a"]
    for s in size:
        of = [r for r in got if r.source_size == size[s]]
        assert all(0 <= r.taken <= 2 * r["size"] for r in of)
        assert abs(sum(r.taken for r in of) / want[s] - 1) < 0.01, s


def test_mix_many_tiny_sources(make_docs):
    # 200 sources of about 80 words beside a hot one: every source meets its target
    rows = [(k, prose(k, 70 + k % 21), f"s{k:03d}") for k in range(200)] + [(1000 + k, prose(k, 200), "big") for k in range(100)]
    got = mixing.mix(make_docs(rows)).collect()
    of = {r.doc_id: r for r in got}
    for k in range(200):
        r = of[k]
        assert r.taken <= 2 * r["size"] and 0.985 <= r.taken / r.target <= 1.015, r
    big = [r for r in got if r.doc_id >= 1000]
    assert abs(sum(r.taken for r in big) / big[0].target - 1) < 0.01


@pytest.mark.parametrize("seed", range(4))
def test_seats_are_highest_quotients(spark, seed):
    r = random.Random(seed)
    claims = {f"s{k:02d}": r.choice([0.0, r.random() * 5, r.random() * 500]) for k in range(r.randrange(2, 15))}
    claims["s99"] = 3.0
    total = r.randrange(0, 400)
    parts = spark.createDataFrame([(s, c, total, 0) for s, c in claims.items()], "s string, claim double, total long, g int")
    got = {x.s: x.seats for x in mixing.apportion(parts, ["g"], "claim", "total", [F.col("s")]).collect()}
    want = brute_seats({s: c for s, c in claims.items() if c > 0}, total)
    assert got == want


# --- SentencePiece ----------------------------------------------------------------------------
@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.Vocabulary.load())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" abcdehinorst.,\n\té你😀ñTHE▁\u0000")), max_size=120), max_size=6))
def test_pieces_equal_the_library(encoder, library, texts):
    ids, offs = encoder.encode(pa.array([*texts, None], pa.string()))
    for k, t in enumerate(texts):
        own = ids[offs[k] : offs[k + 1]]
        assert own.tolist() == library.encode(t)
        assert encoder.decode(own) == t.replace("▁", " ")
    assert offs[-1] == offs[-2]


def test_pieces_on_frames(make_docs, edge_rows, library):
    docs = make_docs(edge_rows)
    enc = pieces.encode(docs, keep=["doc_id", "text"])
    for r in enc.collect():
        assert r["ids"] == library.encode(r.text or "")
    back = pieces.decode(enc.select("doc_id", "ids", F.col("text").alias("was")), keep=["doc_id", "was"])
    assert back.filter("text <> coalesce(was, '')").count() == 0
    assert pieces.encode(make_docs([])).count() == 0


# --- pages ------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>Cookies</p></div>
<article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>word<br>next &lt;x&gt;&nbsp;y<p>Open &#233;&eacute;
 <div class="comments"><p>Reader</p></div><ul><li>one<li>two</ul><form><input><p>Name</p></form></article>
<aside>Side</aside><div class="ad">Buy</div><footer>Foot</footer></body></html>"""


def test_page_lines():
    assert [t for _, t in pages.page_lines(PAGE)] == ["Head & line", "First boldword next <x> y", "Open éé", "one", "two"]
    assert pages.page_lines(None) == pages.page_lines("") == []
    assert [t for _, t in pages.page_lines("<article><p>cut te")] == ["cut te"]
    assert [t for _, t in pages.page_lines("<article><p>cut</p><p clas")] == ["cut"]
    assert [t for _, t in pages.page_lines("<p>a<!-- open <p>b")] == ["a"]
    assert [t for _, t in pages.page_lines("plain & <3 text")] == ["plain & <3 text"]


@pytest.mark.parametrize("wrapper", ["class='layout has-sidebar'", "id='search-results'", "class='page-social'", "class='sidebar'", "role=search"])
def test_article_below_marked_wrapper(wrapper):
    page = f"<body><div {wrapper}><p>menu</p><article><h1>Title</h1><p>Text</p><div class='comments'><article><p>Reader</p></article></div></article></div></body>"
    lines = pages.page_lines(page)
    assert [t for m, t in lines if m] == ["Title", "Text"]
    assert "Reader" not in [t for _, t in lines]


def test_furniture_stays_out():
    page = ("<main><p>Text</p><div class='share-buttons'>Share</div><div hidden><article>gone</article></div></main>"
            "<nav><article>nav</article></nav><div class='related'><article>Teaser</article></div><div class='site-footer'>Foot</div>")
    assert pages.page_lines(page) == [(True, "Text")]
    assert pages.page_lines("<div class='comments'><article class='comment'>Reader</article></div><p>a</p>") == [(False, "a")]
    assert pages.page_lines("<div style='display: none'><article>gone</article></div>") == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_shared_lines_is_an_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    got = [a[i] for i in sorted(pages.shared_lines(a, b))]
    assert len(got) == best[-1][-1]
    it = iter(b)
    assert all(x in it for x in got)


def test_pages_are_differenced(spark):
    shell = "<body><p>Site name</p><p>{}</p><p>{}</p><p>All rights</p></body>"
    rows = [(k, f"http://www.h.org/en/{k}", shell.format(f"own {k}", prose(k, 5)), "x") for k in range(12)]
    rows += [(20, "http://solo.net/a", shell.format("s", "t"), "x"), (21, None, None, "x"), (22, "http://h.org/z", PAGE, "x"), (23, "http://[bad", "", "x"),
             (3, "http://www.h.org/en/3", rows[3][2], "x"), (30, "http://h.org/en/3?copy", rows[3][2], "x"), (31, "http://h.org/en/3b", rows[3][2], "x")]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for k in (0, 5, 11):
        assert by[k].text == f"own {k}\n{prose(k, 5)}" and by[k].n_chars == len(by[k].text)
    # copies, also at other paths of the host, keep their own lines
    assert [r.text for r in got if r.page_id in (3, 30, 31)] == [f"own 3\n{prose(3, 5)}"] * 4
    assert by[20].text == "Site name\ns\nt\nAll rights"
    assert by[21].text == by[23].text == "" and by[22].text.startswith("Head & line")
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_brute(spark):
    import html
    import re

    got = {r.page_id: r.text for r in QUERIES["op9_main_text"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [re.sub(r"<[a-z/!][^>]*$", "", re.sub(r"</?b>", "", p.replace("<br>", " "))) for p in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(filter(None, (" ".join(html.unescape(p).split()) for p in parts)))


# --- classifiers ------------------------------------------------------------------------------
def test_attention_gradient():
    r = np.random.default_rng(0)
    x, offs, y = r.normal(size=(9, 4)), np.array([0, 2, 5, 9]), np.array([1.0, 0.0, 1.0])
    m = quality.GatedAttention(4)
    loss = lambda: -np.mean(y * np.log(m.forward(x, offs)["y"]) + (1 - y) * np.log(1 - m.forward(x, offs)["y"]))
    before = loss()
    m.fit(x, offs, y)
    assert loss() < before / 4
    assert m.score(np.zeros((0, 4)), np.zeros(1, int)).size == 0


def test_quality_held_out(spark):
    got = QUERIES["op6_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    assert got.score.between(0, 1).all()


def test_toxicity_held_out(spark):
    got = QUERIES["op7_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9 and held[held.toxic == 0].predicted.mean() < 0.03


def test_toxicity_learns_a_long_tailed_lexicon(spark):
    """150 terms dealt evenly, each in under 1 % of the toxic texts; three letters are enough for an exact term."""
    import random

    r = random.Random(8)
    letters = "bcdfghjklmnprstvz"
    terms = ["".join(r.choice(letters) + r.choice("aeiou") for _ in range(3)) + r.choice(letters) for _ in range(149)] + ["zqx"]
    rows = []
    for i in range(6000):
        words = prose(i, 25, 900).split()
        if i % 2:
            words[r.randrange(25)] = terms[i // 2 % 150]
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    test = quality.held_out(F.col("doc_id"), 4, 2)
    scorer = toxicity.train(docs, labels, ~test)
    got = toxicity.score(docs, scorer).filter(test).join(labels, "doc_id").toPandas()
    said = got.score >= toxicity.THRESHOLD
    assert (got[said].toxic == 1).mean() >= 0.95 and said[got.toxic == 1].mean() >= 0.9


def test_label_sample_counts_documents_that_are_there(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    labels = spark.range(20000).select((F.col("id") - 10000).alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    got = quality.labelled_sample(docs, labels, "quality", F.lit(True), 40).collect()
    assert len(got) == 40 and all(r.text == f"t{r.doc_id}" and r.label == r.doc_id % 2 for r in got)


def test_classifier_edges(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    some = spark.createDataFrame([(10, 1, 0, "x"), (46, 0, 0, "x"), (47, 0, None, "x"), (11, None, 0, "x"), (None, 1, 1, "x"), (999, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")
    for labels in (some, some.filter("false"), some.filter("quality = 1")):
        out = quality.score(docs, quality.train(docs, labels, F.lit(True))).collect()
        assert len(out) == len(edge_rows) and all(0 <= r.score <= 1 for r in out)
        out = toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))).collect()
        assert len(out) == len(edge_rows) and all(0 <= r.score <= 1 for r in out)
    none = make_docs([])
    assert quality.score(none, quality.train(none, some, F.lit(True))).count() == 0
    assert toxicity.score(none, toxicity.train(none, some, F.lit(True))).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abdiotx", min_size=1, max_size=12))
def test_automaton_is_the_edit_distance(word):
    entries = [(b"idiot", False), (b"bad", False), (b"abidiotox", False), (b"tobi", True)]
    a = toxicity.Automaton(entries)
    raw, f, s, e, _ = toxicity.folded(pa.array([word]))
    at, entry, edits = a.matches(f, s, e)
    want = []
    for i, (t, stem) in enumerate(entries):
        d = min(edit_distance(word[:k].encode(), t) for k in range(len(word) + 1)) if stem else edit_distance(word.encode(), t)
        if d <= toxicity.edits_allowed(t, stem):
            want.append((d, i))
    assert [(int(d), int(i)) for d, i in zip(edits, entry, strict=True)] == ([min(want)] if want else [])


def test_context_separates_quotation():
    s = toxicity.Scorer(toxicity.Lexicon([(b"idiot", False)], {(0, 0): 0.9}))
    abuse, quoted, fuzzy, clean, empty = s.scores(pa.array(["what an idiot this is", "the word “idiot” is old", "what an idi0t", "a fine day", None]))
    assert abuse > 0.8 > quoted > clean == empty and 0.3 < fuzzy < abuse


# --- pipeline ---------------------------------------------------------------------------------
def test_pipeline_stages(spark, make_docs, edge_rows, library, tmp_path):
    docs = make_docs(edge_rows)
    spark.createDataFrame([(i, int(len(set((t or "").split())) > 3), 0) for i, t, *_ in edge_rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    fns = dict(corpus_pipeline.STAGES)
    assert list(fns) == ["quality", "near_duplicates", "repeated_passages", "source_mix", "tokens"]
    for f in list(fns.values())[:-1]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert f(spark, make_docs([]), str(tmp_path)).count() == 0
    want = classes({i: shingles(t) for i, t, *_ in edge_rows if i is not None})
    kept = sorted(r.doc_id for r in fns["near_duplicates"](spark, docs, "").filter("doc_id is not null").collect())
    assert kept == sorted(i for i, *_ in edge_rows if i is not None and want[i] == i)
    gone = brute_repeats(edge_rows)
    for r in fns["repeated_passages"](spark, docs, "").filter("doc_id is not null").collect():
        n, lost, digest = gone.get(r.doc_id, (0, 0, None))
        assert len(WORD.findall(r.text or "")) == n - lost
    mixed = fns["source_mix"](spark, docs, "").collect()
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    out = {}
    for r in mixed:
        out[r.doc_id] = out.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert out == {k: v for k, v in taken.items() if v}
    for r in fns["tokens"](spark, docs, "").join(docs.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id") == F.col("i")).filter("doc_id <> 44").collect():
        assert r["ids"] == library.encode(r.text or "") and r.n_tokens == len(r["ids"])


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.n_tokens == len(r["ids"]) > 0 for r in rows)
