"""Wrapping of licence texts, typeset punctuation, and page differencing between near copies."""

import hashlib
import re
import textwrap

import pytest

from sigspan.llm import licenses, pages

KNOWN = {d: k for d, k in licenses.fixed_digests()}
DATED = re.compile(r"\s*(copyright|\(c\)).*(\d{4}|<year>|\[yyyy\]|\(c\))", re.I)


def wrapped(text, width):
    """Paragraphs filled to ``width``; copyright lines stay lines."""
    out = []
    for part in re.split(r"\n[ \t\f]*\n", text):
        lines = []
        for x in part.split("\n"):
            if DATED.match(x) or not lines or DATED.match(lines[-1]):
                lines.append(x)
            else:
                lines[-1] += " " + x.strip()
        out.append("\n".join(x if DATED.match(x) else textwrap.fill(" ".join(x.split()), width, break_long_words=False, break_on_hyphens=False) for x in lines))
    return "\n\n".join(out)


@pytest.mark.parametrize("at", range(len(licenses.TEXTS) + len(licenses.FILES)))
def test_every_width_is_recognised(at):
    texts = [*licenses.TEXTS, *[(k, (licenses.Path(licenses.__file__).parent / "known_licenses" / f"{n}.txt").read_text("utf-8")) for n, k in licenses.FILES.items()]]
    name, text = texts[at]
    for width in range(50, 101):
        got = KNOWN.get(hashlib.sha256(licenses.canonical(wrapped(text, width)).encode()).hexdigest())
        assert got == name, width


def test_copyright_lines():
    c = licenses.canonical
    for line in ("Copyright (c) 2020 A. Holder", "Copyright 2019-2021 B", "(C) 2001 C", "© 2020 D", "  * Copyright © 2020 E", "Copyright [yyyy] [name]", "Copyright (c) <year> F", "Copyright (c) G Inc."):
        assert c(line + "\n\nterms of use") == "terms of use", line
    assert c("title\nCopyright 2020 A\nterms") == "title terms"
    for line in ("copyright notice, this list", "(c) You must retain", "Copyright (C) year name of author", "copyright holders be liable"):
        assert c("words before\n" + line + "\nwords after") == c("words before " + line + " words after")


def test_typeset_punctuation():
    text = licenses.TEXTS[0][1]
    set_ = text.replace(' "', " “").replace('"', "”").replace("free of charge", "free of charge").replace("and/or", "and⁄or")
    assert set_ != text and licenses.canonical(set_) == licenses.canonical(text)


def _page(lines):
    return "<html><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>"


def test_near_copies_keep_their_paragraphs(spark):
    real = [f"Paragraph {k} tells at some length what happened on day {k} of the journey." for k in range(6)]
    site = ["Our shop is open daily", "Sister sites of this one"]
    own = [[f"Story {p} part {k} is told nowhere else on this host, at some length." for k in range(4)] for p in range(2)]
    rows = [(1, "http://h/a/1", _page(real)), (2, "http://h/a/2", _page([*real[:5], "Paragraph 5 was changed."])),
            (3, "http://g/a/1", _page([*site, *own[0]])), (4, "http://g/a/2", _page([*site, *own[1]])),
            # a near copy beside it, a different page on its other side
            (5, "http://k/a/1", _page([site[0], *own[1]])), (6, "http://k/a/2", _page([site[0], *real])), (7, "http://k/a/3", _page([site[0], *real[:5], "other end"]))]
    got = {r.page_id: r.text.split("\n") for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == real and got[2] == [*real[:5], "Paragraph 5 was changed."]
    assert got[3] == own[0] and got[4] == own[1]
    assert got[6] == real
    assert got[7] == [site[0], *real[:5], "other end"]  # its only neighbour is a near copy: nothing is known to be the site's


def test_site_lines():
    assert pages.site_lines(["nav", "a long line of its own text"], [["nav", "another long line of text"]]) == {0}
    assert pages.site_lines(["same", "text"], [["same", "text"], ["same", "another longer text"]]) == {0}
    assert pages.site_lines(["same", "text"], [["same", "text"]]) == pages.site_lines([], []) == set()
