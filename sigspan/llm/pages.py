"""Main text of web pages by nearest-URL page differencing.

Method. A page is cut into text lines, one for each block element, with the region they stand in:
inside ``article`` / ``main``, inside furniture (menus, headers, footers, sidebars, notices,
adverts, forms, comments, told by element, class, id or role), or loose. Furniture, scripts and
styles go. Pages with loose lines are put in the order of (host, path); each is paired with the
neighbour of its host whose path shares the longer prefix, the two pages' loose lines are aligned
by longest common subsequence, and the shared lines are deleted: they belong to the site.
Lines inside ``article`` are kept without differencing, as copies of an article on one host share
all their lines, and menus whose items change from page to page share none (see README).

Defined cases: null html gives an empty text; broken markup (open tags, a cut tag or comment at
the end) is read as far as it goes; null urls form one host; rows that repeat a page each get
its text, and pages of a host with equal lines are never paired with each other; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import row_index
from .common import batch, chunks, read, stage

# HTML elements by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr !doctype".split())
RAW = set("script style noscript template title textarea svg iframe object math canvas audio video select".split())
FURNITURE = set("nav header footer aside form dialog menu button label fieldset".split())
MAIN = {"article", "main"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Words in class, id or role that mark furniture.
MARKS = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "cookie cookies consent notice notices alert popup modal overlay comment comments reply replies disqus footer masthead share sharing "
    "social related recommended newsletter subscribe signup login widget pagination pager toolbar skip copyright contentinfo complementary search".split()
)
# Words that may stand beside a mark in one class name ("site-footer"); any other makes it another name ("has-sidebar").
QUALIFIERS = set(
    "site main global top bottom left right primary secondary list item items box block bar wrap wrapper container area section inner links link "
    "buttons button icons form text title content header head group panel row col x".split()
)
HEADS_IN_MAIN = {"header"}  # an article's own header holds its title

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|([!/?]?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
SOFT, HARD = 1, 2
_TOKEN = re.compile(r"[a-z]+")


def _marked(attrs: str) -> bool:
    if "=" not in attrs:
        return False
    for m in _ATTR.finditer(attrs):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = set(_TOKEN.findall(name))
            if not MARKS.isdisjoint(words) and words <= MARKS | QUALIFIERS:
                return True
    return False


def _hidden(attrs: str) -> bool:
    return bool(_HIDDEN.search(attrs))


def page_lines(html: str | None) -> list[tuple[bool, str]]:
    """``(inside article or main, text)`` of each non-empty block outside furniture, in order.

    An article or main element below furniture that is told only by class, id or role starts anew,
    unless it is marked itself; its lines count if the page has no other lines in article or main.
    """
    out: list[tuple[bool, bool, str]] = []
    if not html:
        return []
    # element, furniture (SOFT if by class, id or role only), main, started anew below furniture
    stack: list[tuple[str, int, bool, bool]] = []
    furniture, main, anew = 0, False, False
    buf: list[str] = []
    at, n = 0, len(html)

    def flush() -> None:
        if buf:
            text = " ".join(unescape("".join(buf)).split())
            buf.clear()
            if text:
                out.append((main, anew, text))

    while at < n:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else n]
        if text and not furniture:
            buf.append(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name or m[1] in ("!", "?"):
            continue
        if name == "br":
            if not furniture:
                buf.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if m[1] == "/":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    furniture, main, anew = stack[-1][1:] if stack else (0, False, False)
                    break
            continue
        if name in VOID or m[0].endswith("/>") and name not in BLOCKS and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name in BLOCKS and stack:  # a block closes an open paragraph, an item the item before it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == name and name in ("li", "dt", "dd", "tr", "td", "th"):
                    del stack[k:]
                    furniture, main, anew = stack[-1][1:] if stack else (0, False, False)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in FURNITURE and not (main and name in HEADS_IN_MAIN) or name not in ("html", "body") and name not in MAIN and _hidden(m[3]):
            level = HARD
        elif name not in MAIN and name not in ("html", "body") and _marked(m[3]):
            level = SOFT
        else:
            level = 0
        starts = name in MAIN and furniture == SOFT and not main and not _marked(m[3]) and not _hidden(m[3])
        drop = 0 if starts else max(furniture, level)
        if drop and not furniture:
            flush()
        furniture, main, anew = drop, main or (name in MAIN and not drop), anew or starts
        stack.append((name, furniture, main, anew))
    flush()
    plain = any(m and not a for m, a, _ in out)
    return [(m, t) for m, a, t in out if not (a and plain)]


def host_path(url: str | None) -> tuple[str, str]:
    """Host without a leading ``www.`` or ``m.``, and path without a trailing slash."""
    try:
        u = urlsplit(url or "")
        host = re.sub(r"^(www|m)\.", "", (u.hostname or "").lower())
    except ValueError:
        return "", url or ""
    return host, u.path.rstrip("/")


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions of ``a`` in a longest common subsequence of ``a`` and ``b``.

    Hunt-Szymanski: positions of equal lines, longest increasing chain; memory follows the
    number of pairs of equal lines that lengthen a chain.
    """
    where: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            elif j < tails[k]:
                tails[k] = j
                links[k] = link
    out: set[int] = set()
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


_LINES = "main array<boolean>, line array<string>"
_PARSED = f"page_id bigint, url string, host string, path string, n_loose int, {_LINES}"


def parsed(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "html"):
            urls = b.column(1).to_pylist()
            lines = [page_lines(h) for h in b.column(2).to_pylist()]
            places = [host_path(u) for u in urls]
            yield batch({
                "page_id": b.column(0),
                "url": b.column(1),
                "host": pa.array([h for h, _ in places], pa.string()),
                "path": pa.array([p for _, p in places], pa.string()),
                "n_loose": pa.array([sum(not m for m, _ in x) for x in lines], pa.int32()),
                "main": pa.array([[m for m, _ in x] for x in lines], pa.list_(pa.bool_())),
                "line": pa.array([[t for _, t in x] for x in lines], pa.list_(pa.string())),
            })

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, _PARSED)


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def near_copies(lines: list[str], other: list[str], shared: set[int]) -> bool:
    """Whether the shared lines hold at least half of the characters of both pages."""
    size = max(sum(map(len, lines)), sum(map(len, other)))
    return 2 * sum(len(lines[i]) for i in shared) >= size


def site_lines(lines: list[str], others: list[list[str]]) -> set[int]:
    """Positions of the lines shared with the first of ``others`` that is no near copy; none if all are."""
    for other in others:
        shared = shared_lines(lines, other)
        if not near_copies(lines, other, shared):
            return shared
    return set()


def differenced(loose: DataFrame) -> DataFrame:
    """``loose`` (rows of :func:`parsed`) without the lines shared with the nearer neighbour by path that is no near copy.

    Pages of a host with the same lines throughout are one page here, at the first of their paths:
    a copy says nothing about what belongs to the site. Nor does a near copy, so pages with near copies to both
    sides keep all lines.
    """
    copy = F.sha2(F.to_json(F.struct("host", "main", "line")), 256)
    loose = stage(loose.withColumn("copy", copy), "loose-pages")
    first = F.min(F.struct("path", "page_id")).alias("first")
    distinct = loose.groupBy("copy").agg(first, F.first("host").alias("host"), F.first("main").alias("main"), F.first("line").alias("line"))
    index = row_index(distinct.select("copy", "host", "first.path", "main", "line"), ["host", "path", "copy"])
    side = F.transform(F.filter(F.arrays_zip("main", "line"), lambda x: ~x["main"]), lambda x: x["line"])
    near = index.select("host", F.col("path").alias("near_path"), "idx", side.alias("near"))
    both = (
        index.join(near.select("host", (F.col("idx") + 1).alias("idx"), F.col("near_path").alias("path_a"), F.col("near").alias("near_a")), ["host", "idx"], "left")
        .join(near.select("host", (F.col("idx") - 1).alias("idx"), F.col("near_path").alias("path_b"), F.col("near").alias("near_b")), ["host", "idx"], "left")
        .select("copy", "path", "main", "line", "path_a", "near_a", "path_b", "near_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for r in b.to_pylist():
                a_near = -1 if r["path_a"] is None else _prefix(r["path"], r["path_a"])
                b_near = -1 if r["path_b"] is None else _prefix(r["path"], r["path_b"])
                others = [r["near_a"], r["near_b"]] if a_near >= b_near else [r["near_b"], r["near_a"]]
                at = [i for i, m in enumerate(r["main"]) if not m]
                gone = {at[i] for i in site_lines([r["line"][i] for i in at], [x for x in others if x])}
                texts.append("\n".join(t for i, t in enumerate(r["line"]) if i not in gone))
            yield batch({"copy": b.column(0), "text": pa.array(texts, pa.string())})

    texts = both.mapInArrow(run, "copy string, text string")
    return loose.select("page_id", "url", "copy").join(texts, "copy").select("page_id", "url", "text")


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``."""
    p = parsed(pages)
    plain = p.filter("n_loose = 0").select("page_id", "url", F.array_join("line", "\n").alias("text"))
    out = plain.unionByName(differenced(p.filter("n_loose > 0")))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


SQL = {}
