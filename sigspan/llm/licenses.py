"""License scan by canonical digests (DataFrame functions only).

Method: a text is brought to a canonical form (ASCII letters lower-cased, copyright lines removed,
equivalent spellings unified, punctuation and white space reduced to single spaces), digested with
SHA-256, and the digest is hash-joined with the digests of known licences. Three units of a document
are looked up: its entire text, which finds whole licence texts, each of its lines, which finds
one-line notices, and each paragraph of several lines without such a notice, which finds wrapped
headers. The known table is a fixed list (this module and the texts in ``known_licenses``), so it is
broadcast; a caller's own table of texts is added to it and joined as its size asks.

A copyright line is one that begins with "copyright" or "(c)" and gives a year, or one with a mark or a place for
the year at the start of a paragraph, or one right below such a line; a wrapped sentence that happens to begin a line with "copyright" stays, so
a text's digest does not depend on the width it is wrapped at. A line with a mark and no year inside a
paragraph stays too.

Defined cases: a null or empty text has the digest of the empty string and matches nothing; rows
that repeat a ``doc_id`` (or have none) count as one document; extra columns are ignored; an
empty table gives no rows; a very long text is digested whole, in one row.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Equivalent spellings, applied in this order after lower-casing.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("whilst", "while"),
    ("judgement", "judgment"),
    ("©", "(c)"),
)
COPYRIGHT_LINE = (
    r"((^|\n)[^a-z0-9\n]*(copyright[^a-z0-9\n]*(\(c\))?|\(c\))[^a-z0-9\n]*[0-9]{4}"
    r"|(^|\n[ \t\r]*\n)[^a-z0-9\n]*copyright[^a-z0-9\n]*(\(c\)|[<\[{] *(year|yyyy)))[^\n]*"
    r"(\n[^a-z0-9\n]*(copyright|\(c\))[^\n]*)*"
)
# ASCII other than letters, digits and the line feed, and the spaces and punctuation of typeset text
SEPARATORS = r"[\x01-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f" + "\u00a0\u00a1\u00a7\u00ab\u00ad\u00b6\u00b7\u00bb\u00bf\u2000-\u206f\u3000-\u3003\ufeff]+"

# Known one-line notices and whole licence texts by SPDX identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
)
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_TAIL = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
TEXTS = (
    ("MIT", "MIT License\n\n" + _GRANT + "\n\nThe above copyright notice and this permission notice shall be included in all "
     "copies or substantial portions of the Software.\n\n" + _AS_IS),
    ("MIT", _GRANT + "\n\nThe above copyright notice and this permission notice shall be included in all "
     "copies or substantial portions of the Software.\n\n" + _AS_IS),
    ("MIT-0", "MIT No Attribution\n\n" + _GRANT.replace(", subject to the following conditions:", ".") + "\n\n" + _AS_IS),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
     "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted.\n\n" + _ISC_TAIL),
)


# Headers that stand over several lines, looked up by paragraph.
_ANY_LATER = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License "
    "as published by the Free Software Foundation; either version {3} of the License, or (at your option) any later version."
)
HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at"),
    *(("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
       f"distributed with this file, You can obtain one at {scheme}://mozilla.org/MPL/2.0/.") for scheme in ("http", "https")),
    *((f"{name}-{v}", _ANY_LATER.format(what, mark, kind, short))
      for name, kind, versions in (("GPL", "", ("2.0", "3.0")), ("LGPL", "Lesser ", ("2.1", "3.0")), ("AGPL", "Affero ", ("3.0",)))
      for v in versions for short in {v, v.removesuffix(".0")} for what in ("program", "library", "file") for mark in (":", ";")),
)
# Whole texts shipped as files; those with an appendix after their terms are known without it too.
FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3",
    "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0",
    "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
TERMS_END = "END OF TERMS AND CONDITIONS"
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
)
_BSD_POINTS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.",
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT {} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
    "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def shipped_texts() -> list[tuple[str, str]]:
    """Whole texts by SPDX identifier beyond ``TEXTS``; read by the driver only."""
    out = []
    for name, k in FILES.items():
        t = (Path(__file__).parent / "known_licenses" / f"{name}.txt").read_text("utf-8")
        out.append((k, t))
        if TERMS_END in t:
            terms = t[: t.index(TERMS_END)]
            out += [(k, terms), (k, terms + TERMS_END)]
    for n in (2, 3):
        for title in ("", f"BSD {n}-Clause License\n", f"The {n}-Clause BSD License\n"):
            for rights in ("", "All rights reserved.\n"):
                for numbered in (True, False):
                    for holder in ("HOLDER", "HOLDERS", "OWNER"):
                        points = [f"{i}. {x}" if numbered else f"* {x}" for i, x in enumerate(_BSD_POINTS[:n], 1)]
                        out.append((f"BSD-{n}-Clause", "\n".join([title + rights + _BSD_GRANT, *points, _BSD_AS_IS.format(holder)])))
    out.append(("ISC", TEXTS[3][1].removeprefix("ISC License")))
    return out


def canonical(text: str) -> str:
    """Canonical whole text of a known one, as :func:`canonical_lines` joined by spaces."""
    t = text.translate(str.maketrans(UPPER, LOWER))
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    t = re.sub(SEPARATORS, " ", re.sub(COPYRIGHT_LINE, "\n\n", t))
    return " ".join(filter(None, (x.strip(" ") for x in t.split("\n"))))


def canonical_lines(text: Column) -> Column:
    """Canonical non-empty lines of a text, in order."""
    return F.filter(all_lines(text), lambda x: x != "")


def all_lines(text: Column) -> Column:
    """Canonical lines of a text, in order; blank and copyright lines are empty."""
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, COPYRIGHT_LINE, "\n\n")
    t = F.regexp_replace(t, SEPARATORS, " ")
    return F.transform(F.split(t, "\n"), lambda x: F.trim(x))


def fixed_digests() -> list[tuple[str, str]]:
    """``(digest, licence)`` of every text of the fixed lists."""
    return sorted({(hashlib.sha256(canonical(t).encode()).hexdigest(), k) for k, t in [*NOTICES, *TEXTS, *HEADERS, *shipped_texts()]})


def notice_lines() -> list[str]:
    return sorted({canonical(t) for _, t in NOTICES})


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """``(known_digest, known_id)`` of the fixed lists and of ``texts(license, text)``."""
    rows = F.array(*[F.struct(F.lit(d).alias("known_digest"), F.lit(k).alias("known_id")) for d, k in fixed_digests()])
    known = spark.range(1).select(F.inline(rows))
    if texts is not None:
        digest = F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256)
        own = texts.select(digest.alias("known_digest"), F.col("license").cast("string").alias("known_id"))
        known = known.unionByName(own.filter(F.col("known_id").isNotNull() & (F.col("known_digest") != hashlib.sha256(b"").hexdigest())))
    return known.groupBy("known_digest").agg(F.min("known_id").alias("known_id"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: DataFrame | None = None) -> DataFrame:
    """``(doc_id, digest, license, n_notices, notices)``: the digest of the whole canonical text,
    the licence it is (null if none), how many lines or wrapped paragraphs are known notices, and
    their distinct licences in order, joined by commas (empty if none). ``texts(license, text)``
    adds known texts."""
    known = known_digests(docs.sparkSession, texts)
    rows = docs.select(F.col(id_col).alias("doc_id"), all_lines(F.col(text_col)).alias("every"))
    lines = rows.withColumn("lines", F.filter("every", lambda x: x != ""))
    whole = F.struct(F.lit(True).alias("whole"), F.array_join("lines", " ").alias("unit"))
    each = F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit")))
    # a paragraph with a notice line counts by that line
    line_notices = F.array(*[F.lit(x) for x in notice_lines()])
    several = lambda x: x.contains("\n") & ~F.arrays_overlap(F.split(x, "\n"), line_notices)
    wrapped = F.filter(F.transform(F.split(F.array_join("every", "\n"), "\n\n+"), lambda x: F.btrim(x, F.lit("\n"))), several)
    paragraphs = F.transform(wrapped, lambda x: F.struct(F.lit(False).alias("whole"), F.replace(x, F.lit("\n"), F.lit(" ")).alias("unit")))
    units = lines.select("doc_id", F.inline(F.concat(F.array(whole), each, paragraphs))).select(
        "doc_id", "whole", F.sha2("unit", 256).alias("digest")
    )
    found = units.join(F.broadcast(known) if texts is None else known, units.digest == F.col("known_digest"), "left")
    notice = ~F.col("whole") & F.col("known_id").isNotNull()
    return found.groupBy("doc_id").agg(
        F.min(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
        F.min(F.when(F.col("whole"), F.col("known_id"))).alias("license"),
        F.count(F.when(notice, 1)).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(F.when(notice, F.col("known_id")))), ",").alias("notices"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(d)}, {q(k)})" for d, k in fixed_digests())
    notices = "[" + ", ".join(map(q, notice_lines())) + "]"
    t = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    for a, b in SPELLINGS:
        t = f"replace({t}, {q(a)}, {q(b)})"
    t = f"regexp_replace({t}, {q(COPYRIGHT_LINE)}, chr(10) || chr(10), 'g')"
    t = f"regexp_replace({t}, {q(SEPARATORS)}, ' ', 'g')"
    every = f"list_transform(string_split({t}, chr(10)), lambda x: trim(x))"
    return f"""
WITH known AS (SELECT kd, min(k) AS kid FROM (VALUES {values}) v(kd, k) GROUP BY 1),
e AS (SELECT doc_id, {every} AS every FROM documents),
d AS (SELECT doc_id, every, list_filter(every, lambda x: x <> '') AS lines FROM e),
p AS (SELECT doc_id, trim(unnest(string_split_regex(array_to_string(every, chr(10)), '\n\n+')), chr(10)) AS part FROM d),
u AS (
  SELECT doc_id, true AS whole, sha256(array_to_string(lines, ' ')) AS digest FROM d
  UNION ALL
  SELECT doc_id, false, sha256(line) FROM (SELECT doc_id, unnest(lines) AS line FROM d)
  UNION ALL
  SELECT doc_id, false, sha256(replace(part, chr(10), ' ')) FROM p
  WHERE contains(part, chr(10)) AND NOT list_has_any(string_split(part, chr(10)), {notices}))
SELECT doc_id, min(digest) FILTER (whole) AS digest, min(kid) FILTER (whole) AS license,
  count(*) FILTER (NOT whole AND kid IS NOT NULL) AS n_notices,
  coalesce(array_to_string(list_sort(list_distinct(list(kid) FILTER (NOT whole AND kid IS NOT NULL))), ','), '') AS notices
FROM u LEFT JOIN known ON digest = kd GROUP BY doc_id"""


SQL = {"op1_license_scan": _sql()}
