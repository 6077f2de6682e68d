"""Licence scan by canonical digests (operator 10).

A text's canonical form: lower case, copyright notices (lines) dropped, everything but letters and digits replaced by one space, equivalent
spellings replaced.  The SHA-256 digests of the canonical forms of whole texts,
and of each of their lines, are hash-joined to the digests of known licence
texts.  Only entire texts or entire lines match.

Scale: canonical forms are made by row with built-in functions and no text is
shuffled.  A form longer than the longest known one, by more than its spellings
can shrink, cannot match and gets no digest, nor does one that begins otherwise than every
known one.  Digests that match are few; they are grouped
by document and joined back to the ids.  The table of known digests is a local
table whose size Spark knows; it is broadcast below the session's limit.

Defined cases: null, empty and copyright-only texts match nothing; a repeated
doc_id gets the licences of all its rows; a null doc_id matches nothing.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.expr import let

#: Known licence notices and short licence texts, by SPDX identifier; the full texts in `licenses/` are added below.
LICENSES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC0-1.0": ["CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Titles that may stand before the texts in `licenses/`, which are without theirs.
TITLES = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"],
    "CC-BY-SA-4.0": ["Attribution-ShareAlike 4.0 International", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ISC": ["ISC License", "The ISC License"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
END = "END OF TERMS AND CONDITIONS"
for _file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
    # with and without the appendix, with and without a title
    _body = _file.read_text(encoding="utf-8")
    _terms = _body.partition(END)[0]
    for _part in dict.fromkeys([_body, _terms + END, _terms] if END in _body else [_body]):
        LICENSES.setdefault(_file.stem, []).extend([_part, *(f"{x}\n{_part}" for x in TITLES[_file.stem])])
#: Equivalent spellings, as words of the canonical form.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense", "sub licence": "sublicense",
    "non commercial": "noncommercial", "non infringement": "noninfringement", "share alike": "sharealike", "organisation": "organization",
    "favour": "favor", "fulfil": "fulfill", "judgement": "judgment", "acknowledgement": "acknowledgment", "merchantibility": "merchantability", "v": "version", "ver": "version", "https": "http",
}
#: A line that is a copyright notice; other lines that begin with the word are the licence's.
COPYRIGHT = (
    r"^[^\p{L}\p{N}©]*(?:©|\(c\)[^\p{L}\p{N}]*(?:copyright|[0-9]{4})|all rights reserved[^\p{L}\p{N}]*$"
    r"|copyright[\s:,]*(?:\(c\)|©|[0-9]{4}|by\b|[\[<{])|copyright[\s:,]+(?:the [^.]*\b(?:authors|contributors)|[^.]*\b(?:inc|llc|ltd|gmbh|corporation))[^\p{L}\p{N}]*$)"
)
REST = r"[^\p{L}\p{N}]+"
#: A form is at most this many times as long as with its spellings replaced.
ROOM = max(1.0, *(len(a) / len(b) for a, b in SPELLINGS.items()))
#: The first HEAD characters of a form with its spellings replaced depend on its first CUT only.
HEAD, CUT = 24, 96


def _spelled(t: Column) -> Column:
    for a, b in SPELLINGS.items():
        t = F.regexp_replace(t, rf"(?<= ){a}(?= )", b)
    return t


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines: ' word word ', or '' for one that is dropped."""

    def line(x: Column) -> Column:
        return F.when(x.rlike(COPYRIGHT), F.lit("")).otherwise(F.trim(F.regexp_replace(x, REST, " ")))

    return F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), line)


def _form(form: Column) -> Column:
    return F.trim(_spelled(F.concat(F.lit(" "), form, F.lit(" "))))


def _head(form: Column) -> Column:
    return F.substring(_form(F.substring(form, 1, CUT)), 1, HEAD)


def _digest(form: Column, longest: int, heads: list[str]) -> Column:
    """SHA-256 of a form with its spellings replaced; null if it is empty, too long or begins otherwise than all of `heads`."""
    return F.when((F.length(form) > 0) & (F.length(form) <= longest), F.when(_head(form).isin(heads), F.sha2(_form(form), 256)))


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def license_scan(docs: DataFrame, licenses: dict[str, list[str]] = LICENSES) -> DataFrame:
    """`doc_id, licenses, n_lines, whole` of every document: the licences found (sorted, joined by commas; null if none), lines that state one, and whether the whole text is one."""
    spark = docs.sparkSession
    known = spark.createDataFrame([(k, t) for k, ts in sorted(licenses.items()) for t in ts], "license string, known string")
    known = known.select("license", _whole(canonical_lines(F.col("known"))).alias("form")).where("form <> ''")
    rows = known.select(F.sha2(_form(F.col("form")), 256).alias("digest"), "license", _head(F.col("form")).alias("head"), F.length(_form(F.col("form"))).alias("n")).collect()  # a row per known text
    longest = int(ROOM * max((r["n"] for r in rows), default=0)) + 1
    heads = sorted({r["head"] for r in rows})
    known = spark.createDataFrame([(r["digest"], r["license"]) for r in rows], "digest string, license string").groupBy("digest").agg(F.min("license").alias("license"))
    units = let(
        canonical_lines(F.col("text")),
        lambda x: F.concat(
            F.array(F.struct(F.lit(True).alias("whole"), _digest(_whole(x), longest, heads).alias("digest"))),
            F.transform(x, lambda line: F.struct(F.lit(False).alias("whole"), _digest(line, longest, heads).alias("digest"))),
        ),
    )
    units = docs.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.*").where("digest is not null and doc_id is not null")
    found = units.join(known, "digest").groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.count_if(~F.col("whole")).alias("n_lines"), F.max("whole").alias("whole")
    )
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", "licenses", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("whole", F.lit(False)).alias("whole"))


def oracle() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(k)}, {quote(t)})" for k, ts in sorted(LICENSES.items()) for t in ts)
    form = f"CASE WHEN regexp_matches(x, '{COPYRIGHT}') THEN '' ELSE trim(regexp_replace(x, '{REST}', ' ', 'g')) END"
    spelled = "' ' || replace(form, ' ', '  ') || ' '"
    for a, b in SPELLINGS.items():
        spelled = f"replace({spelled}, ' {a.replace(' ', '  ')} ', ' {b} ')"
    digest = f"CASE WHEN length(form) > 0 THEN sha256(trim(replace({spelled}, '  ', ' '))) END"
    return f"""
WITH texts AS (SELECT doc_id, NULL AS license, list_transform(string_split(lower(coalesce(text, '')), chr(10)), lambda x: {form}) AS lines FROM documents
  UNION ALL SELECT NULL, k, list_transform(string_split(lower(t), chr(10)), lambda x: {form}) FROM (VALUES {rows}) v(k, t)),
forms AS (SELECT doc_id, license, true AS whole, array_to_string(list_filter(lines, lambda x: x <> ''), ' ') AS form FROM texts
  UNION ALL SELECT doc_id, license, false, unnest(lines) FROM texts WHERE license IS NULL),
digests AS (SELECT doc_id, license, whole, {digest} AS digest FROM forms),
known AS (SELECT digest, min(license) AS license FROM digests WHERE license IS NOT NULL GROUP BY 1),
found AS (SELECT d.doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS licenses, count(*) FILTER (NOT d.whole) AS n_lines, bool_or(d.whole) AS whole
  FROM digests d JOIN known k ON d.digest = k.digest WHERE d.license IS NULL AND d.doc_id IS NOT NULL GROUP BY 1)
SELECT doc_id, licenses, coalesce(n_lines, 0) AS n_lines, coalesce(whole, false) AS whole FROM documents LEFT JOIN found USING (doc_id)"""
