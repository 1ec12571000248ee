"""Licence scan: canonical digests of whole texts, and of single lines, joined with those of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices and short licences by SPDX identifier.
KNOWN = (
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("rights-reserved", "All rights reserved."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
#: Lines of copyright, titles, and spellings that licence texts use for one another.
COPYRIGHT_LINE = r"copyright (?:\(c\)|©|[0-9])|©|\(c\) *[0-9]"
TITLE_LINE = r"^ *(?:the )?(?:mit|isc|zlib|bsd|zero-clause bsd) licen[cs]e *$"
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("organisation", "organization"), ("copyright owner", "copyright holder"), ("https://", "http://"))
MARKS = r"[^\p{L}\p{N}]+"


def canonical_line(line: Column) -> Column:
    """Lower case, nothing of a copyright or title line, one spelling, words parted by single spaces."""
    low = F.lower(line)
    dropped = (low.contains("copyright") | low.contains("(c)") | low.contains("©")) & low.rlike(COPYRIGHT_LINE) | low.contains("licen") & low.rlike(TITLE_LINE)
    out = low
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(dropped, "").otherwise(F.trim(F.regexp_replace(out, MARKS, " ")))


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that have any word left."""
    return F.filter(F.transform(F.split(text, "\n"), canonical_line), lambda x: x != "")


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id, text: the built-in ones. Any table of the same columns will do."""
    return spark.createDataFrame([*KNOWN], "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, digest of the canonical whole text, license_id if it is a known one's, and notices.

    ``notices`` are the known licences that single lines of the text amount to, sorted and joined
    by commas. A null, empty or punctuation-only text has the digest of the empty string and matches
    nothing. Of known licences with equal canonical texts the smallest id counts. Equal rows and null
    ids get rows of their own; other columns are not read. Digests are joined by a plain
    equi-join, so Spark broadcasts the known side only below its size limit, and splits a digest that
    many lines share.
    """
    lines = lambda c: F.array_join(canonical_lines(F.col(c)), " ")
    known = known.select(lines("text").alias("c"), "license_id").where("c <> ''").groupBy(F.sha2("c", 256).alias("k")).agg(F.min("license_id").alias("license_id"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.explode(F.array(canonical_lines(text))).alias("lines"))
    sha = lambda x, whole: F.struct(F.sha2(x, 256).alias("k"), F.lit(whole).alias("whole"))
    units = F.concat(F.array(sha(F.array_join("lines", " "), True)), F.transform(F.array_distinct("lines"), lambda x: sha(x, False)))
    units = base.select("doc_id", "text_key", F.explode(units).alias("u")).select("doc_id", "text_key", "u.k", "u.whole")
    of_whole = lambda c: F.max(F.when(F.col("whole"), F.col(c)))
    out = units.join(known, "k", "left").groupBy("doc_id", "text_key").agg(
        of_whole("k").alias("digest"), of_whole("license_id").alias("license_id"), F.sum(F.col("whole").cast("int")).alias("rows"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",").alias("notices"),
    )
    return out.select("doc_id", "digest", "license_id", "notices", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_r")).drop("_r")


def sql_line(line: str) -> str:
    """``canonical_line`` as DuckDB SQL over the expression ``line``."""
    out = f"lower({line})"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"CASE WHEN regexp_matches(lower({line}), '{COPYRIGHT_LINE}') OR regexp_matches(lower({line}), '{TITLE_LINE}') THEN '' ELSE trim(regexp_replace({out}, '{MARKS}', ' ', 'g')) END"


def oracle() -> str:
    """``scan`` of ``documents`` and the built-in licences as DuckDB SQL."""
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    return f"""
WITH given(license_id, text) AS (VALUES {rows}),
known AS (SELECT sha256({sql_line("text")}) AS k, min(license_id) AS license_id FROM given GROUP BY 1),
lines AS (SELECT doc_id, l.line, l.pos FROM (
  SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {{'line': {sql_line("x")}, 'pos': i}})) AS l FROM documents)
  WHERE l.line <> ''),
whole AS (SELECT doc_id, sha256(string_agg(line, ' ' ORDER BY pos)) AS digest FROM lines GROUP BY doc_id),
notices AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM lines JOIN known ON sha256(line) = k GROUP BY doc_id)
SELECT d.doc_id, coalesce(w.digest, sha256('')) AS digest, k.license_id, coalesce(n.notices, '') AS notices
FROM documents d LEFT JOIN whole w ON w.doc_id = d.doc_id LEFT JOIN known k ON w.digest = k.k LEFT JOIN notices n ON n.doc_id = d.doc_id
"""
