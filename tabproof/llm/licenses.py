"""Known licences in documents, found by digests of whole normalised texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabproof.llm.common import whole_text
from tabproof.session import local_frame

# Notices and texts as their licensors publish them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "MIT License", _MIT, f"MIT License\n{_MIT}"),
    "ISC": ("Released under the ISC License.", "ISC License", _ISC, f"ISC License\n{_ISC}"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\")",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
}
# Spellings that mean the same, left to right.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("recognised", "recognized"),
    ("sub license", "sublicense"),
)

#: A line that starts with a copyright sign or word and goes on with a sign, a year or a holder's mark.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*(copyright[ \t]+(\(c\)|©|[0-9])|©|\(c\)[ \t]*(copyright|[0-9]))[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}\n]+"
#: What separates blocks once everything but words and line ends is a blank.
BLANK_LINES = r"\n *\n[ \n]*"


def normalised(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation, one spelling; line ends stay."""
    text = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    text = F.regexp_replace(text, NOT_WORD, " ")
    for one, other in SPELLINGS:
        text = F.replace(text, F.lit(one), F.lit(other))
    return text


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def license_mentions(docs: DataFrame, known: dict[str, tuple[str, ...]] = KNOWN) -> DataFrame:
    """``(doc_id, license, whole_text, blocks, lines)``: documents that hold a known licence text, and how.

    A unit is the whole text, a block between blank lines, or a line. Each is normalised and
    digested entirely; equal digests are joined with those of ``known``, which is the size of
    that list and broadcast. ``whole_text`` says that the whole text is the licence, ``blocks`` and
    ``lines`` count the blocks and lines that are.

    Null, empty and blank texts hold nothing. Repeated rows count as often as they occur. Rows
    with a null doc_id count together. Other columns are ignored. An empty table gives no rows.
    """
    listed = local_frame(docs.sparkSession, [(name, text) for name, texts in known.items() for text in texts], "license string, text string")
    digests = listed.select("license", F.md5(one_line(normalised(F.col("text")))).alias("digest")).distinct()
    units = docs.select("doc_id", normalised(whole_text()).alias("_t")).select(
        "doc_id",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("text").alias("unit"), one_line(F.col("_t")).alias("words"))),
                F.transform(F.split("_t", BLANK_LINES), lambda b: F.struct(F.lit("block").alias("unit"), one_line(b).alias("words"))),
                F.transform(F.split("_t", "\n"), lambda x: F.struct(F.lit("line").alias("unit"), F.trim(x).alias("words"))),
            )
        ).alias("_u"),
    )
    hashed = units.where("_u.words <> ''").select("doc_id", F.col("_u.unit").alias("unit"), F.md5("_u.words").alias("digest"))
    return (
        hashed.join(F.broadcast(digests), "digest")
        .groupBy("doc_id", "license")
        .agg(
            (F.count_if(F.col("unit") == "text") > 0).alias("whole_text"),
            F.count_if(F.col("unit") == "block").alias("blocks"),
            F.count_if(F.col("unit") == "line").alias("lines"),
        )
    )


def _sql_normalised(text: str) -> str:
    sql = f"regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g'), '{NOT_WORD}', ' ', 'g')"
    for one, other in SPELLINGS:
        sql = f"replace({sql}, '{one}', '{other}')"
    return sql


def oracle() -> str:
    """The same as DuckDB SQL."""
    quoted = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, texts in KNOWN.items() for t in texts)
    line = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'))"
    return f"""
WITH known(license, text) AS (VALUES {quoted}),
digests AS (SELECT DISTINCT license, md5({line.format(_sql_normalised("text"))}) AS digest FROM known),
clean AS (SELECT doc_id, {_sql_normalised("coalesce(text, '')")} AS t FROM documents),
units AS (
  SELECT doc_id, 'text' AS unit, {line.format("t")} AS words FROM clean
  UNION ALL SELECT doc_id, 'block', {line.format("b")} FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '{BLANK_LINES}')) AS b FROM clean)
  UNION ALL SELECT doc_id, 'line', trim(x) FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM clean)
)
SELECT doc_id, license, count(*) FILTER (unit = 'text') > 0 AS whole_text,
  count(*) FILTER (unit = 'block') AS blocks, count(*) FILTER (unit = 'line') AS lines
FROM units JOIN digests ON md5(words) = digest WHERE words <> '' GROUP BY doc_id, license
"""
