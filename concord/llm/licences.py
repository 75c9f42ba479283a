"""Licence scan: canonical form of entire texts, looked up by digest among known licences. SQL functions only.

A licence can be the whole text of a document, stand in it as some of its paragraphs, or be a notice of one line. Each of these is a
text of its own that is canonicalised, digested and joined with the digests of known texts. Runs of paragraphs are digested only where
a paragraph is the first one of a known text. Known texts go through the same expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concord.llm.common import ascii_lower
from concord.session import stored

#: Digests of public licence texts that are too long to be written out here.
LIST = Path(__file__).with_name("licence_digests.tsv")

# fixed values: spellings that count as equal (as in public licence matching guidelines), the second is taken
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("authoris", "authoriz"),
    ("copyright owner", "copyright holder"),
    ("customis", "customiz"),
    ("favour", "favor"),
    ("initialis", "initializ"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("non commercial", "noncommercial"),
    ("organis", "organiz"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("recognis", "recogniz"),
    ("sub license", "sublicense"),
    ("utilis", "utiliz"),
    ("whilst", "while"),
    ("https", "http"),
)
#: A line that starts like this (after blanks and comment marks) states a copyright and is left out.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: Everything but ASCII letters, digits and non-ASCII characters separates words, here without the line feed.
BLANKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"

# fixed values: public licence texts, and notices that name a licence
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""

_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""

APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS
IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""

KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("Apache-2.0", APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def _lines(text: Column) -> Column:
    """A-Z in lower case, copyright lines out, words separated by one space, lines as they were."""
    return F.regexp_replace(F.regexp_replace(ascii_lower(text), COPYRIGHT_LINE, "$1"), BLANKS, " ")


def _spelled(form: Column) -> Column:
    for spelling, taken in EQUIVALENT:
        form = F.replace(form, F.lit(spelling), F.lit(taken))
    return form


def _digest(form: Column) -> Column:
    return F.when(form != "", F.sha2(form, 256))


def _paragraphs(lines: Column) -> Column:
    """Canonical forms of the paragraphs of a text, from its `_lines`: words separated by one space and equal spellings."""
    each = F.split(lines, r"\n[ \n]*\n", -1)
    forms = F.transform(each, lambda p: _spelled(F.trim(F.regexp_replace(p, "[ \n]+", " "))))
    return F.filter(forms, lambda p: p != "")


def digests_of(texts: DataFrame) -> DataFrame:
    """`licence, n, first, digest` of whole licence texts (`licence, text`): the number of paragraphs, the digest of the first
    one and that of the canonical form of the entire text, which is its paragraphs with a space between."""
    parts = texts.select("licence", _paragraphs(_lines(F.col("text"))).alias("parts")).filter(F.size("parts") > 0)
    return parts.select(
        "licence",
        F.size("parts").alias("n"),
        F.sha2(F.col("parts")[0], 256).alias("first"),
        F.sha2(F.array_join("parts", " "), 256).alias("digest"),
    )


class Known(NamedTuple):
    """A licence text, by its digests."""

    licence: str
    n: int
    first: str
    digest: str


def listed(path: Path = LIST) -> list[Known]:
    """Known digests of a file with a licence, `n`, `first` and `digest` on a line, as `digests_of` gives them."""
    rows = [line.split("\t") for line in path.read_text(encoding="utf-8").splitlines() if line and line[0] != "#"]
    return [Known(licence, int(n), first, digest) for licence, n, first, digest in rows]


def known(spark: SparkSession, licences: Sequence[tuple[str, str]], digests: Sequence[Known]) -> list[Known]:
    """Digests of the texts given and those listed, one row per digest, the first one counting: a few rows whatever the corpus."""
    texts = spark.createDataFrame(list(licences), "licence string, text string")
    found: dict[str, Known] = {}
    for row in [Known(*r) for r in digests_of(texts).collect()] + list(digests):
        found.setdefault(row.digest, row)
    return list(found.values())


def _units(rows: Sequence[Known]) -> Column:
    """The parts of a text that can be entire licence texts, as `array<struct<kind, unit>>` of those whose digest is known: the
    whole text, every run of paragraphs that begins like a known text and is as long, every line."""
    digests = F.array(*[F.lit(r.digest) for r in rows])
    lengths: dict[str, list[int]] = {}
    for r in rows:
        lengths.setdefault(r.first, []).append(r.n)
    begun = F.create_map(*[x for first, ns in lengths.items() for x in (F.lit(first), F.array(*[F.lit(n) for n in sorted(set(ns))]))])
    parts, each = F.col("parts"), F.transform("parts", _digest)
    none = F.array().cast("array<int>")

    def runs(first: Column, at: Column) -> Column:
        whole = F.filter(F.coalesce(begun[first], none), lambda n: at + n <= F.size(parts))
        return F.transform(whole, lambda n: F.sha2(F.array_join(F.slice(parts, at + 1, n), " "), 256))

    tagged = lambda kind, found: F.transform(found, lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("unit")))
    every = F.concat(
        tagged("whole", F.array(F.col("digest"))),
        tagged("part", F.flatten(F.transform(each, runs))),
        tagged("line", F.transform(F.split(_spelled(F.col("lines")), "\n", -1), lambda line: _digest(F.trim(line)))),
    )
    return F.array_distinct(F.filter(every, lambda u: u["unit"].isNotNull() & F.array_contains(digests, u["unit"])))


def scan(docs: DataFrame, licences: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[Known] | None = None) -> DataFrame:
    """`doc_id, digest, licence, embedded, notices` for every row of `docs` (`doc_id, text`), by the texts `licences` (name, text) and
    the digests of others (without: those of the list beside this module).

    `licence` is the known licence that the entire text is; `embedded` are the licences whose entire texts stand in it as paragraphs, and
    `notices` those that lines of it are, each once, in alphabetical order with commas between; all null without. `digest` is that
    of the whole canonical text, null for null and empty texts and for those that have copyright lines and separators only.
    Repeated rows give equal rows, other columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = known(spark, licences, listed() if digests is None else digests)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), _lines(text).alias("lines"))
    texts = texts.withColumn("parts", _paragraphs(F.col("lines")))
    texts = texts.withColumn("digest", _digest(F.array_join("parts", " ")))
    read = stored(texts.select("doc_id", "text_key", "digest", _units(rows).alias("units")), "units")
    # the lookup itself: units of all documents joined with the known digests
    names = spark.createDataFrame([(r.digest, r.licence) for r in rows], "unit string, licence string")
    asked = read.select("doc_id", "text_key", F.explode("units").alias("u")).select("doc_id", "text_key", "u.kind", "u.unit")
    met = asked.join(names, "unit").groupBy("doc_id", "text_key")
    of = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("licence")))), ",")
    filled = lambda column: F.nullif(column, F.lit(""))
    met = met.agg(of("whole").alias("licence"), of("part").alias("embedded"), of("line").alias("notices"))
    met = met.withColumnsRenamed({"doc_id": "met_id", "text_key": "met_key"})
    same = read["doc_id"].eqNullSafe(met["met_id"]) & (read["text_key"] == met["met_key"])
    return read.join(met, same, "left").select(
        "doc_id", "digest", *[filled(F.col(c)).alias(c) for c in ("licence", "embedded", "notices")]
    )


def sql(licences: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[Known] | None = None) -> str:
    """The same result over the view `documents`."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def spelled(form: str) -> str:
        for spelling, taken in EQUIVALENT:
            form = f"replace({form}, {quoted(spelling)}, {quoted(taken)})"
        return form

    def lines(text: str) -> str:
        e = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        e = f"regexp_replace({e}, {quoted(COPYRIGHT_LINE)}, '\\1', 'g')"
        return f"regexp_replace({e}, {quoted(BLANKS)}, ' ', 'g')"

    squeezed = spelled("trim(regexp_replace(p, '[ \n]+', ' ', 'g'))")
    parts = lambda ls: f"list_filter(list_transform(regexp_split_to_array({ls}, '\n[ \n]*\n'), lambda p: {squeezed}), lambda p: p <> '')"
    texts = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in licences)
    given = ", ".join(f"({quoted(k.licence)}, {k.n}, '{k.first}', '{k.digest}')" for k in (listed() if digests is None else digests))
    return f"""
WITH texts AS (SELECT licence, {parts(lines('t'))} AS p FROM (VALUES {texts}) v(licence, t)),
known AS (
  SELECT DISTINCT licence, len(p) AS n, sha256(p[1]) AS first, sha256(array_to_string(p, ' ')) AS digest FROM texts
  UNION SELECT * FROM (VALUES {given}) v(licence, n, first, digest)),
docs AS MATERIALIZED (
  SELECT *, {parts('l')} AS p FROM (SELECT row_number() OVER () AS id, doc_id, {lines('text')} AS l FROM documents)),
whole AS (SELECT id, doc_id, p, l, CASE WHEN len(p) > 0 THEN sha256(array_to_string(p, ' ')) END AS digest FROM docs),
paragraphs AS (SELECT id, p, unnest(p) AS one, generate_subscripts(p, 1) AS i FROM docs),
runs AS (
  SELECT id, licence FROM paragraphs JOIN known ON sha256(one) = first AND i + n - 1 <= len(p)
  WHERE sha256(array_to_string(p[i : i + n - 1], ' ')) = digest),
embedded AS (SELECT id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS embedded FROM runs GROUP BY id),
lines AS (SELECT id, unnest(string_split({spelled('l')}, chr(10))) AS line FROM docs),
notices AS (
  SELECT id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM lines JOIN known ON sha256(nullif(trim(line), '')) = digest GROUP BY id)
SELECT doc_id, whole.digest, licence, embedded, notices FROM whole LEFT JOIN known USING (digest)
  LEFT JOIN embedded USING (id) LEFT JOIN notices USING (id)"""
