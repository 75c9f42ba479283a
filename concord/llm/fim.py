"""Fill-in-middle: a text is cut at two places and written with markers, so that a model learns to fill the gap.

Units are runs of ASCII letters and single other characters. `regexp_count` gives their number, a hash of the id the two
cuts `a <= b`, and a pattern of the row's own, `(unit{a})(unit{b-a})(rest)` with possessive counts, captures prefix, middle and
suffix in one match. Possessive counts are matched in a loop and never give back, so neither the stack nor the time of a match
grows faster than the text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: A run of letters is possessive too: a count never ends inside of it.
_POSSESSIVE_UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
PLAIN, PSM, SPM = "plain", "psm", "spm"


class Rates(NamedTuple):
    """Of 100 texts so many stay plain; of 100 of the others so many have the suffix first. `seed` stands before the id."""

    plain: int = 10
    spm: int = 20
    seed: str = "1:"


class Markers(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def check(self) -> Markers:
        """Markers must be found again beside any text: each differs from the others and begins with a character that no
        marker has further on, so that no marker can begin inside of one or across its end."""
        if len(set(self)) < 3 or not all(self) or any(a[0] in b[1:] for a in self for b in self):
            raise ValueError(f"markers can't be told apart: {tuple(self)}")
        return self


def _number(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def _quoted(text: str) -> str:
    """For a Java pattern."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def transform(docs: DataFrame, rates: Rates = Rates(), markers: Markers = Markers()) -> DataFrame:
    """`doc_id, text, n, form, prefix_chars, middle_chars, output` for every row of `docs` (`doc_id, text`).

    `n` is the number of units, `form` is `plain`, `psm` (prefix, suffix, middle) or `spm` (suffix, prefix, middle). A text that is empty or
    contains a marker stays plain, and its `output` is the text and `prefix_chars` and `middle_chars` are null. A null text is empty
    and comes out as such, a null doc_id is hashed as the seed alone, repeated rows give equal rows, other columns are
    ignored and an empty table gives an empty result. Texts of any length are cut as a whole.
    """
    markers.check()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seeded = F.concat(F.lit(rates.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", text.alias("text"), F.sha2(seeded, 256).alias("digest"))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("bigint"))
    marked = F.lit(False)
    for marker in markers:
        marked = marked | F.contains("text", F.lit(marker))
    plain = (F.col("text") == "") | (_number(F.col("digest"), 2) % 100 >= 100 - rates.plain) | marked
    form = F.when(plain, PLAIN).when(_number(F.col("digest"), 3) % 100 < rates.spm, SPM).otherwise(PSM)
    first, second = (F.pmod(_number(F.col("digest"), k), F.col("n") + 1) for k in (0, 1))
    rows = rows.select(
        "doc_id", "text", "n", form.alias("form"), F.least(first, second).alias("a"), F.greatest(first, second).alias("b")
    )
    counted = lambda count: F.concat(F.lit(f"({_POSSESSIVE_UNIT}{{"), count.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), counted(F.col("a")), counted(F.col("b") - F.col("a")), F.lit(r"(.*)\z"))
    # one match; the text has no marker, so that the parts are found again between them
    captured = F.regexp_replace("text", pattern, F.lit(f"$1{_group_safe(markers.middle)}$2{_group_safe(markers.middle)}$3"))
    parts = F.split(captured, _quoted(markers.middle), -1)
    rows = rows.withColumn("parts", F.when(F.col("form") != PLAIN, parts))
    prefix, middle, suffix = (F.col("parts")[k] for k in range(3))
    p, s, m = (F.lit(x) for x in markers)
    output = (
        F.when(F.col("form") == PLAIN, F.col("text"))
        .when(F.col("form") == PSM, F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    return rows.select(
        "doc_id",
        "text",
        "n",
        "form",
        F.length(prefix).cast("bigint").alias("prefix_chars"),
        F.length(middle).cast("bigint").alias("middle_chars"),
        output.alias("output"),
    )


def _group_safe(marker: str) -> str:
    """For the replacement of a Java pattern, where `$` and `\\` mean something."""
    return marker.replace("\\", "\\\\").replace("$", "\\$")


def restore(rows: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """`rows` (`form, output` and more) with `restored`, the text that was transformed: read from these two columns alone.
    Null where `form` is null."""
    parts = F.split(F.col("output"), "|".join(_quoted(m) for m in markers.check()), -1)
    restored = (
        F.when(F.col("form") == PLAIN, F.col("output"))
        .when(F.col("form") == PSM, F.concat(parts[1], parts[3], parts[2]))
        .when(F.col("form") == SPM, F.concat(parts[2], parts[3], parts[1]))
    )
    return rows.withColumn("restored", restored)


def sql(rates: Rates = Rates()) -> str:
    """The contract's columns over the view `documents`, by lists of units."""
    number = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{rates.seed}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '{UNIT}') AS units FROM d),
c AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, {number(0)} % (len(units) + 1) AS x, {number(1)} % (len(units) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {number(2)} % 100 >= {100 - rates.plain}
      THEN 'plain' WHEN {number(3)} % 100 < {rates.spm} THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, array_to_string(units[1 : least(x, y)], '') AS prefix,
    array_to_string(units[least(x, y) + 1 : greatest(x, y)], '') AS middle,
    array_to_string(units[greatest(x, y) + 1 : n], '') AS suffix
  FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
