"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own. DataFrame functions only.

An example is one string: all turns before the reply as context, then the reply, of which alone the mask says that it is
trained on. A conversation whose last turn isn't a reply has one more example without a mask, so that no turn is lost. A turn is written as

    ### role: text</turn>

and a line feed. Control strings inside roles and texts are escaped by a backslash and a digit. After escaping every backslash has a
digit behind it that says what stood there, so that unescaping in the reverse order gives back any text.

A conversation's turns are one row (its digest needs them together); its examples are made one at a time from the list of its
formatted turns, so that a task holds one example and that list, however many examples there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>"
END = CLOSE + "\n"
#: What is escaped, in this order; the backslash must be the first. The last one is escaped in roles only.
ESCAPES = (("\\", "\\0"), (CLOSE, "\\1"), (OPEN, "\\2"), (AFTER_ROLE, "\\3"))
TRAINED = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES if role else ESCAPES[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def examples(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """`conv_id, example, n_turns, formatted, loss_start, loss_chars, last` for every example of `conversations` (`conv_id,
    turn, role, text`).

    `example` counts from 0 along the conversation, `n_turns` are the turns in it. The mask is the `loss_chars` code points of
    `formatted` behind the first `loss_start`: the escaped text of the reply without its marks; both are null in an example without a reply. `last` marks the
    example that has all turns. Rows are ordered by turn (null first), then role and text; null roles and texts are empty; rows with
    a null conv_id are one conversation; repeated rows are turns of their own; other columns are ignored; an empty table gives no
    examples. A conversation, and so any of its examples, must fit in a row (2 GB).
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(t["role"], role=True), F.lit(AFTER_ROLE))
        body = escape(t["text"])
        return F.struct(
            F.concat(head, body, F.lit(END)).alias("piece"),
            F.length(head).alias("head_chars"),
            F.length(body).alias("body_chars"),
            (t["role"] == trained).alias("reply"),
        )

    pieces = whole.select("conv_id", F.transform("turns", piece).alias("pieces"))
    n = F.size("pieces")
    replies = F.filter(F.transform("pieces", lambda p, i: F.when(p["reply"], i + 1)), lambda i: i.isNotNull())
    ends = F.array_union(replies, F.array(n))
    strings = F.transform("pieces", lambda p: p["piece"])
    dealt = pieces.select("conv_id", "pieces", strings.alias("strings"), F.posexplode(ends).alias("example", "n_turns"))
    final = F.element_at("pieces", F.col("n_turns"))
    dealt = dealt.select(
        "conv_id",
        "example",
        "n_turns",
        F.array_join(F.slice("strings", F.lit(1), F.col("n_turns")), "").alias("formatted"),
        final.alias("final"),
        (F.col("n_turns") == n).alias("last"),
    )
    # the mask lies before the end mark of the last turn
    start = F.length("formatted") - F.length(F.lit(END)) - F.col("final.body_chars")
    return dealt.select(
        "conv_id",
        F.col("example").cast("bigint").alias("example"),
        F.col("n_turns").cast("bigint").alias("n_turns"),
        "formatted",
        F.when(F.col("final.reply"), start.cast("bigint")).alias("loss_start"),
        F.when(F.col("final.reply"), F.col("final.body_chars").cast("bigint")).alias("loss_chars"),
        "last",
    )


def turns_of(formatted: Column) -> Column:
    """`array<struct<role, text>>` read from a formatted string: turns end at the end mark, a role at the first mark behind it."""
    found = F.split(formatted, END, -1)
    found = F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        at = F.instr(piece, AFTER_ROLE)
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))
        text = F.substring(piece, at + F.lit(len(AFTER_ROLE)), F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(found, turn)


def loss_text(rows: DataFrame) -> Column:
    """The plain text under the mask of an example; null without a mask."""
    return unescape(F.substring(rows["formatted"], (rows["loss_start"] + 1).cast("int"), rows["loss_chars"].cast("int")))


def digests(rows: DataFrame) -> DataFrame:
    """`conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples`, read back from `examples`.

    Turns are read from the example that has them all, the masked texts from each example in turn. The examples of a
    conversation are where its turns were gathered, so that nothing is shuffled again.
    """
    read = rows.select(
        "conv_id",
        F.when(F.col("last"), turns_of(F.col("formatted"))).alias("turns"),
        F.when(F.col("loss_start").isNotNull(), F.struct("example", loss_text(rows).alias("text"))).alias("loss"),
        F.length("formatted").cast("bigint").alias("chars"),
    )
    met = read.groupBy("conv_id").agg(
        F.flatten(F.collect_list("turns")).alias("turns"),
        F.sort_array(F.collect_list("loss")).alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    met = met.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.array_join(F.transform("loss", lambda x: x["text"]), "").alias("loss"),
        "formatted_chars",
        "n_examples",
    )
    return met.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


def planted(conversations: DataFrame) -> DataFrame:
    """`conversations` with conversation -7: a question and a reply whose texts have the template's control strings in them."""
    hard = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(hard)


def sql() -> str:
    """The contract's columns over the view `conversations`; lengths by the escapes, without formatting anything."""

    def escaped(text: str, n: int) -> str:
        for plain, code in ESCAPES[:n]:
            text = f"replace({text}, '{plain}', '{code}')"
        return text

    marks = len(OPEN) + len(AFTER_ROLE) + len(END)
    return rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, '{TRAINED}', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n,
    {marks} + length({escaped("role", 4)}) + length({escaped("text", 3)}) AS chars
  FROM t),
r AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS whole FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{TRAINED}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = '{TRAINED}'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = '{TRAINED}' OR k = n THEN whole ELSE 0 END) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE role = '{TRAINED}' OR k = n) AS n_examples
FROM r GROUP BY conv_id"""
