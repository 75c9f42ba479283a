"""Settings files: `<set name target value precedence>` with defaults from the parent element."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ATTRIBUTES = "_name:string,_target:string,_value:string,_precedence:string"
SCHEMA = f"_name string, _target string, _value string, _precedence string, set array<struct<{ATTRIBUTES}>>, _corrupt_record string"
OPTIONS = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}
#: The first element in the content of another one, up to the first end tag of its name.
ELEMENT = r"(?s)<([A-Za-z_][\w:.-]*)(?:\s[^<>]*)?(?:/>|>.*?</\1\s*>)"


def parse_settings(files: DataFrame, column: str = "payload") -> DataFrame:
    """Settings of XML documents: `file, ord, target, name, value, precedence, complete`.

    `files` is `file, payload`. An attribute that a `set` lacks comes from its parent. A `set` with an element in it has the XML of
    that element as its value (of the first one; text counts for nothing, and an element must not hold another of its own name).
    Rows without name, target or value have `complete = false`; `rejected_settings` lists them.
    """
    # the same elements once by their attributes and once by their content, whose entities are to stay as they are
    parsed = files.withColumn("x", F.from_xml(F.col(column), SCHEMA, OPTIONS))
    raw = F.replace(F.col(column), F.lit("&"), F.lit("&amp;"))
    parsed = parsed.withColumn("content", F.from_xml(raw, "set array<string>", OPTIONS)["set"])
    sets = parsed.select("file", "x", "content", F.posexplode_outer("x.set").alias("n", "s")).filter("s IS NOT NULL")
    element = F.nullif(F.regexp_extract(F.get("content", F.col("n")), ELEMENT, 0), F.lit(""))
    own = lambda a: F.coalesce(F.col(f"s._{a}"), F.col(f"x._{a}"))
    rows = sets.select(
        "file",
        "n",
        own("target").alias("target"),
        own("name").alias("name"),
        F.coalesce(element, own("value")).alias("value"),
        F.coalesce(own("precedence").try_cast("int"), F.lit(0)).alias("precedence"),
    )
    complete = F.col("target").isNotNull() & F.col("name").isNotNull() & F.col("value").isNotNull()
    # later files and later rows win over earlier ones
    return rows.withColumn("complete", complete).withColumn("ord", F.struct("file", "n"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """Settings of all `*.xml` files below a folder; files and folders that start with a dot are skipped by Spark."""
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").text(path, wholetext=True)
    )
    return parse_settings(files.select(F.input_file_name().alias("file"), F.col("value").alias("payload")))


def complete_settings(parsed: DataFrame) -> DataFrame:
    return parsed.filter("complete").drop("complete")


def rejected_settings(parsed: DataFrame) -> DataFrame:
    """Incomplete rows and what they lack."""
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in ("name", "target", "value")])
    return parsed.filter("NOT complete").select("file", "name", "target", missing.alias("missing"))
