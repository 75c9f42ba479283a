"""URL filter: a list of allowed and blocked sites first, then association rules that FP-growth mines from labelled URLs.

A URL is a set of tokens (scheme, parts of the host, path segments, extension, names of parameters). FP-growth finds the
token combinations that occur with the label often enough; those that lead to it with enough confidence are the rules. A
rule is indexed under its rarest token, and a URL meets only the rules under its own tokens. Tokens that always occur together, as
those of a site's template do, are mined as one. Labelled URLs with too many tokens for FP-growth are mined level by level.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from concord.llm.common import ascii_lower
from concord.session import drop_table, stored

#: Item that marks a blocked URL in a transaction; no token looks like it.
BLOCKED = "=blocked"
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: Classes of tokens of a labelled URL up to which FP-growth mines the rules; beyond, sets of tokens are grown.
MAX_TOKENS = 16


class Site(NamedTuple):
    """All URLs of a host and its subdomains whose path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def rule(self) -> str:
        return self.host + self.path


# fixed values of the contract
SITES = (
    Site("allow", "org", "/"),
    Site("block", "example.org", "/es/"),
    Site("block", "example.org", "/en/1"),
    Site("allow", "com", "/fr/"),
    Site("block", "com", "/de/"),
)


_PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty for null and without `://`."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def site_rule(host: Column, path: Column, sites: Sequence[Site]) -> Column:
    """The longest rule that fits as `struct<rule, verdict>`, or null. Of equally long rules the first in the list."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for site in sorted(reversed(sites), key=lambda s: len(s.rule)):
        inside = (host == site.host) | host.endswith("." + site.host)
        found = F.when(
            inside & path.startswith(site.path), F.struct(F.lit(site.rule).alias("rule"), F.lit(site.verdict).alias("verdict"))
        ).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """The different tokens of a URL; runs of digits count as one token, and a null URL has none."""
    low = ascii_lower(url)
    plain = F.regexp_replace(low, "[0-9]+", "0")
    host = F.split(F.regexp_extract(plain, _PARTS, 1), r"\.")
    path = F.regexp_extract(plain, _PARTS, 2)
    segments = F.split(path, "/")
    query = F.split(F.regexp_extract(plain, r"\?([^#]*)", 1), "&")
    named = lambda prefix, values: F.transform(
        F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(prefix), v)
    )
    domain = F.when(F.size(host) > 1, F.array_join(F.slice(host, -2, 2), ".")).otherwise("")
    every = F.concat(
        named("scheme ", F.array(F.regexp_extract(plain, r"^([a-z0-9+.-]*)://", 1))),
        named("host ", host),
        named("domain ", F.array(domain)),
        named("path ", segments),
        named("ending ", F.array(F.regexp_extract(path, r"\.([a-z0-9]+)$", 1))),
        named("parameter ", F.transform(query, lambda q: F.split(q, "=")[0])),
    )
    return F.coalesce(F.array_distinct(every), F.array().cast("array<string>"))


def _classes(rows: DataFrame, least: float) -> DataFrame:
    """`token, freq, bad, class` of the tokens that may be in a rule: at least `least` blocked URLs have them.

    Tokens that occur in just the same URLs are one class, and the first by name stands for them, since a rule says the same with
    any of them. `freq` and `bad` count URLs and blocked URLs.
    """
    found = rows.select("id", "blocked", F.explode("items").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("freq"),
        F.count_if("blocked").alias("bad"),
        F.bit_xor(F.xxhash64("id")).alias("where_1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "id")).alias("where_2"),
    )
    # a few per URL and support: at most the tokens of a URL over the least support
    same = ["freq", "bad", "where_1", "where_2"]
    classes = found.filter(F.col("bad") >= least).groupBy(*same).agg(F.sort_array(F.collect_list("token")).alias("class"))
    return stored(classes, "classes").select(F.col("class")[0].alias("token"), "freq", "bad", "class")


def _grown(baskets: DataFrame, live: DataFrame, least: float) -> DataFrame:
    """`tokens, freq, bad` of the sets of two tokens and more that a kept rule may have, from the sets of one token (`live`).

    Sets grow by a token at a time, out of two sets of one URL that differ in their last token. A set that occurs as often as one
    without one of its tokens says nothing new, nor does any larger set; one that only blocked URLs have can't gain confidence.
    So neither grows, and no kept rule is lost. URLs with the same classes are one row.
    """
    same = baskets.groupBy("chosen").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("bad"))
    same = same.withColumn("url", F.monotonically_increasing_id())
    occur = stored(same.select("url", "n", "bad", F.explode("chosen").alias("token")).withColumn("tokens", F.array("token")).drop("token"), "sets")
    every = None
    while not live.isEmpty():
        ended = occur.select("url", "n", "bad", F.expr("slice(tokens, 1, size(tokens) - 1)").alias("head"), F.element_at("tokens", -1).alias("last"))
        other = ended.select("url", "head", F.col("last").alias("next"))
        larger = ended.join(other, ["url", "head"]).filter("last < next")
        larger = larger.select("url", "n", "bad", F.concat("head", F.array("last", "next")).alias("tokens"))
        counted = larger.groupBy("tokens").agg(F.sum("n").alias("freq"), F.sum("bad").alias("bad")).filter(F.col("bad") >= least)
        without = counted.select("tokens", "freq", "bad", F.explode("tokens").alias("out")).select(
            F.col("tokens").alias("whole"), F.col("freq").alias("had"), "bad", F.array_remove("tokens", F.col("out")).alias("tokens")
        )
        rarer = without.join(live.select("tokens", "freq"), "tokens").filter("had < freq")
        rarer = rarer.groupBy("whole", "had", "bad").agg(F.count(F.lit(1)).alias("parts")).filter("parts = size(whole)")
        found = stored(rarer.select(F.col("whole").alias("tokens"), F.col("had").alias("freq"), "bad"), "grown")
        every = found if every is None else every.union(found)
        live = found.filter("bad < freq")
        before, occur = occur, stored(larger.join(live.select("tokens"), "tokens", "left_semi"), "sets")
        drop_table(before)
    return every


def _rules(rows: DataFrame, classes: DataFrame, n: int, min_support: float, min_confidence: float, max_tokens: int) -> DataFrame:
    """`tokens, confidence, support` of all rules that may be kept, by the first tokens of classes.

    A class that every URL has, or only blocked ones, adds nothing to a rule with others. FP-growth goes over the rest. It writes out
    a number of combinations that doubles with each class of a URL, so that where a URL has more than `max_tokens` of them the
    sets are grown without those that can't be kept. Both give the same kept rules.
    """
    single = classes.select(F.array("token").alias("tokens"), "freq", "bad")
    open_classes = classes.filter((F.col("bad") < F.col("freq")) & (F.col("freq") < n))
    tokens_of = rows.select("id", F.explode("items").alias("token")).join(open_classes.select("token"), "token")
    chosen = tokens_of.groupBy("id").agg(F.sort_array(F.collect_list("token")).alias("chosen"))
    none = F.array().cast("array<string>")
    baskets = rows.select("id", "blocked").join(chosen, "id", "left").withColumn("chosen", F.coalesce("chosen", none))
    baskets = stored(baskets, "baskets")
    shares = [(F.col("bad") / F.col("freq")).alias("confidence"), (F.col("bad") / F.lit(n)).alias("support")]
    if baskets.agg(F.max(F.size("chosen"))).first()[0] > max_tokens:
        live = open_classes.select(F.array("token").alias("tokens"), "freq")
        found = single.union(_grown(baskets, live, min_support * n))
        return found.select("tokens", *shares).filter(F.col("confidence") >= min_confidence)
    items = F.when(F.col("blocked"), F.array_append("chosen", BLOCKED)).otherwise(F.col("chosen"))
    model = FPGrowth(minSupport=min_support, minConfidence=min_confidence).fit(baskets.select(items.alias("items")))
    found = model.associationRules.filter(F.array_contains("consequent", BLOCKED)).filter(F.size("antecedent") > 1)
    found = found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    return found.union(single.select("tokens", *shares).filter(F.col("confidence") >= min_confidence))


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS
) -> DataFrame:
    """Rules `rule_id, tokens, classes, keys, confidence, support` from labelled URLs (`url, blocked`).

    Support counts URLs with the tokens and the label among all labelled URLs, confidence among those with the tokens. A
    rule that has the tokens of another one and more, without more confidence, says nothing new and goes. `classes` has for each
    of the tokens all that occur in the same URLs, any of which will do; `keys` are those of the class that occurs least, by
    name where several do. Null URLs and labels are left out; without rows there are no rules. No tokens are left out: where a
    URL has more than `max_tokens` classes, rules are mined in another way with the same result.
    """
    known = labelled.filter("url IS NOT NULL AND blocked IS NOT NULL")
    empty = "rule_id string, tokens array<string>, classes array<array<string>>, keys array<string>, confidence double, support double"
    if known.isEmpty():
        return labelled.sparkSession.createDataFrame([], empty)
    rows = stored(known.select(tokens(F.col("url")).alias("items"), "blocked").withColumn("id", F.monotonically_increasing_id()), "urls")
    n = rows.count()
    classes = _classes(rows, min_support * n)
    found = stored(_rules(rows, classes, n, min_support, min_confidence, max_tokens), "rules")
    # the subsets of a rule that miss one token; rules hold a few tokens
    smaller = found.select("tokens", "confidence", F.explode("tokens").alias("out")).select(
        F.col("tokens").alias("whole"), F.col("confidence").alias("had"), F.array_remove("tokens", F.col("out")).alias("tokens")
    )
    beaten = smaller.join(found.select("tokens", "confidence"), "tokens").filter("confidence >= had")
    kept = found.join(beaten.select(F.col("whole").alias("tokens")).distinct(), "tokens", "left_anti")
    each = kept.select("tokens", F.posexplode("tokens").alias("at", "token")).join(classes, "token")
    whole = each.groupBy("tokens").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "class"))), lambda c: c["class"]).alias("classes"),
        F.min_by("class", F.struct("freq", "token")).alias("keys"),
    )
    rules = kept.join(whole, "tokens").withColumn("rule_id", F.array_join("tokens", ", "))
    return stored(rules.select("rule_id", "tokens", "classes", "keys", "confidence", "support"), "index")


def judge(pages: DataFrame, rules: DataFrame, sites: Sequence[Site] = SITES) -> DataFrame:
    """`page_id, host, path, rule, verdict, reason, confidence` for every row of `pages` (`page_id, url`).

    The longest site rule that fits decides and is given in `rule`. Other URLs are blocked if a mined rule fits, the most
    confident (then best supported, then last by name) as `reason`, and allowed otherwise. Null URLs and those without
    `://` have empty host and path and are allowed unless a rule fits their tokens. Repeated rows get equal verdicts.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    # copies of a URL are judged once; a hot URL or token is a skewed join, which Spark splits
    own = rows.select("url").filter("url IS NOT NULL").distinct().withColumn("own", tokens(F.col("url")))
    indexed = rules.withColumn("key", F.explode("keys"))
    met = own.withColumn("key", F.explode("own")).join(indexed, "key")
    met = met.filter(F.forall("classes", lambda c: F.arrays_overlap(c, "own")))
    best = F.max(F.struct("confidence", "support", "rule_id")).alias("best")
    mined = met.groupBy("url").agg(best)
    judged = rows.join(mined, "url", "left").withColumn("site", site_rule(F.col("host"), F.col("path"), sites))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("site.rule").alias("rule"),
        F.coalesce("site.verdict", F.when(F.col("best").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("site").isNull(), F.col("best.rule_id")).alias("reason"),
        F.when(F.col("site").isNull(), F.col("best.confidence")).alias("confidence"),
    )
