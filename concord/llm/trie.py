"""The trie of conversation prefixes and totals of its subtrees, by time-forward processing.

A node is a distinct sequence of first turns. Its name is its depth and the exclusive or of a hash per turn and place, so that names
of all prefixes of a conversation are running totals, and no prefix is ever written out.

Totals go from the deepest nodes up. Nodes are cut into bands of depth, each twice as deep as the one before, and in a band into shards:
a shard is what hangs on one node of the band's least depth. A task sorts the nodes of its shards by falling depth (Spark's sort,
which spills) and runs over them once. Every node finds what its children sent in a priority queue ordered alike, adds it up and
sends its totals to its parent through the queue, which writes sorted runs to disk when it is full. What a shard's root sends
leaves the shard: messages are added up per parent before and behind the shuffle and meet the nodes of the next band.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import pickle
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from concord.session import scratch_path, stored

#: Messages that a queue holds in memory, messages that are read from a run at once, runs that are open at once.
QUEUE, READ, RUNS = 100_000, 4096, 16
#: Turns of the base conversation that may be taken over: less than this.
SHARED = 6
#: Conversations that have the same base conversation.
SERIES = 100
#: Neighbouring ids that are digested as one piece.
PIECE = 4096


# -- turns ------------------------------------------------------------------------------------------------------------


def turns(conversations: DataFrame) -> DataFrame:
    """`conv_id, turn, role, m1, m2, chars` of every row with a conv_id: the digest of role and text as two numbers of 60
    bits, and the code points of the text. Texts stay where they are read."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        digest.alias("digest"),
        F.length(text).cast("bigint").alias("chars"),
    )
    half = lambda start: F.conv(F.substring("digest", start, 15), 16, 10).cast("bigint")
    return rows.select("conv_id", "turn", "role", half(1).alias("m1"), half(17).alias("m2"), "chars")


def scanned(rows: DataFrame, order: list[Column], totals: dict[str, Column], name: str) -> DataFrame:
    """`rows` with running totals along `order` per `conv_id`, own row included; `totals` are aggregates by name that a sum
    or an exclusive or of parts puts together (`n`: a sum, others: exclusive or).

    Rows are dealt by ranges of conversation and order, so that a conversation of any size is spread over tasks. What
    stands before a range in its first conversation comes from one row per range and conversation that ends or begins there: a
    table of two rows per range.
    """
    dealt = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()), name)
    ends = dealt.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"))
    ends = ends.select("part", F.explode(F.array_distinct(F.array("first", "last"))).alias("conv_id"))
    parts = dealt.join(ends, ["part", "conv_id"]).groupBy("part", "conv_id").agg(*[c.alias(k) for k, c in totals.items()])
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    put = lambda k, w: (F.sum(k) if k == "n" else F.bit_xor(k)).over(w)
    carried = parts.select("part", "conv_id", *[F.coalesce(put(k, before), F.lit(0)).alias(f"before_{k}") for k in totals])
    along = W.partitionBy("part", "conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = dealt.select("*", *[c.over(along).alias(k) for k, c in totals.items()]).join(carried, ["part", "conv_id"], "left")
    own = lambda k: F.coalesce(F.col(f"before_{k}"), F.lit(0))
    return run.select(
        *rows.columns, *[(F.col(k) + own(k) if k == "n" else F.col(k).bitwiseXOR(own(k))).alias(k) for k in totals]
    )


def rebuilt(found: DataFrame) -> DataFrame:
    """`conv_id, depth, m1, m2, chars`: the turns of all rebuilt conversations, by `depth` from 1; `found` is `turns`.

    A conversation takes the first h turns of the first conversation of its series, h by its own id, then its own turns after its
    first h. At most five rows of a base conversation are joined, to at most a hundred conversations.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("m1"), F.col("m2")]
    numbered = stored(scanned(found, order, {"n": F.count(F.lit(1))}, "numbered"), "places")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % SERIES).alias("base")
    every = numbered.select("conv_id").distinct().select("conv_id", h, base)
    heads = numbered.filter((F.col("n") < SHARED) & (F.col("conv_id") % SERIES == 0))
    heads = heads.select(F.col("conv_id").alias("base"), F.col("n").alias("depth"), "m1", "m2", "chars")
    taken = every.join(heads, "base").filter("depth <= h").select("conv_id", "depth", "m1", "m2", "chars")
    # own turns move up by what the base lacks
    given = heads.groupBy("base").agg(F.max("depth").alias("given"))
    moved = every.join(given, "base", "left").select(
        F.col("conv_id").alias("id"), "h", (F.col("h") - F.least("h", F.coalesce("given", F.lit(0)))).alias("up")
    )
    own = numbered.withColumn("h", h).filter("n > h").drop("h")
    shifts = moved.filter("up > 0").select("id", "up")
    own = own.join(shifts, own["conv_id"] == shifts["id"], "left").select(
        "conv_id", (F.col("n") - F.coalesce("up", F.lit(0))).alias("depth"), "m1", "m2", "chars"
    )
    return taken.unionByName(own)


# -- nodes ------------------------------------------------------------------------------------------------------------


def paths(found: DataFrame) -> DataFrame:
    """`conv_id, depth, k1, k2, p1, p2, s1, s2, band, chars`: for every turn of the rebuilt conversations the name of its node, of
    its parent, and of the node that its shard hangs on, at the largest power of two in its depth."""
    hashed = rebuilt(found).withColumns(
        {"h1": F.xxhash64("depth", "m1", "m2"), "h2": F.xxhash64("m2", F.lit("second"), "m1", "depth")}
    )
    totals = {"k1": F.bit_xor("h1"), "k2": F.bit_xor("h2")}
    named = scanned(hashed, [F.col("depth")], totals, "paths")
    rows = stored(
        named.select(
            "conv_id",
            "depth",
            "k1",
            "k2",
            F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"),
            F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"),
            (F.length(F.bin("depth")) - 1).alias("band"),
            "chars",
        ),
        "named",
    )
    roots = rows.filter(F.col("depth") == F.expr("shiftleft(1L, band)")).select(
        F.col("conv_id").alias("of"), F.col("band").alias("of_band"), F.col("k1").alias("s1"), F.col("k2").alias("s2")
    )
    return rows.join(roots, (rows["conv_id"] == roots["of"]) & (rows["band"] == roots["of_band"])).drop("of", "of_band")


def end_digests(ends: DataFrame) -> DataFrame:
    """`e_depth, e1, e2, ends_sha256` of `ends` (`depth, k1, k2, conv_id`): the digest of the ids that end at a node, in rising
    order with commas between. Ids are first put together in pieces of at most `PIECE` of them, wherever their node is; a
    digest can't be split, so the pieces of a node are sorted by Spark and digested as they pass, and a task holds one state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for batch in batches:
            for depth, k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (depth, k1, k2) != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (depth, k1, k2), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if done:
                yield _batch(done, _ENDS)
                done = []
        if node is not None:
            yield _batch([(*node, state.hexdigest())], _ENDS)

    pieces = ends.groupBy("depth", "k1", "k2", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    dealt = pieces.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "piece")
    schema = "e_depth bigint, e1 bigint, e2 bigint, ends_sha256 string"
    return dealt.select("depth", "k1", "k2", "ids").mapInArrow(run, schema)


_ENDS = pa.schema([("e_depth", pa.int64()), ("e1", pa.int64()), ("e2", pa.int64()), ("ends_sha256", pa.string())])
_SUMS = ("n_children", "n_leaves", "saved_tokens")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


class SpillingQueue:
    """A priority queue of tuples with bounded memory: what is over `size` is written as a sorted run, and too many runs are
    merged into one. Runs are unnamed files in Spark's own scratch folders; they end with the task."""

    def __init__(self, size: int = QUEUE, runs: int = RUNS) -> None:
        self.size, self.most = size, runs
        self.heap: list[tuple] = []
        self.runs: list[tuple[tuple, int, Iterator[tuple]]] = []  # the next message of a run, its number, what follows
        self.made = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.size:
            self._add(self._written(iter(sorted(self.heap))))
            self.heap = []
            if len(self.runs) > self.most:
                every = [itertools.chain([first], rest) for first, _, rest in self.runs]
                self.runs = []
                self._add(self._written(heapq.merge(*every)))

    def pop(self, least: tuple) -> Iterator[tuple]:
        """All messages that begin with `least`, which nothing in the queue is below."""
        n = len(least)
        while True:
            top = self.heap[0] if self.heap else None
            run = self.runs[0][0] if self.runs else None
            if top is not None and (run is None or top <= run):
                if top[:n] != least:
                    return
                yield heapq.heappop(self.heap)
            elif run is not None:
                if run[:n] != least:
                    return
                first, number, rest = heapq.heappop(self.runs)
                self._add(rest)
                yield first
            else:
                return

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)

    def _add(self, items: Iterator[tuple]) -> None:
        first = next(items, None)
        if first is not None:
            self.made += 1
            heapq.heappush(self.runs, (first, self.made, items))

    @staticmethod
    def _written(items: Iterator[tuple]) -> Iterator[tuple]:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)  # noqa: SIM115  closed by the reader
        part: list[tuple] = []
        for item in items:
            part.append(item)
            if len(part) == READ:
                pickle.dump(part, file, pickle.HIGHEST_PROTOCOL)
                part = []
        pickle.dump(part, file, pickle.HIGHEST_PROTOCOL)
        file.seek(0)

        def read() -> Iterator[tuple]:
            with file:
                while block := pickle.load(file):
                    yield from block
                    if len(block) < READ:
                        return

        return read()


class _Node(NamedTuple):
    depth: int
    k1: int
    k2: int
    kind: int  # 0: totals that come from another shard, 1: the node
    p1: int
    p2: int
    worth: int  # (conversations - 1) * code points of the last text
    n_children: int
    n_leaves: int
    saved_tokens: int


_OUT = pa.schema([(n, pa.int64()) for n in ("depth", "k1", "k2", "kind", *_SUMS)])
_OUT_SQL = ", ".join(f"{n} bigint" for n in _OUT.names)


def passed_up(rows: Iterator[_Node], least: int, size: int = QUEUE) -> Iterator[tuple]:
    """Totals of the nodes of whole shards, which come by falling depth, then name, then kind: `(depth, k1, k2, 1, sums)`; and what
    the nodes of depth `least` send out to their parents: `(depth, k1, k2, 0, sums)`."""
    queue = SpillingQueue(size)
    came = None
    for row in rows:
        if row.kind == 0:
            came = row
            continue
        sums = [0, 0, 0]
        if came is not None and came[:3] == row[:3]:
            sums = [came.n_children, came.n_leaves, came.saved_tokens]
        came = None
        for sent in queue.pop((-row.depth, row.k1, row.k2)):
            sums = [sums[0] + 1, sums[1] + sent[3], sums[2] + sent[4]]
        if sums[0] == 0:
            sums[1] = 1
        sums[2] += row.worth
        yield (row.depth, row.k1, row.k2, 1, *sums)
        if row.depth > least:
            queue.push((1 - row.depth, row.p1, row.p2, sums[1], sums[2]))
        else:
            yield (row.depth - 1, row.p1, row.p2, 0, 1, sums[1], sums[2])
    if len(queue):
        raise ValueError("a node's parent isn't in its shard")


def _band(nodes: DataFrame, messages: DataFrame | None, least: int) -> DataFrame:
    """`_OUT` for the nodes of a band that begins at depth `least`; `messages` are what deeper bands sent to its nodes."""
    zero = F.lit(0).cast("bigint")
    rows = nodes.select(
        "s1", "s2", "depth", "k1", "k2", F.lit(1).cast("bigint").alias("kind"), "p1", "p2",
        ((F.col("n_convs") - 1) * F.col("chars")).alias("worth"), *[zero.alias(s) for s in _SUMS],
    )
    if messages is not None:
        summed = messages.groupBy("depth", "k1", "k2").agg(*[F.sum(s).cast("bigint").alias(s) for s in _SUMS])
        placed = summed.join(nodes.select("depth", "k1", "k2", "s1", "s2"), ["depth", "k1", "k2"])
        rows = rows.unionByName(
            placed.withColumns({"kind": zero, "p1": zero, "p2": zero, "worth": zero}).select(*rows.columns)
        )
    columns = list(_Node._fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (_Node(*r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        done = []
        for row in passed_up(each, least):
            done.append(row)
            if len(done) == READ:
                yield _batch(done, _OUT)
                done = []
        if done:
            yield _batch(done, _OUT)

    dealt = rows.repartition("s1", "s2").sortWithinPartitions(F.desc("depth"), "k1", "k2", "kind")
    return dealt.select(*columns).mapInArrow(run, _OUT_SQL)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt `conversations` (`conv_id, turn, role, text`): `conv_id` (least member),
    `depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`.

    Rows are ordered by turn (null first), equal turns by role and then by a digest of the text; null roles and texts are
    empty; rows without conv_id are in no conversation; repeated rows are turns of their own; other columns are ignored. An empty
    table has no members and so no root: an empty result.
    """
    spark = conversations.sparkSession
    found = stored(turns(conversations), "turns")
    every = found.agg(F.count_distinct("conv_id").alias("n"), F.min("conv_id").alias("least")).first()
    path = stored(paths(found), "paths")
    # the root and conversations that are rebuilt without a turn
    lengths = path.groupBy("conv_id").agg(F.max("depth").alias("length"))
    zero = F.lit(0).cast("bigint")
    below = path.groupBy("depth", "k1", "k2", "p1", "p2", "s1", "s2", "band").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars")
    )
    root = spark.range(1).filter(F.lit(every["n"] > 0)).select(
        *[zero.alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "s1", "s2")],
        F.lit(-1).alias("band"),
        F.lit(every["n"]).cast("bigint").alias("n_convs"),
        F.lit(every["least"]).cast("bigint").alias("conv_id"),
        zero.alias("chars"),
    )
    table = scratch_path(spark, "nodes")
    below.unionByName(root).write.partitionBy("band").parquet(table)
    schema = [f for f in below.schema.fields if f.name != "band"]
    nodes = spark.read.schema(", ".join(f"{f.name} bigint" for f in schema) + ", band int").parquet(table)

    bands = [r["band"] for r in nodes.select("band").distinct().collect()]
    done, messages = [], None
    for band in sorted(bands, reverse=True):
        out = stored(_band(nodes.filter(F.col("band") == band), messages, 1 << band if band >= 0 else 0), "totals")
        messages = out.filter("kind = 0").drop("kind")
        done.append(out.filter("kind = 1").drop("kind"))
    totals = done[0] if done else spark.createDataFrame([], _OUT_SQL).drop("kind")
    for more in done[1:]:
        totals = totals.unionByName(more)

    # a conversation ends at its deepest node; those without a turn at the root
    last = lengths.withColumnRenamed("conv_id", "of")
    deepest = path.join(last, (F.col("conv_id") == F.col("of")) & (F.col("depth") == F.col("length")))
    turnless = found.select("conv_id").distinct().join(lengths.select("conv_id"), "conv_id", "left_anti")
    ends = deepest.select("depth", "k1", "k2", "conv_id").unionByName(
        turnless.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id")
    )
    digests = end_digests(ends)
    parents = nodes.filter("depth > 0").select(
        (F.col("depth") + 1).alias("c_depth"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("conv_id").alias("of_parent")
    )
    met = nodes.join(totals, ["depth", "k1", "k2"])
    met = met.join(
        digests, (met["depth"] == digests["e_depth"]) & (met["k1"] == digests["e1"]) & (met["k2"] == digests["e2"]), "left"
    )
    # the root has most children, and its least member is known
    hung = met.filter("depth > 1").join(
        parents, (F.col("depth") == F.col("c_depth")) & (F.col("p1") == F.col("c1")) & (F.col("p2") == F.col("c2"))
    )
    of_root = F.when(F.col("depth") == 1, F.lit(every["least"])).cast("bigint")
    met = hung.unionByName(met.filter("depth <= 1").withColumn("of_parent", of_root), allowMissingColumns=True)
    empty = F.sha2(F.lit(""), 256)
    return met.select(
        "conv_id",
        "depth",
        F.col("of_parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


def sql() -> str:
    """The same over the view `conversations`, with prefixes written out as lists."""
    return """
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
e AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM o)),
r AS (
  SELECT e.conv_id, 0 AS part, n, role, text FROM e JOIN o ON o.conv_id = e.base AND n <= h
  UNION ALL SELECT e.conv_id, 1, n, role, text FROM e JOIN o USING (conv_id) WHERE n > h),
p AS MATERIALIZED (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
    list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY part, n ROWS UNBOUNDED PRECEDING) AS pre
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, n)),
q AS MATERIALIZED (
  SELECT conv_id, depth, chars, least, max(depth) OVER (PARTITION BY conv_id) AS deepest FROM (
    SELECT *, min(conv_id) OVER (PARTITION BY pre) AS least FROM p)
  UNION ALL SELECT conv_id, 0, 0, (SELECT min(conv_id) FROM e), coalesce((SELECT max(depth) FROM p WHERE p.conv_id = e.conv_id), 0) FROM e),
m AS MATERIALIZED (
  SELECT least, depth, count(*) AS n_convs, max(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = deepest), '')) AS ends
  FROM q GROUP BY least, depth),
u AS MATERIALIZED (
  SELECT m.*, up.least AS parent FROM m LEFT JOIN q up ON up.conv_id = m.least AND up.depth = m.depth - 1),
c AS MATERIALIZED (
  SELECT u.*, (SELECT count(*) FROM u x WHERE x.parent = u.least AND x.depth = u.depth + 1) AS n_children FROM u),
s AS (
  SELECT q.least, q.depth, sum(CASE WHEN c.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
    sum((c.n_convs - 1) * c.chars) AS saved_tokens
  FROM c JOIN q ON q.conv_id = c.least AND q.depth <= c.depth GROUP BY ALL)
SELECT c.least AS conv_id, CAST(c.depth AS BIGINT) AS depth, c.parent AS parent_conv_id, c.n_convs, c.n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM c JOIN s USING (least, depth)"""
