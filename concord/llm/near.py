"""Near duplicates: MinHash signatures joined by their coordinates, links confirmed on the full shingle sets.

Texts with the same shingle set are one node from the start. Every node has 128 pairs of coordinate and value. Two nodes
that agree in at least `POSTED_MATCHES` of them must share one of the first `128 - POSTED_MATCHES + 1` pairs of either, if
both order their pairs alike; ordered by rising frequency, that prefix skips the pairs that half the corpus has. So only
prefixes are posted. 128 more coordinates are not posted and sharpen the comparison, for which 8 bits of every coordinate are
enough and all that is sent around. Every list of nodes under one pair is then compared without writing out its square:

1. each node with two pivots of the list, the least node and one that changes among lists; pairs that agree in
   `MATCHES` coordinates are confirmed and components built;
2. members that are then in different components, in blocks of bounded size inside tasks: again only pairs that agree in
   `MATCHES` coordinates come out, each from one list only, and are confirmed.

A pair inside one component is not compared again, for it cannot change the result.

At a similarity of 0.75, 192 of 256 coordinates agree on average; fewer than 174 do for one pair in 250, and at 0.8 for
one in 300,000. Fewer than 80 of the 128 posted ones do for one pair in 2,500.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from concord.llm.common import frugal, slices, utf8
from concord.llm.shingles import WordHashes, coordinates, mixed, shingle_sets, signatures
from concord.operators.clusters import components
from concord.session import drop_table, stored, tidy

#: Coordinates that are posted, with values of 32 bits, and all coordinates, of which 8 bits are compared.
POSTED, ALL = 128, 256
#: Coordinates of all that must agree, and of those that are posted.
MATCHES, POSTED_MATCHES = 174, 80
PREFIX = POSTED - POSTED_MATCHES + 1
#: Similarity in percent.
SIMILARITY = 75
#: Coordinate-value pairs are counted in so many buckets: a table of one byte per bucket goes to the tasks.
BUCKETS = 1 << 18
#: Orders whose least member of a list is a pivot. The second is one of eight: lists of much the same members have few pivots.
ORDERS = ("node", "xxhash64(node, pair & 7)")
#: Members of a list that are compared with so many others at once, and pairs that are confirmed at once.
BLOCK, PAIRS = 2048, 4096
#: Bits of the table that tells which documents' sets are wanted.
SLOTS = 1 << 22


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    """Numbers of a column of equally long bytes, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _kept(values: np.ndarray) -> tuple[bytes, bytes]:
    """What is kept of a signature: the coordinates that are posted; and 8 bits of every one."""
    return values[:POSTED].astype(np.uint32).tobytes(), (values & 255).astype(np.uint8).tobytes()


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many coordinates the rows agree."""
    return (x == y).sum(1)


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


_SKETCH = "doc_id bigint, text_key bigint, n_shingles bigint, digest binary, posted binary, short binary"


def sketches(docs: DataFrame) -> DataFrame:
    """`doc_id, text_key, n_shingles, digest, posted, short` of every text; `text_key` is a hash of the text. `posted` has the
    coordinates that are posted, `short` 8 bits of every coordinate. Texts without words have null in the last three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, functions = WordHashes(), coordinates(ALL)
        for part in slices(batches, "text"):
            sets = shingle_sets(utf8(part, "text"), memo)
            signed = iter([_kept(v) for v in signatures(sets, functions)])
            signed = [next(signed) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([s for s, _ in signed], pa.binary()),
                    pa.array([u for _, u in signed], pa.binary()),
                ],
                ["doc_id", "text_key", "n_shingles", "digest", "posted", "short"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(frugal(run), _SKETCH)


def _pairs(posted: pa.Array) -> np.ndarray:
    """Coordinate-value pairs of signatures as 64-bit integers."""
    return (_rows(posted, np.uint32).astype(np.uint64) << np.uint64(7)) | np.arange(POSTED, dtype=np.uint64)


def _buckets(pairs: np.ndarray) -> np.ndarray:
    return (mixed(pairs) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def frequencies(nodes: DataFrame) -> np.ndarray:
    """How often the pairs of a bucket occur, as a logarithm in one byte: `BUCKETS` bytes whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                counts += np.bincount(_buckets(_pairs(some.column(0))).ravel(), minlength=BUCKETS)
        full = np.flatnonzero(counts)
        for at in range(0, len(full), 1 << 14):
            some = full[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    counted = nodes.select("posted").mapInArrow(frugal(run), "bucket bigint, n bigint")
    summed = counted.groupBy("bucket").agg(F.sum("n").alias("n"))
    level = F.least(F.lit(255), F.floor(4 * F.log2(F.col("n").cast("double")))).cast("int").alias("level")
    with tidy(nodes.sparkSession):
        found = summed.select("bucket", level).toPandas()
    levels = np.zeros(BUCKETS, np.uint8)
    levels[found["bucket"].to_numpy()] = found["level"].to_numpy()
    return levels


def postings(nodes: DataFrame, levels: np.ndarray) -> DataFrame:
    """`pair, node` for the `PREFIX` rarest pairs of every node."""
    shared = nodes.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                pairs = _pairs(some.column(1))
                rank = (shared.value[_buckets(pairs)].astype(np.uint64) << np.uint64(56)) | (mixed(pairs) >> np.uint64(8))
                first = np.argpartition(rank, PREFIX - 1, axis=1)[:, :PREFIX]
                chosen = np.take_along_axis(pairs, first, 1).astype(np.int64)
                node = np.repeat(some.column(0).to_numpy(zero_copy_only=False), PREFIX)
                yield pa.RecordBatch.from_arrays([pa.array(chosen.ravel()), pa.array(node)], ["pair", "node"])

    return nodes.select("node", "posted").mapInArrow(frugal(run), "pair bigint, node bigint")


def _with_component(rows: DataFrame, of: DataFrame) -> DataFrame:
    return rows.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _pivot(order: str) -> Column:
    return F.min(F.struct(F.expr(order).alias("o"), "node"))["node"]


def _pivot_pairs(shared: DataFrame, order: str) -> DataFrame:
    """`a, b`: every member of a list with the list's least member by `order`."""
    pivot = shared.groupBy("pair").agg(_pivot(order).alias("pivot"))
    met = shared.join(pivot, "pair").filter("node <> pivot")
    return met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs `a, b` those whose signatures agree in `MATCHES` coordinates and whose sizes allow a link."""
    left = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("short").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("short").alias("sb"))
    sized = 100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                agree = _agree(_rows(some.column(2), np.uint8), _rows(some.column(3), np.uint8))
                yield some.select([0, 1]).filter(pa.array(agree >= MATCHES))

    both = pairs.join(left, "a").join(right, "b").filter(sized)
    return both.select("a", "b", "sa", "sb").mapInArrow(frugal(run), "a bigint, b bigint")


def _rest(shared: DataFrame, of: DataFrame, nodes: DataFrame, compared: Sequence[str] = ()) -> DataFrame:
    """`pair, i, j, a, b`: all pairs of members of one list (under `pair`) in different components that agree in `MATCHES`
    coordinates, with the two blocks of the list that they are from. Pairs with the pivots by the orders `compared` have been compared
    already, so these pivots are left out, and with them the many lists of two or three.

    Members get a block number by their hash, so that a block holds about `BLOCK` of them, and a list of n blocks gives
    n * (n + 1) / 2 tasks' worth of block pairs. A pair that meets in several lists comes out of the one with the least
    coordinate, of those in both prefixes in which the values are equal.
    """
    members, pivots = _with_component(shared, of), [f"pivot_{k}" for k in range(len(compared))]
    mixed_lists = members.groupBy("pair").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"),
        *[_pivot(order).alias(name) for name, order in zip(pivots, compared)],
    )
    left = F.col("n") - F.size(F.array_distinct(F.array(*pivots).cast("array<bigint>")))
    blocks = F.ceil(left / BLOCK).cast("int")
    open_lists = mixed_lists.filter((F.col("low") != F.col("high")) & (left > 1)).select("pair", *pivots, blocks.alias("blocks"))
    rows = members.join(open_lists, "pair")
    for pivot in pivots:
        rows = rows.filter(F.col("node") != F.col(pivot)).drop(pivot)
    # the coordinates that are in a node's prefix, as two 64-bit sets
    coordinate = F.col("pair").bitwiseAND(127)
    bit = F.expr("shiftleft(1L, cast(pair & 63 AS INT))")
    prefix = shared.groupBy("node").agg(
        F.bit_or(F.when(coordinate < 64, bit).otherwise(F.lit(0).cast("bigint"))).alias("p0"),
        F.bit_or(F.when(coordinate >= 64, bit).otherwise(F.lit(0).cast("bigint"))).alias("p1"),
        # and their values, PREFIX at most, by rising coordinate
        F.transform(
            F.array_sort(F.collect_list(F.struct(coordinate.alias("at"), (F.shiftright("pair", 7) - (1 << 31)).alias("value")))),
            lambda x: x["value"].cast("int"),
        ).alias("held"),
    )
    known = nodes.select("node", "n_shingles", "short").join(prefix, "node")
    rows = rows.join(known, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    ordered = dealt.repartition("pair", "i", "j").sortWithinPartitions("pair", "i", "j", "own", "node")
    columns = ["pair", "i", "j", "own", "node", "component", "n_shingles", "p0", "p1", "held", "short"]

    def compare(table: pa.RecordBatch) -> pa.RecordBatch | None:
        names = {name: table.column(k) for k, name in enumerate(columns)}
        get = lambda name: names[name].to_numpy(zero_copy_only=False)
        coordinate = int(get("pair")[0]) & 127
        i, j = int(get("i")[0]), int(get("j")[0])
        node, component, size, own = get("node"), get("component"), get("n_shingles"), get("own")
        p0, p1 = get("p0").view(np.uint64), get("p1").view(np.uint64)
        inside = np.stack([p0, p1], 1).view(np.uint8)
        inside = np.unpackbits(inside, axis=1, bitorder="little").astype(bool)
        value = np.zeros(inside.shape, np.int32)
        value[inside] = names["held"].flatten().to_numpy(zero_copy_only=False)
        short = _rows(names["short"], np.uint8)
        found_a, found_b = [], []
        second = np.flatnonzero(own == j)
        for at in np.flatnonzero(own == i):
            others = second[second > at] if i == j else second
            others = others[component[others] != component[at]]
            low, high = np.minimum(size[others], size[at]), np.maximum(size[others], size[at])
            others = others[100 * low >= SIMILARITY * high]
            if not len(others):
                continue
            others = others[_agree(short[others], short[at]) >= MATCHES]
            if not len(others):
                continue
            first = ((value[others] == value[at]) & inside[others] & inside[at]).argmax(1)
            others = others[first == coordinate]
            found_a.append(np.minimum(node[others], node[at]))
            found_b.append(np.maximum(node[others], node[at]))
        if not found_a:
            return None
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        group = [pa.array(np.full(len(a), int(get(name)[0]))) for name in ("pair", "i", "j")]
        return pa.RecordBatch.from_arrays([*group, pa.array(a), pa.array(b)], ["pair", "i", "j", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the group that may go on in the next batch

        def group(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            return compare(whole) if whole.num_rows > 1 else None

        key_of = lambda b, at: tuple(b.column(k)[at].as_py() for k in range(3))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], 1)
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [batch.num_rows]])
            for start, end in zip(starts[:-1], starts[1:]):
                if held and key_of(held[0], 0) != tuple(keys[start]):
                    found = group(held)
                    held = []
                    if found is not None:
                        yield found
                held.append(batch.slice(start, end - start))
        if held and (found := group(held)) is not None:
            yield found

    return ordered.select(columns).mapInArrow(frugal(run), "pair bigint, i bigint, j bigint, a bigint, b bigint")


def _slots(ids: pa.Array) -> np.ndarray:
    """Slot of every doc_id in the table of wanted documents; null has slot 0."""
    plain = pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return (mixed(plain) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _shingles_of(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """`node, shingles` (sorted 64-bit hashes) of the nodes in pairs `a, b`, from the whole text of one of their documents.

    Texts don't travel: a table of `SLOTS` bits tells the tasks that read them which documents may be wanted, and only
    their sets are shuffled. A doc_id may stand on rows with other texts; the digest tells the right one.
    """
    among = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stored(among.join(nodes.select("node", "digest", "doc_id"), "node"), "wanted")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(batch.column(0))))], ["slot"])

    with tidy(docs.sparkSession):
        full = wanted.select("doc_id").mapInArrow(slots, "slot bigint").distinct().toPandas()["slot"].to_numpy()
    table = np.zeros(SLOTS, bool)
    table[full] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, table = WordHashes(), np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for part in slices(iter([batch.filter(pa.array(table[_slots(batch.column(0))]))]), "text"):
                sets = shingle_sets(utf8(part, "text"), memo)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["id", "digest", "shingles"],
                )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = texts.mapInArrow(frugal(run), "id bigint, digest binary, shingles binary")
    met = sets.join(wanted, (sets["digest"] == wanted["digest"]) & sets["id"].eqNullSafe(wanted["doc_id"]))
    return met.select("node", "shingles").dropDuplicates(["node"])


def _similar(x: bytes, y: bytes) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= SIMILARITY * (len(x) + len(y) - both)


def _confirmed_in_blocks(rest: DataFrame, shingles: DataFrame) -> DataFrame:
    """Links `u, v` among the pairs of `_rest`. A set goes once to every pair of blocks in which its node has pairs, not
    once to every pair. A pair of blocks with many pairs is cut by hashes of both ends, so that a group has about `PAIRS` of
    them."""
    blocks, group = ["pair", "i", "j"], ["pair", "i", "j", "x", "y"]
    cuts = rest.groupBy(*blocks).agg(F.ceil(F.sqrt(F.count(F.lit(1)) / PAIRS)).cast("int").alias("cuts"))
    part = lambda end: F.pmod(F.xxhash64(F.lit("part"), end), F.col("cuts")).cast("int")
    rest = stored(rest.join(cuts, blocks).withColumns({"x": part("a"), "y": part("b")}).drop("cuts"), "cut")
    ends = [rest.select(*[F.col(g).alias(f"of_{g}") for g in group], F.col(end).alias("node")) for end in ("a", "b")]
    sets = ends[0].union(ends[1]).distinct().join(shingles, "node")

    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        held = dict(zip(sets.column("node").to_pylist(), sets.column("shingles").to_pylist()))
        links = [(a, b) for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()) if _similar(held[a], held[b])]
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return sets.groupBy(*[f"of_{g}" for g in group]).cogroup(rest.groupBy(*group)).applyInArrow(run, "u bigint, v bigint")


def _confirmed(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """Of the pairs `a, b` those whose shingle sets are similar enough, as links `u, v`."""
    left = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "sa"):
            keep = [_similar(x, y) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield part.select([0, 1]).rename_columns(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(frugal(run), "u bigint, v bigint")


def groups(docs: DataFrame) -> DataFrame:
    """`doc_id, text_key, n_shingles, component, component_id` for every row of `docs` (`doc_id, text`).

    `component` numbers the groups of linked texts and is null for texts without words, which are linked with nothing;
    `component_id` is as in `near_duplicates`.
    """
    sketch = stored(sketches(docs), "sketch")
    # rows without a word have no class and never enter a group
    classes = sketch.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.first("posted").alias("posted"),
        F.first("short").alias("short"),
    )
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    posted = stored(postings(nodes, frequencies(nodes)), "postings")
    lists = posted.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("pair")
    shared = stored(posted.join(lists, "pair"), "shared")
    drop_table(posted)

    pivots = _pivot_pairs(shared, ORDERS[0]).union(_pivot_pairs(shared, ORDERS[1])).distinct()
    pairs = stored(_agreeing(pivots, nodes), "pairs")
    sets = stored(_shingles_of(docs, nodes, pairs), "shingles")
    links = stored(_confirmed(pairs, sets), "links")
    drop_table(sets)
    rest = stored(_rest(shared, components(links), nodes, ORDERS), "rest")
    drop_table(shared)
    links = links.union(_confirmed_in_blocks(rest, stored(_shingles_of(docs, nodes, rest), "shingles")))
    of = components(links)

    met = _with_component(nodes.select("node", "digest", "doc_id"), of)
    least_id = met.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = met.join(least_id, "component").select("digest", "component", "component_id")
    rows = sketch.select("doc_id", "text_key", "n_shingles", "digest").join(linked, "digest", "left")
    # a row without shingles is its own component
    reached = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "text_key", "n_shingles", "component", reached.alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` for every row of `docs` (`doc_id, text`, more columns are ignored).

    Documents are linked when 100 * shared shingles >= 75 * all shingles of both; `component_id` is the least doc_id that
    links reach and `kept` says that a row has it. Null and empty texts and texts without words have no shingles and are
    linked with nothing. Repeated rows are linked; if they repeat the doc_id too, all of them are kept. A null doc_id
    takes part but is never the least, and such a row is not kept; with nothing but null ids around, `component_id` is
    null. An empty table gives an empty result.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return groups(docs).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
