"""Quality classifier: perplexity under an n-gram model of trusted text, with bounds from quantiles per language.

The model is an interpolated modified Kneser-Ney model over characters, order 3. Characters and not words, because
then few different n-grams stand for all the text that a task reads: a task counts what its texts hold, writes every
n-gram once for a block of documents with the documents that have it, and from there on only those blocks move, about a
third of the size of the stored texts. Order 4 would double that.

1. `blocks`: per block of at most 2 million characters the sorted n-grams and, for each, documents and counts.
2. `gram_counts`: blocks meet the labels of their documents; counts in trusted text, summed per n-gram over the corpus.
3. `log_probabilities`: the model as joins and group-bys over different n-grams, resolved for every n-gram of the corpus.
4. `scores`: n-grams of blocks are joined with their log probability (a join sharded by n-gram) and come back as one row
   per block, which gives the sums of its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from concord.llm.common import frugal, slices
from concord.session import stored

#: Marks before and after a text; a text that holds them is scored like any other.
START, END = "\x02\x02", "\x03"
#: N-grams of a block at most.
BLOCK = 2_000_000
#: Text bytes that a task holds as numbers at once.
SLICE = 2 << 20
#: Bits of a character in an n-gram key.
BITS = 21
#: How many times the distance of the 5 % and 95 % quantiles from the median a log perplexity may lie off the median, both at
#: the length of the text. By the labels of sf0.1: 2.5 keeps 27 of 571 documents of quality 0 and loses 6 of 3,409 of quality 1,
#: 3 keeps 36 and loses 2, 4 keeps 48 and loses 1.
REACH = 3.0

_BLOCK_SCHEMA = (
    "block bigint, rows array<bigint>, ids array<bigint>, langs array<string>, keys array<bigint>, grams array<bigint>, "
    "sizes binary, places binary, counts binary"
)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def _count(chars: np.ndarray, doc: np.ndarray, first: int, last: int) -> tuple[np.ndarray, ...]:
    """Sorted n-gram keys, documents per n-gram, and document (from `first`) and count per entry."""
    present = np.zeros(int(chars.max()) + 1, bool)
    present[chars] = True
    alphabet = np.flatnonzero(present)
    code = np.cumsum(present) - 1
    dense, a, n = code[chars], len(alphabet), last - first + 1
    inside = doc[:-2] == doc[2:]
    gram = ((dense[:-2] * a + dense[1:-1]) * a + dense[2:])[inside]
    both = np.sort(gram * n + (doc[:-2][inside] - first))
    start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    counts = np.diff(np.append(start, len(both)))
    gram, place = np.divmod(both[start], n)
    begin = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    sizes = np.diff(np.append(begin, len(gram)))
    gram = gram[begin]
    keys = alphabet[gram // (a * a)] << (2 * BITS) | alphabet[gram // a % a] << BITS | alphabet[gram % a]
    return keys, sizes, place, counts


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents as described above. `rows` numbers the rows of `docs`; a long text is in several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        block = seen = 0
        for part in slices(batches, "text", SLICE):
            ids, langs, text_keys, texts = (part.column(k).to_pylist() for k in range(4))
            texts = ["" if t is None else t for t in texts]
            whole = "".join([START + t + END for t in texts])
            chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64)
            doc = np.repeat(np.arange(len(texts)), [len(t) + 3 for t in texts])
            for at in range(0, len(chars) - 2, BLOCK):
                some, of = chars[at : at + BLOCK + 2], doc[at : at + BLOCK + 2]
                first, last = int(of[0]), int(of[-1])
                keys, sizes, place, counts = _count(some, of, first, last)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([base + block], pa.int64()),
                        pa.array([[base + seen + d for d in range(first, last + 1)]], pa.list_(pa.int64())),
                        pa.array([ids[first : last + 1]], pa.list_(pa.int64())),
                        pa.array([langs[first : last + 1]], pa.list_(pa.string())),
                        pa.array([text_keys[first : last + 1]], pa.list_(pa.int64())),
                        pa.array([keys], pa.list_(pa.int64())),
                        pa.array([_pack(sizes.astype(np.uint16))], pa.binary()),
                        # distances between documents are small and pack well; 2,048 documents at most
                        pa.array([_pack(np.diff(place, prepend=0).astype(np.int16))], pa.binary()),
                        pa.array([_pack(counts.astype(np.uint32))], pa.binary()),
                    ],
                    ["block", "rows", "ids", "langs", "keys", "grams", "sizes", "places", "counts"],
                )
                block += 1
            seen += len(texts)

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.xxhash64("text").alias("text_key"),
        "text",
    )
    return rows.mapInArrow(frugal(run), _BLOCK_SCHEMA)


def gram_counts(parts: DataFrame, trusted: DataFrame) -> DataFrame:
    """`gram, n` for every n-gram of the corpus; `n` counts it in documents whose id is in `trusted`."""
    members = parts.select("block", F.posexplode("ids").alias("place", "doc_id"))
    known = members.join(trusted.select("doc_id").distinct(), "doc_id", "left_semi")
    # a block has 2,048 documents at most
    chosen = known.groupBy("block").agg(F.collect_list("place").alias("chosen"))
    met = parts.select("block", "grams", "sizes", "places", "counts").join(chosen, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, grams, sizes, places, counts, chosen in zip(*(c.to_pylist() for c in batch.columns)):
                sizes, counts = _unpack(sizes, np.uint16).astype(np.int64), _unpack(counts, np.uint32).astype(np.int64)
                place = np.cumsum(_unpack(places, np.int16).astype(np.int64))
                good = np.zeros(int(place.max()) + 1 if len(place) else 1, np.int64)
                picked = np.array(chosen or [], np.int64)
                good[picked[picked < len(good)]] = 1
                n = np.add.reduceat(counts * good[place], np.cumsum(sizes) - sizes)
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), pa.array(n)], ["gram", "n"])

    return met.mapInArrow(frugal(run), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of an order from how many n-grams occur once, twice, three and four times."""
    n = counts.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), k) for k, d in zip((1, 2, 3), found))


def _discounted(d: tuple[float, float, float]) -> Column:
    n = F.coalesce(F.col("n"), F.lit(0))
    cut = F.when(n >= 3, d[2]).when(n == 2, d[1]).when(n == 1, d[0]).otherwise(0.0)
    return n - cut


def _contexts(counts: DataFrame, context: Column, d: tuple[float, float, float]) -> DataFrame:
    """Per context the sum of its counts and the mass that the discounts free."""
    times = lambda k: F.count(F.when(F.col("n") == k, 1))
    many = F.count(F.when(F.col("n") >= 3, 1))
    freed = d[0] * times(1) + d[1] * times(2) + d[2] * many
    return counts.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), freed.alias("freed"))


def log_probabilities(counts: DataFrame) -> DataFrame:
    """`gram, logp` for every row of `counts` (`gram, n`), by the model that the rows with n > 0 make."""
    low = lambda bits: F.col("gram").bitwiseAND((1 << bits) - 1)
    high = F.shiftright("gram", BITS)
    three = counts.filter("n > 0")
    two = three.groupBy(low(2 * BITS).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    one = two.groupBy(low(BITS).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    d3, d2, d1 = _discounts(three), _discounts(two), _discounts(one)
    # one more character stands for all that were never seen
    size, total, freed = _contexts(one, F.lit(0), d1).join(
        one.agg((F.count(F.lit(1)) + 1).alias("size")), how="right"
    ).select("size", F.coalesce("total", F.lit(0)), F.coalesce("freed", F.lit(0.0))).first()

    grams = counts.select("gram").select("gram", low(2 * BITS).alias("g2"), low(BITS).alias("g1"))
    seen = one.select(F.col("gram").alias("g1"), _discounted(d1).alias("k1"))
    p1 = (F.coalesce("k1", F.lit(0.0)) + freed / size) / total if total else F.lit(1.0 / size)
    level = grams.join(seen, "g1", "left").withColumn("p", p1).drop("k1", "g1")

    def interpolate(level: DataFrame, key: str, counted: DataFrame, d) -> DataFrame:
        own = counted.select(F.col("gram").alias(key), _discounted(d).alias("k"))
        around = _contexts(counted, high, d)
        met = level.join(own, key, "left").withColumn("context", F.shiftright(key, BITS))
        met = met.join(around, "context", "left")
        mixed = (F.coalesce("k", F.lit(0.0)) + F.col("freed") * F.col("p")) / F.col("total")
        return met.withColumn("p", F.coalesce(mixed, "p")).drop("k", "total", "freed", "context")

    level = interpolate(level, "g2", two, d2).drop("g2")
    return interpolate(level, "gram", three, d3).select("gram", F.log("p").alias("logp"))


def scores(parts: DataFrame, probabilities: DataFrame) -> DataFrame:
    """`row, doc_id, lang, text_key, n_grams, logp` per document: how many n-grams, and the sum of their log probabilities."""
    asked = parts.select("block", F.posexplode("grams").alias("at", "gram"))
    # a block has BLOCK n-grams at most
    told = (
        asked.join(probabilities, "gram")
        .groupBy("block")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "logp"))), lambda x: x["logp"]).alias("logps"))
    )
    met = parts.select("block", "rows", "ids", "langs", "keys", "sizes", "places", "counts").join(told, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, ids, langs, text_keys, sizes, places, counts, logps in zip(*(c.to_pylist() for c in batch.columns)):
                sizes, counts = _unpack(sizes, np.uint16).astype(np.int64), _unpack(counts, np.uint32)
                place = np.cumsum(_unpack(places, np.int16).astype(np.int64))
                logp = np.repeat(np.array(logps), sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows, pa.int64()),
                        pa.array(ids, pa.int64()),
                        pa.array(langs, pa.string()),
                        pa.array(text_keys, pa.int64()),
                        pa.array(np.bincount(place, counts, len(rows)).astype(np.int64)),
                        pa.array(np.bincount(place, counts * logp, len(rows))),
                    ],
                    ["row", "doc_id", "lang", "text_key", "n_grams", "logp"],
                )

    schema = "row bigint, doc_id bigint, lang string, text_key bigint, n_grams bigint, logp double"
    summed = met.mapInArrow(frugal(run), schema).groupBy("row")
    return summed.agg(
        F.first("doc_id").alias("doc_id"),
        F.first("lang").alias("lang"),
        F.first("text_key").alias("text_key"),
        F.sum("n_grams").alias("n_grams"),
        F.sum("logp").alias("logp"),
    )


def _spread_power(off: DataFrame) -> float:
    """The power of `n_grams` with which the distances `off` of trusted documents go; 0 if that can't be told, -0.5 if all
    n-grams were independent."""
    far = off.filter(F.abs("off") > 1e-9)
    slope = far.agg(F.regr_slope(F.log(F.abs("off")), F.log("n_grams"))).first()[0]
    return min(max(slope, -1.0), 0.0) if slope is not None and slope == slope else 0.0


def classify(docs: DataFrame, labels: DataFrame, reach: float = REACH) -> DataFrame:
    """`doc_id, lang, text_key, n_grams, perplexity, low, high, kept` for every row of `docs` (`doc_id, text, lang`); `text_key`
    is a hash of the text.

    Trusted text is all text of documents that `labels` (`doc_id, quality`) gives quality 1. A document is kept when its
    log perplexity lies within `reach` times the distance of the 5 % and 95 % quantiles from the median, all of the
    trusted documents of its language; a language without trusted documents takes the bounds of all, and without any
    trusted document nothing bounds. The mean over few n-grams strays more: distances from the median are taken relative to
    a power of the length, which is fitted to those of the trusted documents. A null or empty text has no perplexity and is not kept. A null language is a language of its own;
    a document with a null id can't be trusted. Repeated rows get equal values, an empty table gives an empty result.
    """
    trusted = labels.filter("quality = 1").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    parts = stored(blocks(docs), "blocks")
    counts = stored(gram_counts(parts, trusted), "grams")
    found = stored(scores(parts, stored(log_probabilities(counts), "model")), "scores")
    found = found.withColumn("entropy", F.when(F.col("n_grams") > 1, -F.col("logp") / F.col("n_grams")))
    known = found.join(trusted, "doc_id", "left_semi").filter("entropy IS NOT NULL")
    median = F.percentile_approx("entropy", 0.5, 10_000)
    middles = known.groupBy("lang").agg(median.alias("middle"))
    met = known.alias("k").join(middles.alias("m"), F.col("k.lang").eqNullSafe(F.col("m.lang")))
    off = stored(met.select("k.lang", "n_grams", "entropy", (F.col("entropy") - F.col("middle")).alias("off")), "trusted")
    power = _spread_power(off)
    # relative to the power of the length, the distances of long and of short texts are alike
    off = off.withColumn("off", F.col("off") / F.pow("n_grams", F.lit(power)))
    own = off.groupBy("lang").agg(F.concat(F.array(median), F.percentile_approx("off", [0.05, 0.95], 10_000)).alias("own"))
    # languages are apart at any length, so that only texts shorter than most get more room here
    every = known.agg(
        F.percentile_approx("entropy", [0.05, 0.5, 0.95], 10_000).alias("every"), F.percentile_approx("n_grams", 0.5).alias("length")
    ).withColumn("one", F.lit(1))
    rows = found.withColumn("one", F.lit(1)).join(every, "one", "left").alias("f")
    rows = rows.join(own.alias("o"), F.col("f.lang").eqNullSafe(F.col("o.lang")), "left")
    room = reach * F.pow("n_grams", F.lit(power))
    wide = reach * F.greatest(F.lit(1.0), F.pow(F.col("n_grams") / F.col("length"), F.lit(power)))
    o, e = F.col("own"), F.col("every")
    low = F.coalesce(o[0] + room * o[1], e[1] - wide * (e[1] - e[0]))
    high = F.coalesce(o[0] + room * o[2], e[1] + wide * (e[2] - e[1]))
    inside = F.col("entropy").between(F.coalesce(low, F.col("entropy")), F.coalesce(high, F.col("entropy")))
    return rows.select(
        "doc_id",
        "f.lang",
        "text_key",
        F.when(F.col("entropy").isNotNull(), F.col("n_grams")).otherwise(0).alias("n_grams"),
        F.exp("entropy").alias("perplexity"),
        F.exp(low).alias("low"),
        F.exp(high).alias("high"),
        F.coalesce(inside, F.lit(False)).alias("kept"),
    )
