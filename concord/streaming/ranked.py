"""Ranked running result: clusters with merged fields, term sums and document frequency that follow a stream.

Every merge key has a typed state: members, term sums, the arrival of the first hit of every term, how many members came before it, and
the merged fields. Records are combined per key and terms found inside the tasks, so that a hot key sends a few rows per batch to its
state. A batch writes the clusters that it changed, and the document frequency of everything so far, which is the last one plus
what the changed clusters add to it. A reader scores the newest clusters by the newest frequency, like `rank` does in one go.

Batches are taken in their order, and in a batch records in the order of `arrival`; if arrivals rise from batch to batch, the scores
are those of `rank` over all records.
"""

from __future__ import annotations

from typing import Iterator, Mapping, NamedTuple, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from concord.catalog import Catalog
from concord.operators.merge import first_values, longest_entry, range_ends, shaped, single_fields
from concord.operators.rank import Frequency, Term, with_relevance, with_term_counts
from concord.operators.records import real_values
from concord.streaming.intake import latest

#: Digits of the parts of a sortable text: a size counted down from `LARGEST`, an arrival, a place.
SIZE_DIGITS, ARRIVAL_DIGITS, PLACE_DIGITS = 10, 19, 10
LARGEST = 1 << 32
MORE_TERMS = 62


def _pad(number: Column, digits: int) -> Column:
    return F.lpad(number.cast("bigint").cast("string"), digits, "0")


def _candidates(catalog: Catalog) -> tuple[list[Column], list[str], list[str]]:
    """What a record gives to the merged fields, as columns that combine by least text, or by least and largest number."""
    columns, texts, numbers = [], [], []
    for n, f in enumerate(single_fields(catalog)):
        if f.merge == "longest":
            e = longest_entry(f, catalog)
            head = [_pad(e["size"] + LARGEST, SIZE_DIGITS), _pad(e["arrival"], ARRIVAL_DIGITS), _pad(e["ord"], PLACE_DIGITS)]
            columns.append(F.concat(*head, e["disp"]).alias(f"m{n}"))
            texts.append(f"m{n}")
        elif f.merge == "range":
            low, high = range_ends(f)
            columns += [low.cast("double").alias(f"m{n}_min"), high.cast("double").alias(f"m{n}_max")]
            numbers.append(f"m{n}")
        else:
            values = F.to_json(first_values(f, catalog))
            found = F.when(F.size(real_values(f)) > 0, F.concat(_pad(F.col("arrival"), ARRIVAL_DIGITS), values))
            columns.append(found.alias(f"m{n}"))
            texts.append(f"m{n}")
    return columns, texts, numbers


def _merged(rows: DataFrame, catalog: Catalog) -> DataFrame:
    """The structs `merged` and `sort` out of the columns of `_candidates`."""
    for n, f in enumerate(single_fields(catalog)):
        if f.merge == "longest":
            disp = F.substr(F.col(f"m{n}"), F.lit(SIZE_DIGITS + ARRIVAL_DIGITS + PLACE_DIGITS + 1))
            rows = rows.withColumn(f"m{n}", F.struct(disp.alias("disp")))
        elif f.merge == "range":
            kind = "double" if f.type == "float" else "int"
            rows = rows.withColumns({f"m{n}_{end}": F.col(f"m{n}_{end}").cast(kind) for end in ("min", "max")})
        else:
            parsed = F.from_json(F.substr(F.col(f"m{n}"), F.lit(ARRIVAL_DIGITS + 1)), "array<struct<disp:string,min:int,max:int,num:double>>")
            rows = rows.withColumn(f"m{n}", F.struct(parsed.alias("values")))
    return shaped(rows, catalog)


class _Layout(NamedTuple):
    terms: int
    texts: tuple[str, ...]
    numbers: tuple[str, ...]

    def merged(self) -> list[str]:
        return [f"{c} string" for c in self.texts] + [f"{c}_{end} double" for c in self.numbers for end in ("min", "max")]

    def combined(self) -> str:
        """Records of one key with the same terms, combined; `arrivals` are those of members that lack a term."""
        tf = [f"t{i} double" for i in range(self.terms)]
        return ", ".join(["cluster string, hits bigint, members bigint, arrival bigint, arrivals array<bigint>", *tf, *self.merged()])

    def state(self) -> str:
        return ", ".join(["members bigint, first_arrival bigint, tf array<double>, first_hit array<bigint>, early array<bigint>", *self.merged()])

    def out(self) -> str:
        return f"cluster string, {self.state()}, added bigint, added_df array<bigint>"


def _combine(layout: _Layout):
    full = (1 << layout.terms) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            how = {"members": ("arrival", "size"), "least": ("arrival", "min")}
            how |= {f"t{i}": (f"t{i}", "sum") for i in range(layout.terms)}
            how |= {f"{c}_{end}": (f"{c}_{end}", end) for c in layout.numbers for end in ("min", "max")}
            grouped = batch.groupby(["cluster", "hits"], sort=False)
            rows = grouped.agg(**how).reset_index().rename(columns={"least": "arrival"})
            rows["arrivals"] = [sorted(a) if h != full else [] for h, a in zip(rows["hits"], grouped["arrival"].agg(list))]
            for c in layout.texts:
                rows[c] = list(grouped[c].agg(lambda s: min((x for x in s if isinstance(x, str)), default=None)))
            yield rows[[part.split(" ")[0] for part in layout.combined().split(", ")]]

    return run


class RankedClusters(StatefulProcessor):
    """Keeps the state of a key and emits it, with what it adds to the document frequency, whenever it changes."""

    def __init__(self, layout: _Layout) -> None:
        self.layout = layout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cluster", self.layout.state())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, texts, numbers = self.layout.terms, self.layout.texts, self.layout.numbers
        if self.state.exists():
            members, first, tf, hit, early, *rest = self.state.get()
            tf, hit, early, rest = list(tf), list(hit), list(early), list(rest)
        else:
            members, first, tf, hit, early = 0, None, [0.0] * n, [None] * n, [0] * n
            rest = [None] * (len(texts) + 2 * len(numbers))
        before = members, self._counted(members, hit, early)
        came = []
        for piece in rows:
            for row in piece.to_dict("records"):
                came.append((int(row["hits"]), int(row["members"]), int(row["arrival"]), row["arrivals"]))
                for i in range(n):
                    tf[i] += float(row[f"t{i}"])
                for k, c in enumerate(texts):
                    rest[k] = _least(rest[k], row[c] if isinstance(row[c], str) else None)
                for k, c in enumerate(numbers):
                    at = len(texts) + 2 * k
                    rest[at] = _least(rest[at], _number(row[f"{c}_min"]))
                    rest[at + 1] = _largest(rest[at + 1], _number(row[f"{c}_max"]))
        for i in range(n):
            if hit[i] is None:
                hits = [arrival for mask, _, arrival, _ in came if mask >> i & 1]
                lacking = [(count, arrivals) for mask, count, _, arrivals in came if not mask >> i & 1]
                if hits:
                    hit[i] = min(hits)
                    early[i] += sum(int(a < hit[i]) for _, arrivals in lacking for a in arrivals)
                else:
                    early[i] += sum(count for count, _ in lacking)
        members += sum(count for _, count, _, _ in came)
        first = min([arrival for _, _, arrival, _ in came] + ([] if first is None else [first]))
        row = (members, first, tf, hit, early, *rest)
        self.state.update(row)
        after = self._counted(members, hit, early)
        added = [a - b for a, b in zip(after, before[1])]
        names = ["cluster", *[part.split(" ")[0] for part in self.layout.state().split(", ")], "added", "added_df"]
        yield pd.DataFrame({name: pd.Series([value], dtype=object) for name, value in zip(names, (key[0], *row, members - before[0], added))})

    @staticmethod
    def _counted(members: int, hit: list, early: list) -> list[int]:
        return [0 if h is None else members - e for h, e in zip(hit, early)]

    def close(self) -> None:
        pass


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


def _least(a, b):
    return b if a is None else a if b is None else min(a, b)


def _largest(a, b):
    return b if a is None else a if b is None else max(a, b)


# -- running and reading -----------------------------------------------------------------------------------------------


def _layout(catalog: Catalog, terms: Sequence[Term]) -> _Layout:
    if not 0 < len(terms) <= MORE_TERMS:
        raise ValueError(f"1 to {MORE_TERMS} terms are needed")
    _, texts, numbers = _candidates(catalog)
    return _Layout(len(terms), tuple(texts), tuple(numbers))


def ranked_stream(
    records: DataFrame, catalog: Catalog, terms: Sequence[Term], weights: Mapping[str, str] | None = None, **how
) -> DataFrame:
    """Changed clusters of a stream of records with `cluster` and a bigint `arrival` of 0 or more; `how` as in `with_term_counts`. The
    session must have been made by `intake.stream_session`."""
    if dict(records.dtypes)["arrival"] != "bigint":
        raise ValueError("arrival must be a bigint here")
    layout, (columns, _, _) = _layout(catalog, terms), _candidates(catalog)
    counted = with_term_counts(records, catalog, list(terms), weights, **how)
    bits = [F.when(F.col("hit")[i], F.lit(1 << i)).otherwise(0).cast("bigint") for i in range(len(terms))]
    hits = bits[0]
    for bit in bits[1:]:
        hits = hits.bitwiseOR(bit)
    narrow = counted.select("cluster", hits.alias("hits"), "arrival", *[F.col("tf")[i].alias(f"t{i}") for i in range(len(terms))], *columns)
    combined = narrow.mapInPandas(_combine(layout), layout.combined())
    return combined.groupBy("cluster").transformWithStateInPandas(RankedClusters(layout), layout.out(), "Update", "None")


def write_ranked(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run `ranked_stream` into the tables `clusters` and `frequency` below `path`, both by batch; a repeated batch replaces itself."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/clusters/batch={batch}")
        spark = rows.sparkSession
        changed = spark.read.schema(rows.schema).parquet(f"{path}/clusters/batch={batch}")
        added = changed.select("added", F.posexplode_outer("added_df").alias("term", "df"))
        sums = added.groupBy("term").agg(F.sum("added").alias("n"), F.sum("df").alias("df"))
        if batch:
            sums = sums.unionByName(spark.read.schema(FREQUENCY).parquet(f"{path}/frequency/batch={batch - 1}"))
        total = sums.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{path}/frequency/batch={batch}")

    writer = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


#: One row per term: records so far, and those of them whose cluster had the term when they came.
FREQUENCY = "term int, n bigint, df bigint"


def running_frequency(spark: SparkSession, path: str, terms: Sequence[Term]) -> Frequency:
    """The newest document frequency."""
    rows = spark.read.schema(f"{FREQUENCY}, batch bigint").parquet(f"{path}/frequency")
    newest = rows.groupBy("term").agg(F.max_by(F.struct("n", "df"), "batch").alias("f")).select("term", "f.*").collect()
    df = {r["term"]: r["df"] for r in newest}
    return Frequency(newest[0]["n"] if newest else 0, tuple(df.get(i, 0) for i in range(len(terms))))


def running_ranks(spark: SparkSession, path: str, catalog: Catalog, terms: Sequence[Term], cluster: bool = True) -> DataFrame:
    """All clusters so far with their merged fields and `relevance`, as `rank` gives them."""
    layout = _layout(catalog, terms)
    schema = spark.createDataFrame([], layout.out()).schema
    rows = latest(spark, f"{path}/clusters", ["cluster"], schema).drop("added", "added_df", "early")
    clusters = _merged(rows.withColumn("recid", F.col("cluster")), catalog)
    return with_relevance(clusters, running_frequency(spark, path, terms), list(terms), cluster)
