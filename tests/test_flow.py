"""The whole intake in batches against the batch operators, stopping at a gate, expiry, and what each leaves of the session."""

import random

import pytest
from pyspark.sql import functions as F

from concord import Catalog, FieldSpec
from concord.operators import clusters as C, filters as FI, records as RE
from concord.sources.internal import parse_payloads
from concord.streaming import expiry as SE, flow as SF, intake as ST

CATALOG = Catalog((FieldSpec("title", mergekey="required"), FieldSpec("date", type="year"), FieldSpec("price", type="float")))
SCHEMA = "source string, position bigint, arrival bigint, payload string"
LIMITS = {"date": ["1990", "1991"]}


def payload(i):
    random.seed(i % 17)
    title, year, price = random.choice(["A b", "C", ""]), random.choice([1990, 1991, 1992, "?"]), random.choice([1, 2.5, "x"])
    inner = f'<metadata type="title">{title}</metadata><metadata type="date">{year}</metadata><metadata type="price">{price}</metadata><metadata type="odd">z</metadata>'
    if i % 11 == 5:
        return "<record>" + inner
    if i % 13 == 7:
        return f"<cluster><record>{inner}</record><record>{inner}</record></cluster>"
    return None if i == 3 else f"<record>{inner}</record>" if i % 9 else "<other/>"


ROWS = [(f"s{i % 3}", i, i, payload(i)) for i in range(120)]


def batch_chain(payloads):
    """The operators one after the other."""
    parsed = parse_payloads(payloads)
    subs = parsed.select("source", "position", "arrival", F.posexplode_outer("subrecords").alias("sub", "r")).filter("r IS NOT NULL")
    raw = subs.select("source", "position", F.struct("arrival", "sub").alias("arrival"), F.col("r.values").alias("values"), F.col("r.key").alias("supplied"))
    records = C.with_merge_key(RE.type_values(RE.conform(raw, CATALOG), CATALOG), CATALOG, supplied="supplied")
    kept = C.drop_exact_duplicates(FI.limit_records(records, CATALOG, LIMITS), CATALOG)
    return kept, RE.unknown_fields(raw, CATALOG), parsed.filter("failure IS NOT NULL").select("arrival")


@pytest.mark.parametrize("cuts", [[0, 40, 80, 120], [0, 120]])
def test_batches_equal_the_batch_chain(spark, tmp_path, cuts):
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for low, high in zip(cuts, cuts[1:]):
        spark.createDataFrame(ROWS[low:high], SCHEMA).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        SF.run_intake(stream, CATALOG, path, checkpoint, LIMITS).awaitTermination()
    whole = spark.createDataFrame(ROWS, SCHEMA)
    rows = SF.taken(spark, path, SF.prepared(whole, CATALOG, LIMITS))
    kept, unknown, rejected = batch_chain(whole)
    of = lambda frame: sorted(map(repr, frame.select("source", "position", "arrival.arrival", "cluster", "md").collect()))
    assert of(rows.filter("outcome = 'kept'")) == of(kept)
    assert sorted(map(tuple, SF.intake_unknown(rows).collect())) == sorted(map(tuple, unknown.collect()))
    assert sorted(r[0] for r in rows.filter("outcome = 'rejected'").select("arrival.arrival").collect()) == sorted(r[0] for r in rejected.collect())
    status = SF.intake_status(rows).agg(*[F.sum(o).alias(o) for o in ("records", *SF.OUTCOMES)]).first()
    assert status["records"] == sum(status[o] for o in SF.OUTCOMES) and all(status[o] for o in SF.OUTCOMES)
    # a repeated batch changes nothing, and the whole table at once gives the same
    before = of(rows)
    SF.write_batch(SF.prepared(spark.createDataFrame(ROWS[cuts[-2] :], SCHEMA), CATALOG, LIMITS), len(cuts) - 2, path)
    again = SF.taken(spark, path, SF.prepared(whole, CATALOG, LIMITS))
    assert of(again) == before and of(SF.take(whole, CATALOG, LIMITS).filter("outcome = 'kept'")) == of(kept)


def test_intake_of_nothing(spark):
    assert SF.take(spark.createDataFrame([], SCHEMA), CATALOG, LIMITS).count() == 0


def test_a_gate_stops_the_run_and_keeps_its_batches(spark, tmp_path):
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for k in range(5):
        spark.createDataFrame([(10 * k + i,) for i in range(10)], "n bigint").coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema("n bigint").option("maxFilesPerTrigger", "1").parquet(folder)
    read = lambda: spark.read.schema("n bigint, batch bigint").parquet(path)

    def write(rows, batch):
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    gate = lambda own, batch: own.read.parquet(path).count() >= 20
    assert ST.run_until(stream(), write, gate, checkpoint) == 1
    assert sorted(r["n"] for r in read().collect()) == list(range(20))
    # the next run goes on behind the finished batches, and without a gate comes to the end
    assert ST.run_until(stream(), write, lambda own, batch: False, checkpoint) is None
    assert sorted(r["n"] for r in read().collect()) == list(range(50))
    with pytest.raises(Exception, match="lost"):
        ST.run_until(stream(), write, lambda own, batch: (_ for _ in ()).throw(ValueError("lost")), str(tmp_path / "other"))


def test_lives_end_by_event_time(spark, tmp_path):
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "cluster string, at timestamp, num double"
    rows = [[("a", 0, 1.0), ("a", 50, 9.0), ("b", 10, 2.0)], [("a", 120, 4.0), ("b", 300, 5.0)], [("a", 600, 7.0), ("c", 500, 1.0), ("c", 400, 3.0)]]
    own = ST.stream_session(spark)
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    for part in rows:
        frame = spark.createDataFrame(part, "cluster string, s bigint, num double")
        frame.select("cluster", F.timestamp_seconds(F.col("s") + 10_000).alias("at"), "num").write.mode("append").parquet(folder)
        stream = own.readStream.schema(schema).parquet(folder)
        ST.write_updates(SE.stream_expiring_clusters(stream, 100_000), path, checkpoint).awaitTermination()
    found = ST.latest(spark, path, ["cluster", "start"], spark.createDataFrame([], SE.LIFE).schema).collect()
    got = sorted((r["cluster"], r["start"] // 1000 - 10_000, r["stop"] // 1000 - 10_000, r["members"], r["low"], r["high"], r["expired"]) for r in found)
    assert got == [
        ("a", 0, 120, 3, 1.0, 9.0, True), ("a", 600, 600, 1, 7.0, 7.0, False), ("b", 10, 10, 1, 2.0, 2.0, True),
        ("b", 300, 300, 1, 5.0, 5.0, True), ("c", 400, 500, 2, 1.0, 3.0, True),
    ]
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == before
