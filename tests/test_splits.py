"""Records of files that are read in parts, broken records, and the log per file."""

from pyspark.sql import functions as F

from concord.sources import internal as I, marc as MA, splits as SP
from concord.streaming import intake as ST

HEAD = '<?xml version="1.0"?>\n<collection xmlns:p="urn:x">\n  '
RECORD = '<record a="1">\n<metadata type="title">{}</metadata>\n</record>'


def payloads(frame):
    return sorted(r["payload"] for r in frame.collect())


def test_records_between_heads_tails_and_broken_ones(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = [RECORD.format(f"t{i}") for i in range(4)]
    text = HEAD + good[0] + "\n<records/><recordings>no</recordings>" + "<record><metadata>lost" + good[1] + "<record/>\n"
    text += good[2] + '<record b="2"/>' + "</collection>\n\n"
    (folder / "a.xml").write_text(text)
    (folder / "b.xml").write_text(HEAD + good[3] + '<record><metadata type="title">cut o')
    (folder / "c.xml").write_text("")
    (folder / "d.xml").write_text(HEAD + "</collection>")
    wanted = [*good, "<record><metadata>lost", "<record/>", '<record b="2"/>', '<record><metadata type="title">cut o</record>']
    assert payloads(SP.split_records(spark, str(folder))) == sorted(wanted)
    rows = I.read_records(spark, str(folder))
    log = {r["f"]: tuple(r)[1:] for r in rows.groupBy(F.substring_index("file", "/", -1).alias("f")).agg(
        F.count_if(F.col("failure").isNull()), F.count_if(F.col("failure").isNotNull())).collect()}
    assert log == {"a.xml": (5, 1), "b.xml": (1, 1)}
    titles = I.first_values(rows).select(F.explode("values.value")).collect()
    assert sorted(t[0] for t in titles) == ["t0", "t1", "t2", "t3"]


def test_tags_with_prefix_and_inner_records(spark, tmp_path):
    body = "<p:cluster>" + RECORD.format("a") * 2 + "</p:cluster>\n<p:cluster>" + RECORD.format("b") + "</p:cluster>"
    (tmp_path / "x.xml").write_text(f"<all>{body}</all>")
    rows = I.read_records(spark, str(tmp_path), "p:cluster")
    assert sorted(len(r["subrecords"]) for r in rows.collect()) == [1, 2]


def test_one_file_is_converted_by_several_tasks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    n = 6000
    broken = {k for k in range(n) if k % 500 == 3}
    parts = [RECORD.format(f"title {k}")[: 30 if k in broken else None] for k in range(n)]
    (folder / "big.xml").write_text(HEAD + "\n".join(parts) + "</collection>")
    (folder / "small.xml").write_text(HEAD + RECORD.format("alone") + "</collection>")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        tasks = lambda rows: I.parse_payloads(rows).withColumn("task", F.spark_partition_id())
        done = SP.convert_records(spark, str(folder), str(tmp_path / "out"), tasks)
        log = {r["file"].rsplit("/", 1)[1]: r for r in done.log.collect()}
        assert done.documents.filter("file LIKE '%big.xml'").select("task").distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert (log["big.xml"]["documents"], log["big.xml"]["failures"]) == (n - len(broken), len(broken))
    assert log["big.xml"]["blocks"] > 4 and log["small.xml"]["blocks"] == 1 and log["small.xml"]["documents"] == 1
    titles = done.documents.select(F.explode("subrecords").alias("r")).select(F.explode("r.values.value").alias("t"))
    assert titles.distinct().count() == n - len(broken) + 1
    assert all(r["payload"].startswith("<record") for r in done.failures.collect())


def test_marc_files_and_streams_of_files(spark, tmp_path):
    record = '<record><leader>00000cam</leader><controlfield tag="001">7</controlfield><datafield tag="245"><subfield code="a">T</subfield></datafield></record>'
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.xml").write_text(f"<collection>\n{record}\n{record[:-40]}\n</collection>")
    rows = MA.read_marcxml(spark, str(tmp_path / "m")).collect()
    assert sorted((r["leader"], r["failure"]) for r in rows if r["failure"] is None) == [("00000cam", None)]
    assert sum(r["failure"] == "ingest" for r in rows) == 1
    (tmp_path / "s").mkdir()
    for k in range(3):
        (tmp_path / "s" / f"{k}.xml").write_text(HEAD + "".join(RECORD.format(f"s{k}{i}") for i in range(k + 1)) + "<record><metadata>")
    stream = ST.stream_records(spark, str(tmp_path / "s"), per_trigger=1)
    path = ST.run_to_table(stream.select("file", "block", "failure"), "records", "append")
    found = spark.read.parquet(path)
    assert found.select("batch").distinct().count() == 3
    assert (found.filter("failure IS NULL").count(), found.filter("failure IS NOT NULL").count()) == (6, 3)
