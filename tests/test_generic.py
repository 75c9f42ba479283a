"""Generic and element-per-tag records: nested elements of one name, empty ones, CDATA, comments, prefixes, broken payloads."""

from concord.sources.formats import map_generic
from concord.sources.marc import marc_rows, parse_turbomarc


def test_broken_records_fail(spark):
    rows = [
        "<record><title>a</title><x>1</x></record>",
        "<record><date>1</date><title>unclosed</record>",
        "text",
        "<other/>",
        "<record/>",
        None,
        "",
    ]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, payload string")
    got = {r["id"]: (r["failure"], len(r["values"] or [])) for r in map_generic(frame).collect()}
    assert [f for _, (f, _) in sorted(got.items())] == [None, "ingest", "ingest", "ingest", None, "ingest", "ingest"]
    assert got[0][1] > 0 and got[1][1] == 0


def test_generic_records_are_read_as_trees(spark):
    payload = """<?xml version="1.0"?><!-- <record> --><record xmlns:p="urn:x"><author><author>in</author>tail</author><empty/><e2></e2>
      <p:colour>red <b>and <b>dark</b></b> blue</p:colour><note><![CDATA[a < b & <c>]]></note><note>x &lt;y&gt; &#233;</note>
      <affiliation><person>P</person><institution>I <institution>in it</institution></institution></affiliation>
      <affiliation><person/></affiliation><!-- <note>no</note> --></record>"""
    frame = spark.createDataFrame([(payload, "kept", "old")], "payload string, other string, root string")
    row = map_generic(frame).first()
    values = [(v["field"], v["value"]) for v in row["values"]]
    assert row["other"] == "kept" and row["failure"] is None
    assert values == [
        ("author", "intail"), ("colour", "red and dark blue"), ("note", "a < b & <c>"), ("note", "x <y> é"),
        ("affiliation-person", "P"), ("affiliation-institution", "I in it"), ("affiliation-person", None), ("affiliation-institution", None),
    ]


def test_element_per_tag_records_with_cdata_comments_and_prefixes(spark):
    payload = """<t:r xmlns:t="urn:t"><!-- <t:d245><t:sa>no</t:sa></t:d245> --><t:l>00000cam</t:l><t:c001>7</t:c001 >
      <t:d245 i1="1"><t:sa><![CDATA[a <sb>b</sb> <!-- c --> & d]]></t:sa><t:sb>x &lt;sa&gt;</t:sb ><t:sc/></t:d245><t:d500/></t:r>"""
    plain = "<r><l>00000cam</l><c001>8</c001><d245 i1='1'><sa>plain</sa></d245></r>"
    frame = spark.createDataFrame([(1, payload), (2, plain), (3, "<r><l>"), (4, None)], "id int, payload string")
    rows = parse_turbomarc(frame)
    assert [r["failure"] for r in rows.orderBy("id").collect()] == [None, None, "ingest", "ingest"]
    found = [tuple(r) for r in marc_rows(rows, "id").select("id", "tag", "value", "code", "sub_value").collect()]
    assert [f for f in found if f[0] == 1 and (f[2] or f[4])] == [
        (1, "001", "7", None, None), (1, "245", None, "a", "a <sb>b</sb> <!-- c --> & d"), (1, "245", None, "b", "x <sa>")
    ]
    assert [f for f in found if f[0] == 2] == [(2, "001", "8", None, None), (2, "245", None, "a", "plain")]
