"""Payloads that are written plainly against the parser, and how often payloads are parsed."""

import random

import pytest
from pyspark.sql import functions as F

from concord.sources import internal as I

TEXTS = ["cold gear", "x", "", " ", " left", "right ", "a]]>b", "]]", "1.0", "null", "café ü", " ", " x", "中文", 'say "hi" rank="9"', "it's", "a=b", "a/", "/",
         "\u0085", "tab\there", "line\nbreak", "a &amp; b", "a & b", "&#65;", "a > b", "a<b/>c", "<!-- c -->", "<![CDATA[x]]>", "<?p i?>", "x" * 9000, "\\", "${1}", " ", "\U0001f600"]
VALUES = ["3", "nobody", "", " ", " 3", "a b", "a=b", 'rank=', "a>b", "a&lt;b", "it's", "a\tb", "é", " ", "/", "y" * 1200]


def element(rng, odd):
    text = lambda: rng.choice(TEXTS) if rng.random() < odd else rng.choice(["cold gear", "STANDARD", "1998", "25.0"])
    value = lambda: rng.choice(VALUES) if rng.random() < odd else rng.choice(["3", "nobody"])
    field = rng.choice(VALUES) if rng.random() < odd else rng.choice(["title", "medium", "date", "author"])
    names = [n for n in ("empty", "rank") if rng.random() < 0.3]
    if rng.random() < odd:
        names = rng.choice([["rank", "empty"], ["other"], ["rank", "rank"], ["type"], ["xml:lang"], ["mergekey"]])
    head = f'metadata type="{field}"' if rng.random() > odd / 4 else rng.choice(["metadata", f"metadata type='{field}'", f'metadata  type="{field}"', f'meta type="{field}"'])
    head += "".join(f' {n}="{value()}"' for n in names)
    return f"<{head}/>" if rng.random() < 0.2 else f"<{head}>{text()}</{'metadata' if head.startswith('metadata') else 'meta'}>"


def payload(rng):
    odd = rng.choice([0, 0, 0.05, 0.3])
    gap = rng.choice([" ", "\n"]) if rng.random() < odd / 3 else ""
    head = "<record>" if rng.random() > odd / 2 else rng.choice(["<record >", '<record mergekey="k 1">', "<thing>"])
    end = "</thing>" if head == "<thing>" else "</record>"
    one = lambda: head + gap.join(element(rng, odd) for _ in range(rng.randrange(1 - (rng.random() < odd), 5))) + end
    if rng.random() < 0.3:
        whole = one()
    else:
        opened, closed = rng.choice([("cluster", "cluster")] + [('pz:cluster xmlns:pz="urn:x"', "pz:cluster")] * 2)
        if rng.random() < odd / 2:
            opened, closed = rng.choice(
                [("pz:cluster", "pz:cluster"), ('pz:cluster xmlns:q="urn:x"', "pz:cluster"), ('a:cluster xmlns:a="urn:x"', "b:cluster"), ('cluster xmlns="urn:x"', "cluster"),
                 ('xml:cluster xmlns:xml="urn:x"', "xml:cluster"), ("clusters", "clusters"), ('p:cluster xmlns:p="http://www.w3.org/2000/xmlns/"', "p:cluster"), ('p:cluster xmlns:p=""', "p:cluster")]
            )
        whole = f"<{opened}>{gap.join(one() for _ in range(rng.randrange(1 - (rng.random() < odd), 5)))}</{closed}>"
    if rng.random() < odd / 2:
        whole = rng.choice([whole[:-5], whole + "\n", " " + whole, '<?xml version="1.0"?>' + whole, whole + whole, whole.replace("</metadata>", "", 1), whole + "<", f"<other>{whole}</other>", whole.replace("type", "TYPE")])
    return whole


@pytest.mark.parametrize("attributes", [("rank",), ("rank", "other"), ()])
def test_plain_payloads_are_read_as_the_parser_reads_them(spark, monkeypatch, attributes):
    rng = random.Random(5)
    # every odd text and value stands in an otherwise plain payload, and all of them in random ones
    whole = [f'<record><metadata type="t">{x}</metadata></record>' for x in TEXTS]
    whole += [f'<record><metadata type="{x}" rank="{x}">v</metadata><metadata type="t" empty="{x}"/></record>' for x in VALUES]
    whole += [payload(rng) for _ in range(4000)] + [None, "", "<record/>", "<cluster><record/></cluster>", "<cluster/>"]
    frame = spark.createDataFrame(list(enumerate(whole)), "n int, payload string")
    plain = frame.filter(F.col("payload").rlike(I._plain_pattern(attributes))).count()
    assert len(whole) / 8 < plain < len(whole) * 0.9
    run = lambda: I.parse_payloads(frame, attributes=attributes).orderBy("n")
    found = run()
    got = found.collect()
    monkeypatch.setattr(I, "_plain_pattern", lambda _: "(?!)")
    parsed = run()
    want = parsed.collect()
    assert found.dtypes == parsed.dtypes
    for g, w in zip(got, want, strict=True):
        assert g == w, g["payload"][:300]


def test_long_payloads_take_no_stack(spark):
    one = '<record><metadata type="title">red gear</metadata><metadata type="author" empty="nobody"/></record>'
    rows = [(n, f"<cluster>{one * n}</cluster>") for n in (1, 2000, 4900, 6000)]
    parsed = I.parse_payloads(spark.createDataFrame(rows, "n int, payload string"))
    assert [tuple(r) for r in parsed.select("n", F.size("subrecords")).orderBy("n").collect()] == [(n, n) for n, _ in rows]


@pytest.mark.parametrize("slice_bytes", [1, 1 << 30])
def test_payloads_of_a_query_are_parsed_once(spark, tmp_path, monkeypatch, slice_bytes):
    from concord.operators import clusters as C
    from concord.plans import formats as FO, views

    monkeypatch.setattr(views, "SLICE_BYTES", slice_bytes)
    spark.createDataFrame(
        [(o, n, 1 + (o + n) % 3, 1, float(n), 1.0) for o in range(1, 100) for n in range(3)],
        "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double",
    ).withColumn("l_shipdate", F.lit("1998-01-02").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(1, "red gear", "B", "LARGE"), (2, "a & b", "B", "SMALL"), (3, None, "B", "SMALL")]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "s")], "s_suppkey bigint, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    plans = []
    assign = C.assign_clusters
    monkeypatch.setattr(C, "assign_clusters", lambda rows, *a: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or assign(rows, *a))
    got = FO.cluster_payloads(spark, str(tmp_path)).collect()
    # links and clusters are both made of what comes here
    assert len(plans) == 1 and "from_xml" not in plans[0] and "Join" not in plans[0]
    orders = [o for o in range(1, 100) if o % 97 and o % 89]
    names = {1: "content: title red gear medium large", 2: "content: title a b medium small"}
    want = []
    for o in orders:
        keys = [names.get(1 + (o + n) % 3, f"position: orders {o % 10}-{o:06}") for n in range(3)]
        want += [(o, sub, min(names.values()), len(set(keys))) for sub in range(3)]
    assert sorted(map(tuple, got)) == sorted(want)
