"""English stems by published examples, and as the last step of a chain."""

import pytest
from pyspark.sql import functions as F

from concord import Catalog, FieldSpec
from concord.functions.chains import ENGLISH, STEM, TextChain
from concord.functions.stemming import stem
from concord.operators.clusters import with_merge_key
from concord.operators.records import table_records

# examples that the authors of the algorithm publish with it
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistently consist
consolation consol consolatory consolatori console consol consonant conson conspicuous conspicu conspiracy conspiraci
constable constabl constancy constanc constant constant knack knack knackeries knackeri knacks knack knavish knavish kneaded knead
kneel kneel knew knew knightly knight knits knit knives knive knocked knock knocker knocker knuckle knuckl generate generat
generally general generous generous hopping hop hoping hope falling fall cries cri ties tie cry cri by by say say gas gas this this
gaps gap kiwis kiwi luxuriating luxuri rational ration relational relat conditional condit sensibility sensibl skies sky dying die
news news outing outing proceed proceed agreed agre feed feed plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size tanned tan filing file happy happi sky sky relate relat controll control roll roll a a is is""".split()


def test_published_examples():
    assert {w: stem(w) for w in PAIRS[::2]} == dict(zip(PAIRS[::2], PAIRS[1::2]))


def test_chain_with_stems(spark):
    texts = [("Consigned, the SHIPS' hopping!",), (None,), ("",), ("é relational-data",), ("x " * 20_000,)]
    frame = spark.createDataFrame(texts, "t string")
    rows = frame.select(ENGLISH.tokens(F.col("t")).alias("tokens"), ENGLISH.joined(F.col("t")).alias("joined")).collect()
    assert [r["tokens"] for r in rows][:4] == [["consign", "the", "ship", "hop"], None, [], ["é", "relat", "data"]]
    assert rows[4]["joined"] == " ".join(["x"] * 20_000)
    with pytest.raises(ValueError):
        TextChain((STEM, F.lower))


def test_stemmed_merge_keys(spark):
    catalog = Catalog((FieldSpec("title", mergekey="required"), FieldSpec("medium", mergekey="optional")), chains={"mergekey": ENGLISH})
    rows = [(1, "Connected ships", "Books"), (2, "connection ship", "book"), (3, "Ship connecting", None), (4, None, "book"), (5, "connect, SHIP", "booked")]
    table = spark.createDataFrame(rows, "id int, title string, medium string")
    records = table_records(table, catalog, {"title": "title", "medium": "medium"}, "'s'", "id", "id")
    found = {r["arrival"]: r["cluster"] for r in with_merge_key(records, catalog).collect()}
    assert found[1] == found[2] == found[5] == "content: title connect ship medium book"
    assert found[3] == "content: title ship connect" and found[4] == "position: s-000004"
