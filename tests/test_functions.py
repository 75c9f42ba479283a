import pytest
from pyspark.sql import functions as F

from concord.functions import chains as CH, text as X, values as V
from concord.sources.marc import parse_citation


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,wanted",
    [
        (" how are you. : ", "how are you"),
        ("a,", "a"),
        (",,,", ","),
        (" ", ""),
        ("http://x/", "http://x/"),
        ("x ([", "x"),
        ("\té ", "é"),
    ],
)
def test_trim(spark, text, wanted):
    assert one(spark, X.trim_generic(F.lit(text))) == wanted


def test_trim_suffix(spark):
    assert one(spark, X.trim_suffix(F.lit(" how are you; "), "/; ")) == "how are you"


def test_key_forms(spark):
    assert one(spark, X.key_norm(F.lit(" The Art, Of  Computer 2! "))) == "the art of computer 2"
    assert one(spark, X.az_tokens(F.lit("Ünder 3 Büchern K"))) == ["nder", "b", "chern", "k"]
    # the Kelvin sign lowers to k but is no ASCII letter
    assert one(spark, X.az_joined(F.lit("aKb"))) == "a b"


@pytest.mark.parametrize("text,wanted", [("The art", " art"), ("an", ""), ("he came", "he came"), ("Theory", "Theory"), ("A B", " B")])
def test_skip_article(spark, text, wanted):
    assert one(spark, X.skip_article(F.lit(text))) == wanted


def test_sort_string(spark):
    assert one(spark, X.sort_string(F.lit("12. The 3 Men"))) == "the 3 men"
    assert one(spark, X.sort_string(F.lit("12."))) is None


def test_years_and_dates(spark):
    assert tuple(one(spark, V.years(F.lit("c1980-2001, 12345, 99")))) == (1980, 2001)
    assert one(spark, V.years(F.lit("none 123"))) is None
    assert tuple(one(spark, V.dates(F.lit("1980 20010203 123456789")))) == (19800000, 20010203)


def test_numbers(spark):
    assert one(spark, V.to_float(F.lit(" 2.5e1x"))) == 25.0
    assert one(spark, V.to_float(F.lit("x2"))) == 0.0
    assert one(spark, V.leading_int(F.lit("1976-1978"))) == 1976
    assert one(spark, V.leading_int(F.lit("x"))) == 0
    assert one(spark, V.print_range(F.lit(1973), F.lit(1980))) == "1973-1980"
    assert one(spark, V.print_float(F.lit(2.304635))) == "2.304635"


@pytest.mark.parametrize("position,wanted", [(1, 1993510496), (2, 1482143625), (4, 459409883)])
def test_checksum_golden(spark, position, wanted):
    assert one(spark, V.checksum(F.lit("localhost:9999"), F.lit(position))) == wanted


def test_checksum_bytes(spark):
    h = 7
    for b in "é/1".encode():
        h = (h * 65509 + b) % 2**32
    assert one(spark, V.checksum(F.lit("é/1"), F.lit(7))) == h
    assert one(spark, V.checksum(F.lit(""), F.lit(7))) == 7


def test_snippet(spark):
    text = "The use of passwords for access to computer resources & more"
    marked = one(spark, X.snippet(F.lit(text), ["computer", "resources", "amp"]))
    assert marked == "The use of passwords for access to<match> computer resources</match> &amp; more"
    assert one(spark, X.snippet(F.lit("Internet (Computer network)"), ["computer"])) == "Internet<match> (Computer</match> network)"
    assert one(spark, X.snippet(F.lit("nothing"), ["computer"])) is None
    long = "spam " * 50000
    assert one(spark, X.snippet(F.lit(long), ["spam"])) == "<match>" + long.rstrip() + "</match> "


def test_chains(spark):
    text = F.lit("The Well-Known  Book, vol2!")
    assert one(spark, CH.WORDS.tokens(text)) == ["the", "well", "known", "book", "vol2"]
    assert one(spark, CH.WORDS.joined(text)) == "the well known book vol2"
    assert one(spark, CH.TITLE_FACET.joined(F.lit("jack collins"))) == "Jack Collins"
    assert one(spark, CH.TITLE_FACET.display(F.lit("jack collins"))) == "jack collins"
    assert one(spark, CH.TRIMMED_FACET.joined(F.lit("Adams, J., !"))) == "Adams, J"
    plural = CH.TextChain((CH.TOKENIZE, CH.remove_space_punct, CH.lower, lambda t: F.regexp_replace(t, "s$", "")))
    assert one(spark, plural.joined(F.lit("Two Books"))) == "two book"


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("Vol. 3, issue 2, p 12-18", ("3,", "2", "12-18")),
        ("Vol. 3 no 4, issue 2", ("3", "", "")),
        ("v 7 issue 1,p3", ("7", "1", "3")),
        ("vol ", ("", "", "")),
        ("pages", ("", "", "")),
    ],
)
def test_citation(spark, text, wanted):
    assert tuple(one(spark, parse_citation(F.lit(text)))) == wanted
