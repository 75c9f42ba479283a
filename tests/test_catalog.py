import pytest

from concord import Catalog, FieldSpec
from concord.catalog import parse_weight


def test_year_is_always_a_range():
    assert FieldSpec("date", type="year").merge == "range"


@pytest.mark.parametrize(
    "options",
    [
        {"type": "text"},
        {"merge": "some"},
        {"mergekey": "yes"},
        {"setting": "yes"},
        {"sortkey": "yes"},
        {"sortkey": "text"},
        {"type": "float", "merge": "range", "sortkey": "skiparticle"},
        {"type": "float", "merge": "longest"},
        {"merge": "range"},
        {"rank": "x"},
    ],
)
def test_bad_options(options):
    with pytest.raises(ValueError):
        FieldSpec("f", **options)


def test_catalog_checks():
    with pytest.raises(ValueError):
        Catalog((FieldSpec("a"), FieldSpec("a")))
    with pytest.raises(ValueError):
        Catalog((FieldSpec("a", limitcluster="b"),))
    with pytest.raises(ValueError):
        Catalog((FieldSpec("a"),), rank_length="square")


def test_weights():
    assert parse_weight("6") == 6
    assert parse_weight("2 au 9", "au") == 9
    assert parse_weight("2 au 9", "ti") == 2
    assert parse_weight("2 au 9") == 2
