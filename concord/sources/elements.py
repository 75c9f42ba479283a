"""Children of the root of small XML records, by a streaming parser with a stack, for records whose elements aren't known before."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

PART = T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType())])
ELEMENT = T.StructType([*PART.fields, T.StructField("parts", T.ArrayType(PART))])
_ARROW_PART = pa.struct([("name", pa.string()), ("text", pa.string())])
_ARROW = pa.list_(pa.struct([("name", pa.string()), ("text", pa.string()), ("parts", pa.list_(_ARROW_PART))]))


def _local(name: str) -> str:
    return name.rsplit(":", 1)[-1]


def children(xml: str | None) -> tuple[str, list[dict]] | None:
    """Local name of the root, and its child elements in order: name, the text in them at any depth, and the same of their own
    children. None if the text isn't well-formed XML."""
    root: list[str] = []
    found: list[dict] = []
    texts: list[list[str]] = []  # of the open child of the root, and of its open child
    depth = 0

    def start(name: str, _: dict) -> None:
        nonlocal depth
        if depth == 0:
            root.append(_local(name))
        elif depth == 1:
            found.append({"name": _local(name), "text": "", "parts": []})
            texts.append([])
        elif depth == 2:
            found[-1]["parts"].append({"name": _local(name), "text": ""})
            texts.append([])
        depth += 1

    def end(_: str) -> None:
        nonlocal depth
        depth -= 1
        if depth == 2:
            found[-1]["parts"][-1]["text"] = "".join(texts.pop())
        elif depth == 1:
            found[-1]["text"] = "".join(texts.pop())

    def data(text: str) -> None:
        for open_text in texts:
            open_text.append(text)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        parser.Parse("" if xml is None else xml, True)
    except (expat.ExpatError, UnicodeEncodeError):
        return None
    return root[0], found


def with_children(records: DataFrame, column: str = "payload") -> DataFrame:
    """`records` with `root` and `elements` (`array<ELEMENT>`) of the XML in a column; both null where it isn't well-formed. CDATA is
    text, comments are nothing, prefixes are left off. Columns of these names are replaced."""
    rows = records.drop("root", "elements")
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [children(x) for x in batch.column(at).to_pylist()]
            roots = pa.array([r and r[0] for r in read], pa.string())
            elements = pa.array([r and r[1] for r in read], _ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, roots, elements], [*batch.schema.names, "root", "elements"])

    schema = T.StructType([*rows.schema.fields, T.StructField("root", T.StringType()), T.StructField("elements", T.ArrayType(ELEMENT))])
    return rows.mapInArrow(run, schema)
