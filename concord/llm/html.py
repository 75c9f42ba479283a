"""Main text of web pages by two passes of block rules over the whole page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from concord.llm.common import slices

# fixed values: frequent function words of the languages that are told apart
STOP_WORDS = {
    "en": "the of and to a in is that it was for on are as with his they at be this from have or by one had not but what "
    "all were we when your can there an which their if will each about".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur la les des est une "
    "avec plus sont cette ou mais nous".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "dass sie nach wird bei einer um am sind".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque "
    "esta entre cuando muy sin sobre".split(),
}

# fixed values: elements by what they mean for their content
DROPPED = frozenset("script style noscript template iframe svg canvas object title textarea select button".split())
#: Elements around a page or its article, whose class words say nothing about what is in them.
WHOLE = frozenset("html head body main article".split())
ASIDE = frozenset("nav aside footer form menu dialog".split())
MAIN = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img".split()
)
#: Elements whose end tag may be left out, and what starts end them; a paragraph is ended by every element that isn't inline.
ENDED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset("dt dd".split()),
    "dd": frozenset("dt dd".split()),
    "option": frozenset(["option"]),
    "tr": frozenset("tr thead tbody tfoot".split()),
    "td": frozenset("td th tr thead tbody tfoot".split()),
    "th": frozenset("td th tr thead tbody tfoot".split()),
    "thead": frozenset("tbody tfoot".split()),
    "tbody": frozenset("tbody tfoot".split()),
    "tfoot": frozenset(["tbody"]),
}
#: Words in class, id or role of an element that is not part of the article.
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|menu|modal|nav|navbar|"
    r"navigation|newsletter|notice|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|"
    r"subscribe|widget)(?:$|[\s_-])",
    re.I,
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: End of the attributes of an empty element: a slash that isn't part of an unquoted value.
_EMPTY = re.compile(r"(?:^|[\s\"'])/\Z")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


class Limits(NamedTuple):
    """Bounds of the rules: characters of a short and a long block, densities of stop words and of link text."""

    short: int = 70
    long: int = 200
    few_stops: float = 0.15
    many_stops: float = 0.30
    links: float = 0.33


class Block(NamedTuple):
    text: str
    link_chars: int
    heading: bool
    aside: bool
    #: Number of the article or main element around it, 0 for none.
    main: int


def blocks(page: str) -> tuple[list[Block], str | None]:
    """The text blocks of a page, and the language that its `html` tag names, wherever the tag is. Inline elements
    and line breaks stay inside a block, every other tag ends it."""
    found: list[Block] = []
    language: str | None = None
    pieces: list[str] = []
    stack: list[tuple[str, bool, int, bool]] = []  # open elements: name, aside, main, heading
    outer = ("", False, 0, False)
    aside, main, mains = False, 0, 0
    heading = in_link = False
    link_chars = 0
    at, end = 0, len(page)

    def close() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                found.append(Block(text, min(link_chars, len(text)), heading, aside, main))
        link_chars = 0

    while at < end:
        tag = _TOKEN.search(page, at)
        stop = tag.start() if tag else end
        if stop > at:
            piece = page[at:stop]
            pieces.append(piece)
            if in_link:
                link_chars += len(piece.strip())
        if not tag:
            break
        at = tag.end()
        name = tag[2] or tag[5]
        if name is None:  # comment or declaration
            continue
        name, closing, attributes = name.lower(), (tag[1] or tag[4]) == "/", tag[3] or tag[6] or ""
        if name in INLINE:
            if name == "a":
                in_link = not closing
            elif name == "br":
                pieces.append(" ")
            of_aside = stack and stack[-1][0] == name if closing else attributes and _is_aside(attributes)
            if not of_aside:
                continue
        close()
        if name == "html" and language is None and (named := _LANGUAGE.search(attributes)):
            language = named[1].lower()
        if name in DROPPED:
            # of these only an svg can be empty, a slash in others means nothing
            if not closing and not (name == "svg" and _EMPTY.search(attributes)):
                after = re.compile(rf"</{re.escape(name)}\b[^>]*>|\Z", re.I).search(page, at)
                at = after.end()
            continue
        in_link = in_link and name != "body"
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            _, aside, main, heading = stack[-1] if stack else outer
            continue
        if name not in INLINE:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] in INLINE:
                k -= 1
            if k >= 0 and (stack[k][0] == "p" or name in ENDED_BY.get(stack[k][0], ())):
                del stack[k:]
                _, aside, main, heading = stack[-1] if stack else outer
        if name not in VOID:
            if name in MAIN:
                mains += 1
                main = mains
            outside = name in ASIDE or name == "header" and not main
            aside = aside or outside or bool(attributes) and name not in WHOLE and _is_aside(attributes)
            heading = heading or name in HEADING
            stack.append((name, aside, main, heading))
    close()
    return found, language


def _is_aside(attributes: str) -> bool:
    if _HIDDEN.search(attributes):
        return True
    return any(ASIDE_WORDS.search(a or b or c or "") for a, b, c in _MARKS.findall(attributes))


_EVERY_STOP = frozenset(w for words in STOP_WORDS.values() for w in words)
_BY_LANGUAGE = {lang: frozenset(words) for lang, words in STOP_WORDS.items()}
_LANGUAGE = re.compile(r"\blang\s*=\s*[\"']?([a-zA-Z]{2})", re.I)
_EDGES = ".,;:!?()[]{}\"'«»„“”‚‘’…–—|"


def first_pass(block: Block, stops: frozenset[str], limits: Limits) -> str:
    """`good`, `bad`, or undecided: `near` (much like good text) or `short`."""
    size = len(block.text)
    if block.aside or block.link_chars > limits.links * size:
        return "bad"
    if block.heading or size < limits.short:
        return "bad" if block.link_chars and not block.heading else "short"
    words = block.text.lower().split()
    density = sum(w.strip(_EDGES) in stops for w in words) / len(words)
    if density >= limits.many_stops:
        return "good" if size > limits.long else "near"
    if density >= limits.few_stops:
        return "near"
    # lists and tables inside an article have few stop words
    return "short" if block.main else "bad"


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided block before and after them: of both if they agree, else
    `near` is good and `short` takes the nearer one, a heading the one after it. Inside an article only decided blocks of
    that article count; with none it is good, while outside of articles it is bad."""
    n = len(found)
    before: list[int] = []
    last: dict[int, int] = {}
    for i, label in enumerate(labels):
        before.append(last.get(found[i].main, -1))
        if label in ("good", "bad") and not found[i].aside:
            last[found[i].main] = i
    after = [-1] * n
    last = {}
    for i in range(n - 1, -1, -1):
        after[i] = last.get(found[i].main, -1)
        if labels[i] in ("good", "bad") and not found[i].aside:
            last[found[i].main] = i
    good = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            good.append(label == "good")
            continue
        around = [j for j in (before[i], after[i]) if j >= 0]
        values = {labels[j] == "good" for j in around}
        if not values:
            good.append(found[i].main > 0)
        elif len(values) == 1:
            good.append(values.pop())
        elif label == "near":
            good.append(True)
        else:
            nearest = after[i] if found[i].heading else min(around, key=lambda j: abs(j - i))
            good.append(labels[nearest] == "good")
    return good


def main_text(page: str, limits: Limits = Limits()) -> str:
    """The good blocks of a page, one per line."""
    found, language = blocks(page)
    stops = _BY_LANGUAGE.get(language, _EVERY_STOP)
    labels = [first_pass(b, stops, limits) for b in found]
    return "\n".join(b.text for b, good in zip(found, second_pass(found, labels)) if good)


def extract(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`page_id, url, text, n_chars` for every row of `pages` (`page_id, url, html`).

    A null or empty page, and a page without a good block, has an empty text. A page that ends inside a tag, comment or
    script is read up to there. Repeated rows give equal rows, null ids and urls stay null, other columns are ignored, an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(page, limits) if page else "" for page in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string").withColumn(
        "n_chars", F.length("text").cast("bigint")
    )
