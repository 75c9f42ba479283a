"""Text chains: how a role (relevance, sort, mergekey, facet) or a field turns text into terms.

A chain is a list of column functions over one term. `tokenize` splits the text into terms, the steps before it work on
the whole text, the steps after it on every term. `display` remembers the form shown to the user.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, SparkSession, functions as F

from concord.functions.text import az_joined, az_tokens, char_class, sort_string

Step = Callable[[Column], Column]


def remove_control(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Cntrl}", "")


def remove_space_punct(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\p{Punct}`]", "")


def title_case(text: Column) -> Column:
    return F.initcap(text)


def trim_trailing(chars: str) -> Step:
    return lambda text: F.regexp_replace(text, f"{char_class(chars)}+\\z", "")


def trim_leading(chars: str) -> Step:
    return lambda text: F.regexp_replace(text, f"^{char_class(chars)}+", "")


lower: Step = F.lower
TOKENIZE = "tokenize"
DISPLAY = "display"


@dataclass(frozen=True)
class WholeArrays:
    """A step that can't stand inside of an expression over one term, such as a pandas UDF: it takes the terms of all texts at once,
    an array of arrays. It must be the last step of a chain."""

    function: Step


#: English stems of the terms.
STEM = WholeArrays(lambda texts: _stem_all()(texts))


def _stem_all():
    from concord.functions.stemming import stem_all

    return stem_all


def _each(terms: Column, step: Step) -> Column:
    return F.transform(terms, lambda t: step(t))


@dataclass(frozen=True)
class TextChain:
    """Steps are column functions or the words TOKENIZE and DISPLAY, and at the end a step over `WholeArrays`."""

    steps: tuple

    def __post_init__(self) -> None:
        if any(isinstance(s, WholeArrays) for s in self.steps[:-1]):
            raise ValueError("a step over whole arrays must be the last one")

    def _split(self) -> tuple[TextChain, WholeArrays | None]:
        """The chain without its step over whole arrays, and that step."""
        if self.steps and isinstance(self.steps[-1], WholeArrays):
            return TextChain(self.steps[:-1]), self.steps[-1]
        return self, None

    def tokens_all(self, texts: Column) -> Column:
        """Terms of every text of an array."""
        plain, last = self._split()
        found = F.transform(texts, lambda t: plain.tokens(t))
        return last.function(found) if last else found

    def joined_all(self, texts: Column) -> Column:
        """Joined terms of every text of an array."""
        if self._split()[1] is None:
            return F.transform(texts, lambda t: self.joined(t))
        return F.transform(self.tokens_all(texts), lambda terms: F.array_join(terms, " "))

    def _run(self, text: Column) -> tuple[Column, Column]:
        """Terms and display form."""
        terms, tokenized, display = text, False, None
        for step in self.steps:
            if step == TOKENIZE:
                terms = F.regexp_extract_all(terms, F.lit(r"(?U)[^\s-]+-?|-"), F.lit(0))
                tokenized = True
            elif step == DISPLAY:
                display = F.array_join(terms, " ") if tokenized else terms
            else:
                terms = _each(terms, step) if tokenized else step(terms)
        if display is None:
            display = F.array_join(terms, " ") if tokenized else terms
        return (terms if tokenized else F.array(terms)), display

    def tokens(self, text: Column) -> Column:
        if self._split()[1] is not None:
            return F.get(self.tokens_all(F.array(text)), F.lit(0))
        return F.filter(self._run(text)[0], lambda t: t != "")

    def joined(self, text: Column) -> Column:
        return F.array_join(self.tokens(text), " ")

    def display(self, text: Column) -> Column:
        return self._split()[0]._run(text)[1]

    def sort(self, text: Column) -> Column:
        """Sort form of the text, null when it has no term."""
        return F.when(F.size(self.tokens(text)) > 0, self.joined(text))


class LettersChain(TextChain):
    """The default of relevance, sort and mergekey: runs of ASCII letters, lower-cased."""

    def __init__(self) -> None:
        super().__init__(())

    def tokens(self, text: Column) -> Column:
        return az_tokens(text)

    def joined(self, text: Column) -> Column:
        return az_joined(text)

    def display(self, text: Column) -> Column:
        return az_joined(text)

    def sort(self, text: Column) -> Column:
        return sort_string(text)


class WholeChain(TextChain):
    """The default of facet: the whole text, unchanged."""

    def __init__(self) -> None:
        super().__init__(())


LETTERS, WHOLE = LettersChain(), WholeChain()
DEFAULT_CHAINS = {"relevance": LETTERS, "sort": LETTERS, "mergekey": LETTERS, "facet": WHOLE}


def clean_words(text: str, chain: TextChain) -> list[str]:
    """The terms of a query text."""
    if chain is LETTERS:
        return [w.lower() for w in re.findall("[A-Za-z]+", text)]
    return SparkSession.active().range(1).select(chain.tokens(F.lit(text)).alias("t")).first()["t"]


# Ready chains for text with digits and letters of any script.
WORDS = TextChain((remove_control, TOKENIZE, remove_space_punct, lower))
TITLE_FACET = TextChain((DISPLAY, title_case))
ENGLISH = TextChain((remove_control, TOKENIZE, remove_space_punct, lower, STEM))
TRIMMED_FACET = TextChain((trim_trailing(",.!; "),))
