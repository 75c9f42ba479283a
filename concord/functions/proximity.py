"""Terms near each other: positions of the query terms in a text and the narrowest window that holds them.

The places of all terms come out of the tokens as one list in the order of the text, which is the merge of the sorted position
lists of the terms. One fold over that list keeps a few numbers per term, so that a text of any length costs one pass over
its tokens and one over its hits.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Near:
    """Words that must stand in one value with at most `distance` places between the first and the last of them, 1 being side by
    side for two words. `ordered`: in the order given. A word that is given twice must be there twice."""

    words: tuple[str, ...]
    distance: int
    ordered: bool = False

    def __post_init__(self) -> None:
        if not self.words or self.distance < 0:
            raise ValueError(f"words and a distance of 0 or more are needed: {self}")


def hits(tokens: Column, words: list[str]) -> Column:
    """`array<struct<at, word>>`: places of the words in the text, from 0, and their numbers in `words`."""
    known = F.array(*[F.lit(w) for w in words])
    placed = F.transform(tokens, lambda t, i: F.struct(i.alias("at"), F.array_position(known, t).cast("int").alias("word")))
    return F.filter(placed, lambda h: h["word"] > 0)


def span(tokens: Column, words: tuple[str, ...], ordered: bool = False) -> Column:
    """Places between the first and the last word of the narrowest window that has all `words`; null if there is none.

    In order, every word keeps the latest start of a sequence that ends with it. In any order, every word keeps its last
    places, as many as it is asked for.
    """
    distinct = list(dict.fromkeys(words))
    none = F.lit(None).cast("int")
    if ordered:
        names = [f"s{i}" for i in range(len(words))]

        def step(s: Column, h: Column) -> Column:
            state = []
            for i, word in enumerate(words):
                came = h["word"] == distinct.index(word) + 1
                state.append(F.when(came, h["at"] if i == 0 else s[f"s{i - 1}"]).otherwise(s[f"s{i}"]))
            ended = h["word"] == distinct.index(words[-1]) + 1
            best = F.when(ended, F.least(s["best"], h["at"] - state[-1])).otherwise(s["best"])
            return F.struct(best.alias("best"), *[x.alias(n) for x, n in zip(state, names)])

    else:
        asked = Counter(words)
        places = [(j, k) for j, word in enumerate(distinct) for k in range(asked[word])]
        names = [f"p{j}_{k}" for j, k in places]

        def step(s: Column, h: Column) -> Column:
            state = {}
            for j, k in places:
                before = h["at"] if k == 0 else s[f"p{j}_{k - 1}"]
                state[j, k] = F.when(h["word"] == j + 1, before).otherwise(s[f"p{j}_{k}"])
            firsts = [state[j, asked[word] - 1] for j, word in enumerate(distinct)]
            all_there = reduce(lambda a, b: a & b, [x.isNotNull() for x in firsts])
            first = F.least(*firsts) if len(firsts) > 1 else firsts[0]
            best = F.when(all_there, F.least(s["best"], h["at"] - first)).otherwise(s["best"])
            return F.struct(best.alias("best"), *[state[p].alias(n) for p, n in zip(places, names)])

    start = F.struct(none.alias("best"), *[none.alias(n) for n in names])
    return F.aggregate(hits(tokens, distinct), start, step, lambda s: s["best"])


def near(tokens: Column, asked: Near) -> Column:
    """Do the words stand near each other? False for a text without them."""
    return F.coalesce(span(tokens, asked.words, asked.ordered) <= asked.distance, F.lit(False))
