"""Quality rules: counts of words, lines and symbols, and how a public vocabulary cuts a text into tokens.

A vocabulary with byte fallback shows three things about a text: characters per token, the share of tokens that are single
bytes, and the entropy of its tokens. A text far off the texts of its language and length in one of them is rejected. The
bands are quantiles of all texts of a language, so they need no list of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from concord.llm.common import frugal, slices, utf8
from concord.llm.shingles import mixed
from concord.session import stored

#: How many times the distance of the quartiles from the median a measure may lie off the median, at the length of the text;
#: chosen by the labels of sf0.1. All byte shares there are 0, so that its reach is not chosen by them.
REACH = {"chars_per_token": 5.0, "byte_share": 7.0, "token_entropy": 6.0}
#: What a measure may always lie off the median: most texts of a language can have the same value.
LEAST_ROOM = {"chars_per_token": 0.05, "byte_share": 0.05, "token_entropy": 0.05}
#: Texts within so many distances of the quartiles from the median of their language make the trend over the length.
TREND = 3.0
#: Words that a worker remembers, after which it starts anew.
MEMO = 150_000
#: Text bytes that are measured at once: with their words and tokens they take some sixty times as much memory.
SLICE = 1 << 20

_SPACE = b" \t\n\x0b\x0c\r"
# fixed values of the contract
_SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50

MEASURES = ("chars_per_token", "byte_share", "token_entropy")
_SCHEMA = (
    "doc_id bigint, lang string, text_key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double"
)


class Vocabulary:
    """A SentencePiece model; goes to the tasks by broadcast: its size is that of the model file. Every worker remembers
    the tokens of words."""

    def __init__(self, model: bytes) -> None:
        self.model = model
        self._start()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as file:
            return cls(file.read())

    def __getstate__(self) -> dict:
        return {"model": self.model}

    def __setstate__(self, state: dict) -> None:
        self.model = state["model"]
        self._start()

    def _start(self) -> None:
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        n = self.pieces.get_piece_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(n)])
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.hashes: list[int] = []
        self.tokens = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of every word in the memo, and its 64-bit hash."""
        if len(self.memo) > MEMO:
            self._forget()
        new = list(set(words).difference(self.memo))
        if new:
            coded = self.pieces.encode([w.decode() for w in new], num_threads=1)
            for word in new:
                self.memo[word] = len(self.memo)
                self.hashes.append(xxhash.xxh3_64_intdigest(word))
            sizes = np.array([len(c) for c in coded], np.int64)
            self.tokens = np.concatenate([self.tokens, np.array([t for c in coded for t in c], np.int64)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.starts = np.cumsum(self.sizes) - self.sizes
        numbers = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        return numbers, np.array(self.hashes, np.uint64)[numbers]


def _repeated(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document how many words lie in three-word windows that the document has twice or more."""
    if len(hashes) < 3:
        return np.zeros(n_docs, np.int64)
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    key = mixed(mixed(hashes[inside]) + hashes[inside + 1])
    key = mixed(mixed(key + hashes[inside + 2]) + doc[inside].astype(np.uint64))
    order = np.argsort(key)
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[inside[twice] + k] = True
    return np.bincount(doc[covered], minlength=n_docs)


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    return len(lines) - len(set(lines))


def _measure(texts: list[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
    n = len(texts)
    split = [t.split() for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    doc = np.repeat(np.arange(n), n_words)
    numbers, hashes = vocabulary.learn([w for words in split for w in words])
    sizes = vocabulary.sizes[numbers] if len(numbers) else np.empty(0, np.int64)
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    at = np.arange(total) + np.repeat(vocabulary.starts[numbers] - (ends - sizes), sizes) if total else np.empty(0, np.int64)
    tokens, of = vocabulary.tokens[at], np.repeat(doc, sizes)
    n_tokens = np.bincount(of, minlength=n)
    both = np.sort(of << 32 | tokens)
    start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if total else np.empty(0, np.int64)
    counts = np.diff(np.append(start, total))
    weighted = np.bincount(both[start] >> 32, counts * np.log2(counts), minlength=n)
    with np.errstate(divide="ignore", invalid="ignore"):
        # entropy in bits against the most that so many tokens can have
        bits = np.log2(n_tokens) - weighted / n_tokens
        entropy = np.where(n_tokens > 1, bits / np.log2(n_tokens), np.nan)
        word_chars = np.array([_code_points(t) for t in texts], np.int64)
        return [
            n_words,
            word_chars,
            np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], np.int64),
            np.array([_duplicate_lines(t) for t in texts], np.int64),
            _repeated(hashes, doc, n),
            n_tokens,
            word_chars / n_tokens,
            np.bincount(of, vocabulary.is_byte[tokens], minlength=n) / n_tokens,
            entropy,
        ]


def _code_points(text: bytes) -> int:
    """Code points of a text that aren't space."""
    data = text.translate(None, _SPACE)
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def measures(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per row of `docs` (`doc_id, text, lang`) with the counts and the three measures, null without tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            columns = _measure(utf8(part, "text"), shared.value)
            arrays = [pa.array(c, from_pandas=True) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), *arrays],
                [f.split()[0] for f in _SCHEMA.split(", ")],
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.xxhash64("text").alias("text_key"),
        "text",
    )
    return rows.mapInArrow(frugal(run), _SCHEMA)


def _trends(passed: DataFrame) -> DataFrame:
    """`lang` and per measure `t_...`, by how much it rises with the logarithm of the number of tokens; without a spread of
    lengths 0. Texts far off the median have no say."""
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(f"q_{m}") for m in MEASURES]
    met = passed.alias("f").join(passed.groupBy("lang").agg(*quartiles).alias("b"), F.col("f.lang").eqNullSafe(F.col("b.lang")))
    slopes = []
    for m in MEASURES:
        q, value = F.col(f"q_{m}"), F.col(m)
        near = value.between(q[1] - TREND * (q[1] - q[0]), q[1] + TREND * (q[2] - q[1]))
        slope = F.regr_slope(F.when(near, value), F.when(near, F.log("n_tokens")))
        slopes.append(F.coalesce(F.nanvl(slope, F.lit(0.0)), F.lit(0.0)).alias(f"t_{m}"))
    return met.groupBy("f.lang").agg(*slopes)


def _spread_powers(leveled: DataFrame, middles: DataFrame) -> dict[str, float]:
    """Per measure the power of the number of tokens with which distances from the median go, 0 if that can't be told."""
    met = leveled.alias("f").join(middles.alias("b"), F.col("f.lang").eqNullSafe(F.col("b.lang")))
    slopes = []
    for m in MEASURES:
        off = F.abs(F.col(f"l_{m}") - F.col(f"m_{m}"))
        slopes.append(F.regr_slope(F.when(off > 1e-9, F.log(off)), F.when(off > 1e-9, F.log("n_tokens"))))
    found = met.agg(*slopes).first()
    return {m: min(max(p, -1.0), 0.0) if p is not None and p == p else 0.0 for m, p in zip(MEASURES, found)}


def _with_trends(rows: DataFrame, trends: DataFrame) -> DataFrame:
    """`rows` with `l_...`, the measures without their trend over the length."""
    met = rows.alias("f").join(trends.alias("t"), F.col("f.lang").eqNullSafe(F.col("t.lang")), "left")
    leveled = [(F.col(m) - F.col(f"t_{m}") * F.log("n_tokens")).alias(f"l_{m}") for m in MEASURES]
    return met.select("f.*", *leveled)


def _band(name: str, reach: float) -> Column:
    """Whether the distance `d_...` from the median, relative to the spread `s_...` at the text's length, is in the band."""
    q, spread, least = F.col(f"q_{name}"), F.col(f"s_{name}"), F.lit(LEAST_ROOM[name])
    low, high = -F.greatest(-reach * q[0] * spread, least), F.greatest(reach * q[1] * spread, least)
    return F.coalesce((F.col(f"d_{name}") * spread).between(low, high), F.lit(True))


def judge(docs: DataFrame, vocabulary: Vocabulary, reach: dict[str, float] = REACH) -> DataFrame:
    """`doc_id, lang, text_key, n_words`, the four counts, `base_failed, n_tokens`, the three measures and `kept` for every
    row of `docs` (`doc_id, text, lang`); `text_key` is a hash of the text.

    The base rules reject texts of less than 50 words and texts in which more than half of the words lie in repeated
    three-word windows. Others are rejected if a measure lies outside its band, which is made by the texts of the same
    language that pass the base rules: their median along a line over the logarithm of the number of tokens, with `reach`
    times the distance of the quartiles as room, relative to a power of the number of tokens with which distances go, and
    `LEAST_ROOM` at least. A null language is a language of its own. Null and empty texts have no words and
    fail. Repeated rows get equal values; ties at a bound are inside; an empty table gives an empty result.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    found = stored(measures(docs, vocabulary).withColumn("base_failed", failed), "measures")
    passed = found.filter("NOT base_failed")
    leveled = stored(_with_trends(found, stored(_trends(passed), "trends")), "leveled")
    passed = leveled.filter("NOT base_failed")
    medians = passed.groupBy("lang").agg(*[F.percentile_approx(f"l_{m}", 0.5, 10_000).alias(f"m_{m}") for m in MEASURES])
    medians = stored(medians, "medians")
    powers = _spread_powers(passed, medians)

    def apart(rows: DataFrame) -> DataFrame:
        met = rows.alias("f").join(medians.alias("b"), F.col("f.lang").eqNullSafe(F.col("b.lang")), "left")
        spread = {m: F.pow(F.greatest("n_tokens", F.lit(1)).cast("double"), F.lit(p)) for m, p in powers.items()}
        off = [((F.col(f"l_{m}") - F.col(f"m_{m}")) / spread[m]).alias(f"d_{m}") for m in MEASURES]
        return met.select("f.*", *off, *[spread[m].alias(f"s_{m}") for m in MEASURES])

    quartiles = [F.percentile_approx(f"d_{m}", [0.25, 0.75], 10_000).alias(f"q_{m}") for m in MEASURES]
    bands = apart(passed).groupBy("lang").agg(*quartiles)
    met = apart(leveled).alias("f").join(bands.alias("b"), F.col("f.lang").eqNullSafe(F.col("b.lang")), "left")
    kept = ~F.col("base_failed")
    for m in MEASURES:
        kept = kept & _band(m, reach[m])
    return met.select(
        "doc_id", "f.lang", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_tokens", *MEASURES, kept.alias("kept"),
    )
