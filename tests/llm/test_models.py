"""Single pieces against public libraries and brute force, without Spark."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from concord.llm import bpe, fertility, flac, html, ids, mph, shingles


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def test_bpe_is_that_of_the_public_library(coder):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    pool = [chr(i) for i in [*range(0x250), 0x2028, 0x3000, 0x200B, 0x4E2D, 0x1F600, 0xFEFF, 0x301]]
    texts = ["", " ", "\n\n a", "it's <|endoftext|> 1234", "ab" * 5000, "\x1c\x1d x"]
    texts += ["".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(1500)]
    for text in texts:
        coded = coder.encode(text)
        assert coded == public.encode_ordinary(text)
        assert coder.decode(coded) == text.encode()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 20_000])
def test_perfect_hash_gives_every_key_its_own_slot(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    found = mph.build(keys)
    slots = found.slots(keys)
    assert sorted(slots.tolist()) == list(range(n))
    assert [found.slot(int(k)) for k in keys[:50]] == slots[:50].tolist()


def test_perfect_hash_refuses_equal_keys():
    with pytest.raises(ValueError):
        mph.build(np.array([5, 6, 5]))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.binary(max_size=700), max_size=5))
def test_flac_round_trip(payloads):
    padded = [p.ljust(max(1, -(-len(p) // flac.FRAME)) * flac.FRAME, b" ") for p in payloads]
    assert flac.read_streams(flac.write_streams(padded)) == padded


def test_flac_of_odd_and_long_payloads():
    payloads = [b"\xff\xf8\x14\x02\x00" * 192, bytes([7]) * 192, b"\x00\xff" * 96 * 200, random.Random(3).randbytes(192 * 150)]
    payloads.append(b"the same line again and again \n" * 192 * 60)
    assert flac.read_streams(flac.write_streams(payloads)) == payloads


def test_every_changed_byte_of_a_flac_stream_is_noticed():
    good = flac.write_streams([b"some text that is long enough to be predicted ".ljust(384, b".")])[0]
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 0x10
        if 8 <= at - 0 < 18 or 18 <= at < 21 or 4 < at < 8 or 12 <= at < 18:
            continue  # sizes of frames and the rate are hints
        assert isinstance(flac.read_streams([bytes(bad)])[0], str), at
    assert isinstance(flac.read_streams([good[:-3]])[0], str)
    assert isinstance(flac.read_streams([None])[0], str)


def _bits(*fields):
    text = "".join(format(value & (1 << width) - 1, f"0{width}b") for value, width in fields)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def _stream(body, samples):
    import hashlib

    head = flac.SYNC + flac.CODES + b"\x00"
    crc = int(flac._crc(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]), 8)[0])
    frame = head + bytes([crc]) + body
    tail = int(flac._crc(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]), 16)[0])
    frame += tail.to_bytes(2, "big")
    signed = np.array(samples, np.int8).tobytes()
    rate = 8000 << 44 | 7 << 36 | len(samples)
    info = (192).to_bytes(2, "big") * 2 + b"\0" * 6 + rate.to_bytes(8, "big") + hashlib.md5(signed).digest()
    return flac.MARKER + b"\x80" + len(info).to_bytes(3, "big") + info + frame


def test_flac_reads_partitions_escapes_and_own_predictors():
    # two partitions, the first stored raw with 5 bits, the second with Rice parameter 0 in method 1
    first, second = [(i % 9) - 4 for i in range(96)], [i % 2 for i in range(96)]
    fields = [(8 << 1, 8), (1, 2), (1, 4), (31, 5), (5, 5), *((v, 5) for v in first), (0, 5)]
    fields += [(1, 2 * v + 1) for v in second]
    body = _bits(*fields)
    assert flac.read_streams([_stream(body, first + second)]) == [bytes((v + 128) % 256 for v in first + second)]
    # predictor x[i] = x[i-1] + 1/2 of the difference before, by coefficients 3/2 and -1/2
    samples = [10, 20]
    while len(samples) < 192:
        samples.append((3 * samples[-1] - samples[-2]) >> 1)
    fields = [(33 << 1, 8), (10, 8), (20, 8), (3, 4), (1, 5), (3, 4), (-1, 4), (0, 2), (0, 4), (0, 4)] + [(1, 1)] * 190
    assert flac.read_streams([_stream(_bits(*fields), samples)]) == [bytes(v + 128 for v in samples)]


def test_shingles_and_signatures():
    memo = shingles.WordHashes()
    texts = [b"", b" \n\t", b"One two", b"one TWO", b"a b c d e", b"a b c d e f", b"a b c d e a b c d e", b"x\xc2\xa0y"]
    sets = shingles.shingle_sets(texts, memo)
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1, 2, 5, 1]
    assert sets[2] == sets[3] and sets[4][0] in sets[5]
    rng = np.random.default_rng(5)
    left = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    right = np.concatenate([left[:2400], rng.integers(0, 2**63, 600, dtype=np.uint64)])
    signed = shingles.signatures([np.unique(left), np.unique(right)], shingles.coordinates(512))
    assert abs((signed[0] == signed[1]).mean() - 2400 / 3600) < 0.08


def test_main_text_of_pages():
    long = "the cat and the dog of this are in it and that is for the house. " * 5
    page = (
        "<html lang=en><head><title>T</title><style>p{}</style><script>var a='<p>no</p>'</script></head><body>"
        "<nav><ul><li><a href=/>Home</a></ul></nav><!-- x --><div class='cookie-notice'>We use cookies.</div>"
        f"<div id=content><h2>News &amp; more</h2><p>{long}<br>Next <b>bold</b>&nbsp;word.<p>Short end.</div>"
        f"<div class=comments><p>{long}</div><aside>{long}</aside><form>{long}</form><footer>(c) me</footer>"
    )
    text = " ".join(long.split())
    assert html.main_text(page) == f"News & more\n{text} Next bold word.\nShort end."
    # inside an article few stop words are no fault
    assert html.main_text("<article><p>uno | due | tre</p><p>x<nav>menu</nav></article><p>out") == "uno | due | tre\nx"
    for broken in ("", "<", "<p", "<!-- a", "<script>a", "</p></p>", "<a href='x", "&amp"):
        assert html.main_text(broken) == ""


def _measures(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.text(alphabet="ab é|#\n\t\x0b\xa0", max_size=60), min_size=1, max_size=4))
def test_counts_of_words_lines_and_windows(texts):
    model = _measures_vocabulary()
    columns = fertility._measure([t.encode() for t in texts], model)
    assert list(zip(*(c.tolist() for c in columns[:5]))) == [_measures(t) for t in texts]


_VOCABULARY = []


def _measures_vocabulary():
    if not _VOCABULARY:
        _VOCABULARY.append(fertility.Vocabulary.read(public_tokenizers.path("piece_bpe_32k.model")))
    return _VOCABULARY[0]


def test_fertility_of_a_text():
    model = _measures_vocabulary()
    words = ["hello", "world", "\U0001f9ff", "hello"]
    _, chars, _, _, _, n, per_token, bytes_share, entropy = (c[0] for c in fertility._measure([" ".join(words).encode()], model))
    tokens = [t for w in words for t in model.pieces.encode(w)]
    assert (chars, n) == (16, len(tokens)) and per_token == 16 / len(tokens)
    assert bytes_share == sum(model.pieces.is_byte(t) for t in tokens) / len(tokens) > 0
    share = np.array([tokens.count(t) / len(tokens) for t in set(tokens)])
    assert entropy == pytest.approx(-(share * np.log2(share)).sum() / np.log2(len(tokens)))


def test_shard_gives_ids_by_key(tmp_path):
    keys = [None, 3, 5, 5, 9]
    payloads = [np.array(x, "<u2").tobytes() for x in ([2], [7, 2], [1, 2], [8, 8, 2], [65535, 2])]
    path = tmp_path / "a.bin"
    path.write_bytes(ids._shard_file(keys, payloads, 2))
    shard = ids.Shard(str(path))
    assert shard.get(3).tolist() == [7, 2] and shard.get(5).tolist() == [1, 2] and shard.get(9).tolist() == [65535, 2]
    assert shard.get(4) is None and shard.get(0) is None
    assert [shard.ids(i).tolist() for i in range(5)][3] == [8, 8, 2]


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = ids.Coder.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    rng = random.Random(2)
    texts = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "\n a", "a\nb c\n d", "a\xa0 b", "\x1c a", "a<|endoftext|>b", "a text <|endoftext|> more", "<|endoftext|>", "<|endoftext|><|endoftext|> x <|endoftext|", " \n\n x", "it's 12  34 's"] + ["".join(rng.choices("aé \n'stl9中 \xa0", k=25)) for _ in range(800)]
    for text, raw in zip(texts, own.encode(texts)):
        assert np.frombuffer(raw, "<u2").tolist() == public.encode(text, add_special_tokens=False).ids
    assert zlib.crc32(b"") == 0


def test_words_are_learned_without_the_line_before_them(monkeypatch):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = ids.Coder.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    rng = random.Random(5)
    parts = ["\n", "\n\n", " \n", "\n ", "\r\n", "\t\n", "\n\t", "\x85\n", "\n\u3000", " ", "  ", "one", "Two.", "'s", "9,", "é!"]
    texts = ["one\nTwo.\nthree", "of one.\nTwo one,\nTwo one\nTwo\n", "\nTwo one"] + ["".join(rng.choices(parts, k=9)) for _ in range(800)]
    for text, raw in zip(texts, own.encode(texts)):
        assert np.frombuffer(raw, "<u2").tolist() == public.encode(text, add_special_tokens=False).ids
    own.words.clear()
    own.encode(["of one.\nTwo one,\nTwo one\nTwo"])
    assert set(own.words) == {"one", "one.", "one,", "\nTwo"}
    # a full memory keeps the words of the texts at hand
    learned = []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda words, lead: learned.extend(words) or learn(words, lead))
    monkeypatch.setattr(ids, "MEMO", 1)
    own.encode(["of one\nTwo four"])
    assert learned == ["four"] and set(own.words) == {"one", "\nTwo", "four"}


def test_pre_tokens_are_merged_together_as_one_by_one(coder):
    rng = random.Random(6)
    parts = ["th", "e", "ing", "a", "\u00e9", "\u4e2d", "!", "\0", "12", "'s"]
    pieces = ["".join(rng.choices(parts, k=rng.randint(1, 12))).encode() for _ in range(3000)] + [b"a", b"aaaaaaaa", b"\0\0"]
    assert coder.merged_together(pieces) == [tuple(coder.merged(p)) for p in pieces]
    texts = ["".join(rng.choices([*parts, " ", "\n", "th" * 40], k=20)) for _ in range(200)] + ["", " "]
    want = [[r for m in coder.find(t) for r in coder.merged(m.encode())] for t in texts]
    assert coder.encode_all(texts).to_pylist() == want


def test_full_memory_keeps_the_pre_tokens_at_hand(monkeypatch):
    own = bpe.ByteBpe([bytes([b]) for b in range(256)] + [b"ab", b"abc"], r" ?\w+")
    own.encode_all(["abc ab", "cab"])
    monkeypatch.setattr(bpe, "MEMO", 1)
    assert own.encode_all(["abc x", ""]).to_pylist() == [[257, 32, 120], []]
    assert set(own.memo) == {"abc", " x"}
