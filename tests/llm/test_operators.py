"""Operators on small frames: brute force, and nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import itertools
import os
import re
import zlib

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from concord.llm import bpe, fertility, flac, html, ids, licences, lm, mixing, near, queries, urls

DOCS = "doc_id bigint, text string, lang string, source string, kept string, component string"
VOCABULARY = fertility.Vocabulary.read(public_tokenizers.path("piece_bpe_32k.model"))
CODER = bpe.ByteBpe(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def words(n, seed, size=400):
    return [f"w{(i * 7919 + seed * 104729) % size}x{seed}" for i in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that an operator must stand: with extra columns whose names clash with its own."""
    long = " ".join(words(60_000, 1))
    plain = "The first of the lines in a text.\nAnother line with a few words in it.\n" * 3
    rows = [
        (1, None, None, None, "x", "y"),
        (2, "", "en", "a", None, None),
        (3, " \n\t ", "en", "a", "x", "y"),
        (4, "word", None, "a", "x", "y"),
        (5, plain, "en", "b", "x", "y"),
        (5, plain, "en", "b", "x", "y"),
        (6, plain, "en", "a", "x", "y"),
        (None, plain, "en", "a", "x", "y"),
        (5, "another text under the same id", "en", "a", "x", "y"),
        (7, long, "xx", "c", "x", "y"),
        (8, "é ü \U0001f9ff \u4e2d\u6587 <|endoftext|> \x00 |", "de", None, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# -- near duplicates --------------------------------------------------------------------------------------------------


def shingle_set(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(found) < 5:
        return {tuple(found)}
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def brute_near(rows):
    sets = [shingle_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        known = [d for j, (d, _) in enumerate(rows) if find(j) == find(i) and d is not None]
        least = min(known, default=None)
        out.append((doc_id, len(sets[i]), least, doc_id is not None and doc_id == least))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_near_duplicates_are_those_of_brute_force(spark):
    rows, doc_id = [], 100
    for seed in range(12):
        base = words(60 + 5 * seed, seed, 1000)
        for change in (0, 1, 3, 5, 8, 12, 20):
            copy = list(base)
            for k in range(change):
                copy[(k * 17) % len(copy)] = f"new{seed}{change}{k}"
            rows.append((doc_id, " ".join(copy)))
            doc_id += 1
    passage = words(60, 99)
    rows += [(k, " ".join(words(80, 50 + k, 2000) + passage + words(40, 80 + k, 2000))) for k in range(10)]
    # a chain: neighbours are near, the ends are not
    chain = words(400, 77, 5000)
    rows += [(1000 + k, " ".join(chain[12 * k : 12 * k + 150])) for k in range(8)]
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert as_rows(found) == brute_near(rows)


def test_near_duplicates_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = near.near_duplicates(odd)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert as_rows(found) == brute_near(rows)
    assert near.near_duplicates(none).collect() == []


def test_pairs_in_blocks_are_all_pairs(spark, monkeypatch):
    """A list that is longer than a block, with members that aren't linked by a pivot."""
    monkeypatch.setattr(near, "BLOCK", 4)
    base = words(200, 5, 5000)
    rows = []
    for k in range(30):
        copy = list(base)
        for i in range(7 + k % 3):
            copy[(i * 27 + k * 5) % 200] = f"own{k}x{i}"
        rows.append((k, " ".join(copy)))
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert as_rows(found) == brute_near(rows)


def test_pair_whose_earlier_coordinate_agrees_in_its_low_bits_only(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, near.ALL, dtype=np.uint64)
    b = a.copy()
    b[2] ^= np.uint64(1 << 20)
    c, d = (rng.integers(0, 2**32, near.ALL, dtype=np.uint64) for _ in range(2))
    c[2], d[2] = a[2], b[2]
    rows = [(k, 100, *map(bytearray, near._kept(v))) for k, v in enumerate((a, b, c, d))]
    nodes = spark.createDataFrame(rows, "node bigint, n_shingles bigint, posted binary, short binary")
    pair = lambda v, at: int(v[at]) << 7 | at
    lists = [(pair(a, 2), 0), (pair(c, 2), 2), (pair(b, 2), 1), (pair(d, 2), 3), (pair(a, 5), 0), (pair(b, 5), 1), (pair(a, 90), 0), (pair(b, 90), 1)]
    shared = spark.createDataFrame(lists, "pair bigint, node bigint")
    alone = spark.createDataFrame([], "node bigint, component bigint")
    # one list gives the pair: the first in which it meets
    assert [(r["pair"], r["a"], r["b"]) for r in near._rest(shared, alone, nodes).collect()] == [(pair(a, 5), 0, 1)]


def test_pairs_with_a_pivot_are_not_compared_again(spark):
    import numpy as np

    value = np.random.default_rng(4).integers(0, 2**32, near.ALL, dtype=np.uint64)
    rows = [(k, 100, *map(bytearray, near._kept(value))) for k in range(8)]
    nodes = spark.createDataFrame(rows, "node bigint, n_shingles bigint, posted binary, short binary")
    pair = lambda at: int(value[at]) << 7 | at
    # a list of two, one of three and one of five others
    lists = [(pair(at), k) for at, members in ((3, (0, 1)), (4, (0, 1, 2)), (9, (3, 4, 5, 6, 7))) for k in members]
    shared = spark.createDataFrame(lists, "pair bigint, node bigint")
    alone = spark.createDataFrame([], "node bigint, component bigint")
    ends = lambda rows: {(r["a"], r["b"]) for r in rows.collect()}
    before = set().union(*(ends(near._pivot_pairs(shared, order)) for order in near.ORDERS))
    every = ends(near._rest(shared, alone, nodes))
    rest = ends(near._rest(shared, alone, nodes, near.ORDERS))
    assert every == before | rest and not before & rest and len(rest) in (3, 6)


# -- byte-level BPE ---------------------------------------------------------------------------------------------------


def test_bpe_of_odd_rows(odd, none):
    coded = bpe.decode(bpe.encode(odd.withColumn("ids", F.lit(1)), CODER), CODER)
    assert set(coded.columns) == {"doc_id", "lang", "source", "kept", "component", "ids", "decoded"}
    got = sorted((bytes(r["decoded"]), len(r["ids"])) for r in coded.collect())
    texts = [(r["text"] or "") for r in odd.collect()]
    assert got == sorted((t.encode(), len(CODER.encode(t))) for t in texts)
    assert bpe.encode(none, CODER).collect() == []


# -- token id shards --------------------------------------------------------------------------------------------------


def test_shards_of_odd_rows(spark, odd, none):
    coder = ids.Coder.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    # small shards and tasks, so that one key meets several of both
    manifest = ids.write(odd, coder, ids.folder(spark), 2, shard=100, task=3000)
    got = [tuple(r) for r in ids.read(manifest).orderBy("start").collect()]
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    assert [g[0] for g in got] == sorted((r["doc_id"] for r in odd.collect()), key=lambda k: (k is not None, k))
    start = 0
    for doc_id, begin, n, crc in got:
        assert begin == start
        wanted = []
        for text in texts[doc_id]:
            raw = coder.encode([text])[0]
            coded = [*(int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)), 2]
            wanted.append((len(coded), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in coded))))
        assert (n, crc) in wanted
        start += n
    assert manifest.count() > 3
    assert ids.read(ids.write(none, coder, ids.folder(spark), 2)).collect() == []


# -- media ------------------------------------------------------------------------------------------------------------


def test_media_of_odd_rows(odd, none):
    read = flac.load(flac.store(odd)).collect()
    assert len(read) == odd.count()
    want = []
    for r in odd.collect():
        data = (r["text"] or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192, b" ")
        want.append((r["doc_id"], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    got = [(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in read]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r["damage"] is None for r in read)
    blocks = max(read, key=lambda r: r["n_bytes"])["blocks"]
    assert [b["sample_offset"] for b in blocks] == [flac.PCM_BLOCK * k for k in range(len(blocks))] and len(blocks) > 3
    assert flac.load(flac.store(none)).collect() == []


def test_damaged_media_are_told(spark, odd):
    media = flac.store(odd.filter("doc_id = 6"))
    bad = media.withColumn("media", F.concat(F.expr("substring(media, 1, octet_length(media) - 4)"), F.lit(b"abcd")))
    row = flac.load(bad.unionByName(media.withColumn("media", F.lit(None).cast("binary")))).collect()
    assert [r["payload_sha256"] for r in row] == [None, None] and all(r["damage"] for r in row)


# -- pages ------------------------------------------------------------------------------------------------------------


def test_pages_with_nulls(spark):
    rows = [(1, None, None, 5), (None, "u", "", 5), (2, "u", "<article><p>text &lt;1&gt;</article>", 5)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = as_rows(html.extract(pages))
    assert got == sorted([(1, None, "", 0), (None, "u", "", 0), (2, "u", "text <1>", 8)] * 2, key=repr)
    assert html.extract(pages.limit(0)).collect() == []


# -- quality rules ----------------------------------------------------------------------------------------------------


def test_rules_of_odd_rows(odd, none):
    judged = fertility.judge(odd, VOCABULARY)
    got = {(r["doc_id"], r["text_key"]): r for r in judged.collect()}
    assert judged.count() == odd.count() and len(got) == 10
    for r in judged.collect():
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert fertility.judge(none, VOCABULARY).collect() == []


def test_bands_reject_what_is_unlike_its_language(spark):
    vocabulary = "time people water house morning garden river mountain letter window market village".split()
    texts = [" ".join(vocabulary[(i * 5 + k * k) % 12] + str(i % 7) * (k % 3) for i in range(80 + k)) for k in range(40)]
    strange = " ".join("\u0f00\u1680\u2c00" + chr(0x10300 + i) for i in range(80))
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(99, strange, "en")]
    judged = fertility.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), VOCABULARY)
    assert [r["doc_id"] for r in judged.filter("NOT base_failed AND NOT kept").collect()] == [99]


def test_bands_follow_the_length(spark):
    import random

    rng = random.Random(6)
    pool = [a + b for a in "house water people garden river window letter market".split() for b in ("", "s", "ing", "er", "land", "side", "man", "able")]
    rows = [(k, " ".join(rng.choices(pool, k=rng.choice([60, 120, 400, 900]))), "en") for k in range(160)]
    # few words in any order: as poor as a long text, but short; and marks behind the words
    rows += [(200 + k, " ".join(rng.choices(pool[k : k + 10], k=130)), "en") for k in range(4)]
    rows += [(300 + k, " ".join(w + "%%%" for w in rng.choices(pool, k=400)), "en") for k in range(4)]
    judged = fertility.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), VOCABULARY)
    assert judged.filter("base_failed").count() == 0
    gone = {r["doc_id"] for r in judged.filter("NOT kept").collect()}
    assert {d for d, *_ in rows if d >= 200} <= gone and len(gone) <= 8 + 8


# -- quality classifier -----------------------------------------------------------------------------------------------


def brute_model(texts):
    """Interpolated modified Kneser-Ney over characters in plain Python, as a function of a trigram."""
    from collections import Counter
    from math import log

    three = Counter(t[i : i + 3] for x in texts for t in ["\x02\x02" + x + "\x03"] for i in range(len(t) - 2))
    two = Counter(g[1:] for g in three)
    one = Counter(g[1:] for g in two)

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
        d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5 for k in (1, 2, 3)]
        return [min(max(x, 0.05), k) for x, k in zip(d, (1, 2, 3))]

    d3, d2, d1 = discounts(three), discounts(two), discounts(one)
    cut = lambda n, d: n - d[min(n, 3) - 1] if n else 0.0

    def level(c, d, key, context, lower):
        around = [v for g, v in c.items() if g[:-1] == context]
        if not around:
            return lower
        return (cut(c[key], d) + sum(d[min(v, 3) - 1] for v in around) * lower) / sum(around)

    def logp(g):
        size = len(one) + 1
        p = level(one, d1, g[2], "", 1 / size) if one else 1 / size
        p = level(two, d2, g[1:], g[1], p)
        return log(level(three, d3, g, g[:2], p))

    return logp


def test_perplexity_is_that_of_a_plain_model(spark):
    from math import exp

    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog and the mat", "zzz \u4e2d qqq", "the the the", ""]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 0)], "doc_id bigint, quality int")
    model = brute_model(texts[:3])
    for row in lm.classify(docs, labels).collect():
        marked = "\x02\x02" + texts[row["doc_id"]] + "\x03"
        grams = [marked[i : i + 3] for i in range(len(marked) - 2)]
        if texts[row["doc_id"]]:
            assert row["n_grams"] == len(grams)
            assert row["perplexity"] == pytest.approx(exp(-sum(map(model, grams)) / len(grams)))
        else:
            assert row["perplexity"] is None and not row["kept"]


def test_texts_over_several_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(words(40, i)), "en") for i in range(20)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id bigint, quality int")
    whole = as_rows(lm.classify(docs, labels).select("doc_id", F.round("perplexity", 6)))
    # the block size goes to the tasks with the function
    import concord.llm.lm as module

    run = module.blocks
    monkeypatch.setattr(module, "blocks", lambda d: run(d.repartition(7)))
    assert as_rows(lm.classify(docs, labels).select("doc_id", F.round("perplexity", 6))) == whole


def test_junk_goes_and_clean_text_stays(spark):
    clean = [(k, " ".join(["the river", "a garden", "of the house", "and water"][(i * i + k) % 4] for i in range(60)), "en") for k in range(30)]
    junk = [(100 + k, " ".join(f"#{i * 37 % 91}%%&Q" for i in range(60)), "en") for k in range(5)]
    docs = spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id bigint, quality int")
    kept = {r["doc_id"] for r in lm.classify(docs, labels).filter("kept").collect()}
    assert kept == set(range(30))


def test_junk_of_any_length_goes_by_the_spread_of_its_length(spark):
    import random

    rng = random.Random(4)
    pool = [rng.choice(["ri", "ga", "hou", "wa", "mor"]) + rng.choice(["ver", "den", "se", "ter", "ning"]) for _ in range(40)]
    often = [1 / (k + 1) for k in range(40)]
    clean = [(k, " ".join(rng.choices(pool, often, k=rng.choice([6, 20, 80, 300]))), "en") for k in range(160)]
    # the commonest words again and again, words in other shares over a long text, and short strings that no language has
    junk = [(200 + k, " ".join([pool[k]] * 1200), "en") for k in range(2)]
    junk += [(210 + k, " ".join(rng.choices(pool, k=1200)), "en") for k in range(3)]
    junk += [(300 + k, f"{k}#%%&Q{k}$", "en") for k in range(8)]
    docs = spark.createDataFrame(clean + junk, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(160)], "doc_id bigint, quality int")
    kept = {r["doc_id"] for r in lm.classify(docs, labels).filter("kept").collect()}
    assert not kept & {d for d, *_ in junk} and len(kept) >= 0.95 * len(clean)


def test_classifier_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (None, 1), (5, 1)], "doc_id bigint, quality int")
    got = lm.classify(odd, labels).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"] for r in got if r["perplexity"] is None} == {1, 2}
    # without any trusted document nothing bounds
    free = lm.classify(odd, labels.limit(0)).collect()
    assert {r["doc_id"] for r in free if not r["kept"]} == {1, 2}
    assert lm.classify(none, labels).collect() == []


# -- licences ---------------------------------------------------------------------------------------------------------


def test_licences(spark, none):
    mit = "Copyright (c) 2020 Someone\n\n" + licences.MIT.upper().replace("\n", "\r\n   ") + "\n"
    rows = [
        (1, mit),
        (2, licences.MIT.replace("sublicense", "sub-license")),
        (3, licences.MIT + " more"),
        (4, "Text.\n  Released under the MIT Licence!\nLicensed under CC BY-NC 4.0.\nreleased under the MIT license"),
        (5, None),
        (6, ""),
        (7, "(c) only"),
        (8, licences._BSD_HEAD.replace("1.", "*") + licences._BSD_TAIL),
        (8, licences._BSD_HEAD + licences._BSD_TAIL),
    ]
    found = licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("digest", F.lit(1)))
    got = sorted((r["doc_id"], r["licence"] or "", r["notices"] or "", r["digest"] is None) for r in found.collect())
    assert got == [
        (1, "MIT", "", False), (2, "MIT", "", False), (3, "", "", False), (4, "", "CC-BY-NC-4.0,MIT", False),
        (5, "", "", True), (6, "", "", True), (7, "", "", True), (8, "", "", False), (8, "BSD-2-Clause", "", False),
    ]
    assert licences.scan(none).collect() == []


def test_licences_inside_of_documents(spark):
    commented = "/*\n" + "\n".join(f" * {line}" for line in ("Copyright 1999 Nobody\n\n" + licences.MIT).split("\n")) + "\n */\n\nint main() {}\n"
    wrapped = " ".join(licences.MIT.split("\n\n")[0].split()) + "\n\n" + "\n\n".join(licences.MIT.split("\n\n")[1:])
    bsd = licences._BSD_HEAD + licences._BSD_NAME + licences._BSD_TAIL
    rows = [
        (1, commented),
        (2, "Some text.\n\n" + wrapped + "\n \t\nmore text\n\n" + bsd),
        (2, "Some text.\n\n" + wrapped + "\n \t\nmore text\n\n" + bsd),
        (3, "Some text.\n\n" + licences.MIT[:-20]),
        (4, "x\n\n" * 50_000 + licences.ISC + "\n\n" + licences.ISC),
        (None, licences.MIT + "\n\nend"),
    ]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, units string, licence string")
    got = sorted(((r["doc_id"] or 0, r["licence"], r["embedded"]) for r in licences.scan(docs).collect()), key=repr)
    assert got == [(0, None, "MIT"), (1, None, "MIT"), (2, None, "BSD-3-Clause,MIT"), (2, None, "BSD-3-Clause,MIT"), (3, None, None), (4, None, "ISC")]


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="no licence texts here")
def test_listed_licences(spark):
    texts = {n: open(f"/usr/share/common-licenses/{n}").read() for n in ("GPL-3", "Apache-2.0", "MPL-2.0")}
    rows = [(1, texts["GPL-3"]), (2, "My program\n\n" + texts["Apache-2.0"].upper() + "\n\n" + texts["MPL-2.0"].replace("License", "Licence"))]
    rows += [(3, texts["GPL-3"][: texts["GPL-3"].index("END OF TERMS")] + "\n\nand more")]
    got = {r["doc_id"]: (r["licence"], r["embedded"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: ("GPL-3.0", "GPL-3.0"), 2: (None, "Apache-2.0,MPL-2.0"), 3: (None, "GPL-3.0")}
    assert len({k.digest for k in licences.listed()}) == len(licences.listed())


# -- mixing -----------------------------------------------------------------------------------------------------------


def test_fit_meets_all_marginals(spark):
    cells = [("a", "en", "x", 500), ("a", "de", "y", 100), ("b", "en", "x", 50), ("b", "de", "x", 20), ("b", "en", "y", 70), ("a", "en", "y", 9)]
    frame = spark.createDataFrame(cells, "cell_source string, cell_lang string, cell_topic string, tokens bigint")
    targets = mixing.Targets(0.5, 0.7, 0.8, 0.2)
    fitted = mixing.bounded_fit(frame, targets)[0].collect()
    total = sum(c[3] for c in cells)
    assert all(0 < r["fitted"] < r["tokens"] for r in fitted)
    for k, (d, power) in enumerate(zip(mixing.DIMENSIONS, targets[:3])):
        own = {}
        for c in cells:
            own[c[k]] = own.get(c[k], 0) + c[3]
        every = sum(v**power for v in own.values())
        for value, tokens in own.items():
            held = sum(r["fitted"] for r in fitted if r[f"cell_{d}"] == value)
            assert held == pytest.approx(tokens**power / every * total * 0.2, rel=1e-6)
    assert all(r["settled"] for r in fitted)


def test_rates_of_skewed_sources_hold_the_marginals(spark):
    # one source has a third of the tokens, and most cells of the others are small
    cells = [("hot", lang, topic, 400 * n * m) for lang, n in (("en", 5), ("de", 1)) for topic, m in (("x", 9), ("y", 2))]
    cells += [(f"s{k}", lang, topic, 3 + 17 * k * (1 + (k + i) % 4)) for k in range(30) for i, (lang, topic) in enumerate((("en", "x"), ("de", "y"), ("en", "y")))]
    frame = spark.createDataFrame(cells, "cell_source string, cell_lang string, cell_topic string, tokens bigint")
    targets = mixing.Targets(0.5, 0.7, 0.8, 0.5)
    fitted, marginals = mixing.bounded_fit(frame, targets)
    rows = fitted.collect()
    assert len(rows) == len(cells) and all(0 < r["fitted"] <= r["tokens"] and r["settled"] for r in rows)
    total = sum(c[3] for c in cells)
    assert any(r["fitted"] == r["tokens"] for r in rows) and sum(r["fitted"] for r in rows) == pytest.approx(0.5 * total, rel=1e-5)
    for m in marginals.collect():
        held = sum(r["fitted"] for r in rows if r[f"cell_{m['dimension']}"] == m["value"])
        assert held == pytest.approx(m["held"]) and held == pytest.approx(m["wanted"], rel=1e-5)
        assert m["wanted"] >= m["target"] * (1 - 1e-9) or m["wanted"] == m["own"]


def test_marginals_out_of_reach_are_told(spark):
    # all of de is one cell of a source that may only hold little of the mix
    cells = [("a", "de", "x", 100), ("a", "en", "x", 10_000), ("b", "en", "x", 90)]
    frame = spark.createDataFrame(cells, "cell_source string, cell_lang string, cell_topic string, tokens bigint")
    fitted, marginals = mixing.bounded_fit(frame, mixing.Targets(0.0, 0.0, 1.0, 0.5))
    told = {(m["dimension"], m["value"]): m for m in marginals.collect()}
    assert told["source", "b"]["wanted"] == told["source", "b"]["own"] == 90 < told["source", "b"]["target"]
    assert told["lang", "de"]["wanted"] == 100 < told["lang", "de"]["target"]
    assert sum(r["fitted"] for r in fitted.collect()) == pytest.approx(0.5 * 10_190, rel=1e-5)


def test_mix_of_odd_rows(odd, none):
    mixed = mixing.mix(odd.withColumn("rate", F.lit("x")).withColumn("cell_lang", F.lit("x")))
    rows = mixed.collect()
    assert len(rows) == odd.count() and mixed.columns[:4] == ["doc_id", "text", "lang", "source"]
    assert all(r["rate"] == 0 and not r["taken"] for r in rows if r["n_tokens"] == 0)
    assert mixing.mix(none).collect() == []


# -- URLs -------------------------------------------------------------------------------------------------------------


def brute_site(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    found = ("", None)
    for site in urls.SITES:
        if (host == site.host or host.endswith("." + site.host)) and path.startswith(site.path) and len(site.rule) > len(found[0]):
            found = (site.rule, site.verdict)
    return host, path, found[0] or None, found[1] or "allow"


def test_site_rules(spark):
    rows = ["http://a.example.ORG/es/1", "https://example.org/en/12?x", "https://example.org/en/2", "http://xexample.org/es/1",
            "ftp://fr.com/fr/#a", "http://com/de/", "http://x.com/de", "http://x.com?/de/", "//x.com/de/", None, "", "a://b://c/d",
            "http://org", "http://org/", "http://a.net/\u00c4/B", "mailto:x@example.org/es/"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(rows)] * 2, "page_id bigint, url string, rule string")
    rules = urls.mine(spark.createDataFrame([], "url string, blocked boolean"))
    judged = urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")
    assert as_rows(judged) == sorted([(i, *brute_site(u)) for i, u in enumerate(rows)] * 2, key=repr)
    assert urls.judge(pages.limit(0), rules).collect() == []


def test_mined_rules_are_those_of_brute_force(spark):
    rows = []
    for i in range(60):
        bad = i % 4 == 0
        rows.append((f"http://{'spam' if bad else 'good'}{'' if i % 5 else '.x'}.net/{'buy' if bad or i % 3 == 0 else 'read'}/{i}", bad))
    rows += [("http://spam.net/read/7", False), (None, True), ("http://a.net/", None), ("", False)]
    frame = spark.createDataFrame(rows, "url string, blocked boolean")
    # any token of a class will do
    mined = {
        tuple(sorted(choice)): (r["confidence"], r["support"])
        for r in urls.mine(frame, 0.1, 0.7).collect()
        for choice in itertools.product(*r["classes"])
    }
    baskets = [
        (set(r["t"]), r["blocked"])
        for r in frame.filter("url IS NOT NULL AND blocked IS NOT NULL").select(urls.tokens(F.col("url")).alias("t"), "blocked").collect()
    ]
    every = sorted(set().union(*(b for b, _ in baskets)))
    rules = {}
    for size in range(1, 8):
        for combination in itertools.combinations(every, size):
            having = [bad for b, bad in baskets if b.issuperset(combination)]
            if sum(having) >= 0.1 * len(baskets) and sum(having) >= 0.7 * len(having):
                rules[combination] = (sum(having) / len(having), sum(having) / len(baskets))
    kept = {
        r: v
        for r, v in rules.items()
        if not any(rules.get(tuple(x for x in r if x != out), (0, 0))[0] >= v[0] for out in r)
    }
    assert mined.keys() == kept.keys() and kept
    for r, v in kept.items():
        assert mined[r] == pytest.approx(v)
    pages = spark.createDataFrame([(1, "http://spam.net/buy/1"), (2, "http://good.net/read/1"), (3, None)], "page_id bigint, url string")
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge(pages, urls.mine(frame, 0.1, 0.7)).collect()}
    assert verdicts == {1: "block", 2: "allow", 3: "allow"}


def test_rules_of_long_templates(spark):
    template = "/".join(f"part{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30))
    rows = [(f"http://shop.net/{template}/{k}", True) for k in range(20)] + [(f"http://news.net/a/{k}", False) for k in range(400)]
    # and another whose parts also occur elsewhere, each in other URLs
    parts = [f"own{chr(97 + i)}" for i in range(24)]
    rows += [("http://more.net/" + "/".join(parts), True)] * 10 + [(f"http://b.net/{p}/{'q' * i}", i % 3 == 0) for i, p in enumerate(parts)]
    rules = urls.mine(spark.createDataFrame(rows, "url string, blocked boolean"), max_tokens=8)
    asked = [(1, "http://x.org.net/partha"), (2, "http://news.net/a/9"), (3, "http://shop.net/"), (4, "x" * 100_000), (5, "http://more.net/owna/ownb/ownd")]
    pages = spark.createDataFrame([(i, u, "r", "c") for i, u in asked], "page_id bigint, url string, rules string, classes string")
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules).collect()}
    assert verdicts == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "block"}
    assert max(len(r["tokens"]) for r in rules.collect()) <= 8


def test_rules_of_urls_with_many_tokens_are_all_mined(spark):
    rows = []
    for i in range(120):
        parts = [p for k, p in enumerate("abcdefghij") if (i * 7919 + k * k * 31 + i * i * k) % 11 < 7]
        rows.append((f"http://{'x' if i % 2 else 'y'}.net/{'/'.join(parts)}/{i}", {"a", "c"} <= set(parts) and i % 5 > 0 or i % 7 == 0))
    frame = spark.createDataFrame(rows, "url string, blocked boolean")
    few = urls.mine(frame, 0.03, 0.6, max_tokens=3).collect()
    assert sorted(few) == sorted(urls.mine(frame, 0.03, 0.6, max_tokens=99).collect())
    assert max(len(r["tokens"]) for r in few) > 3
    baskets = [(set(r["t"]), r["blocked"]) for r in frame.select(urls.tokens(F.col("url")).alias("t"), "blocked").collect()]
    for r in few:
        having = [bad for b, bad in baskets if b.issuperset(r["tokens"])]
        assert (r["confidence"], r["support"]) == (sum(having) / len(having), sum(having) / len(baskets))


def test_language_of_a_page_with_much_before_it():
    words = "der die und das haus fluss garten fenster markt brief morgen wasser zeit leute " * 6
    tag, body = "<html lang=de>", f"<body><p>{words}</p><p>short text</p><p>{words}"
    late = f"<!-- <html lang=fr> {'x' * 3000} --><script>var a='<html lang=es>{'y' * 3000}'</script>{tag}{body}"
    assert html.blocks(late)[1] == "de" and html.main_text(late) == html.main_text(tag + body)


# -- registered queries -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op3_source_mixing", "op4_licence_digests", "op8_minhash_near_dedup"])
def test_queries_beside_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    found = queries.QUERIES[name](spark, folder)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    result = connection.execute(queries.SQL[name])
    columns = [d[0] for d in result.description]
    assert as_rows(found.select(*columns)) == sorted(result.fetchall(), key=repr)


def test_all_registered_sql_is_sql(spark):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    for name, sql in queries.SQL.items():
        assert name in queries.QUERIES and isinstance(sql, str), name
        assert connection.execute(sql).fetchone(), name
