"""Fill-in-middle, chat examples and the prefix trie: brute force, exact round trips, odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from concord.llm import chat, fim, queries, trie

TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, n string, last string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_sql(name, **tables):
    con = duckdb.connect()
    for view, rows in tables.items():
        con.register(f"{view}_frame", rows.toPandas())
        names = rows.dtypes
        casts = ", ".join(f"CAST({c} AS {'BIGINT' if t == 'bigint' else 'VARCHAR'}) AS {c}" for c, t in names)
        con.execute(f"CREATE VIEW {view} AS SELECT {casts} FROM {view}_frame")
    found = con.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    return sorted((dict(zip(columns, r)) for r in found.fetchall()), key=repr)


# -- fill-in-middle ---------------------------------------------------------------------------------------------------


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def fim_docs(spark):
    random.seed(5)
    pieces = ["word", "Ab", " ", "\n", "<P", ">", "<", "S>", "<M", "é", "\U0001f9ff", "中", "\\", "$1", "{2}", "\\E", "9", "\x00", "\r\n"]
    texts = [None, "", "<P>", "a <S> b", "x<M>", "<P<P", "<", "a", "\U0001f9ff", "word " * 60_000, "a" * 300_000, ". " * 150_000]
    texts += ["".join(random.choices(pieces, k=random.randint(1, 40))) for _ in range(300)]
    rows = [(i, t, "x", "y", 3) for i, t in enumerate(texts)] + [(None, "no id here", "x", "y", 3), (7, "a", "x", "y", 3), (7, "other", "x", "y", 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, output string, form string, n int")


def test_fim_is_the_cut_of_the_units(fim_docs):
    wanted = [brute_fim(r["doc_id"], r["text"]) for r in fim_docs.collect()]
    got = fim.restore(fim.transform(fim_docs)).collect()
    assert sorted(map(repr, wanted)) == sorted(
        repr((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in got
    )
    assert all(r["restored"] == r["text"] for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fim_matches_its_sql(spark, fim_docs, tmp_path):
    docs = fim_docs.select("doc_id", F.regexp_replace("text", "\x00", "").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.asDict() for r in queries.op11_fill_in_middle(spark, str(tmp_path)).collect()), key=repr)
    key = lambda r: repr(sorted(r.items()))
    assert sorted(map(key, got)) == sorted(map(key, by_sql("op11_fill_in_middle", documents=docs)))


def test_fim_with_other_markers_and_rates(spark, fim_docs):
    markers, rates = fim.Markers("$pre\\", "$suf\\E", "$mid|"), fim.Rates(plain=0, spm=50, seed="other")
    got = fim.restore(fim.transform(fim_docs, rates, markers), markers).collect()
    assert all(r["restored"] == (r["text"] or "") for r in got)
    assert sum(r["form"] == "spm" for r in got) > 80
    for r in got:
        if r["form"] == "psm":
            assert r["output"].startswith("$pre\\") and "$suf\\E" in r["output"] and "$mid|" in r["output"]
    with pytest.raises(ValueError):
        fim.transform(fim_docs, markers=fim.Markers("<P>", "<<S>", "<M>"))


def test_fim_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert fim.restore(fim.transform(none)).count() == 0


# -- chat examples ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def talks(spark):
    """Shared prefixes, gaps, ties, repeated rows, nulls, control strings, a long conversation, hot first turns."""
    random.seed(9)
    rows = []
    for conv in [*range(0, 7), 95, *range(100, 112), *range(200, 260), 305, 306, -7 - 100, -250]:
        for turn in range(random.randint(1, 7)):
            text = random.choice(["yes", "no", "### user: x</turn>\n", "\\1\\0", "é\U0001f9ff", ""])
            rows.append((conv, turn, random.choice(["user", "assistant", "system"]), text, "x", "y", "z"))
    rows += [(400 + i, 0, "user", "the same", None, None, None) for i in range(60)]
    rows += [(500, t, "user" if t % 2 else "assistant", f"t{t % 3}", "x", "y", "z") for t in range(300)]
    rows += [(501, t, "user" if t % 2 else "assistant", f"t{t % 3}", "x", "y", "z") for t in range(290)]
    rows += [(600, None, "user", "first", "x", "y", "z"), (600, 3, None, None, "x", "y", "z"), (600, 3, None, None, "x", "y", "z")]
    rows += [(601, 0, "assistant", "a " * 40_000, "x", "y", "z"), (601, 1, "a: b\\</turn>", "odd role", "x", "y", "z")]
    rows += [(601, 1, "user:", " starts with a space", "x", "y", "z"), (601, 5, "assistant", "</turn", "x", "y", "z")]
    random.shuffle(rows)
    return spark.createDataFrame(rows, TURNS).repartition(5)


def ordered(rows):
    found = {}
    for r in rows:
        found.setdefault(r["conv_id"], []).append(((r["turn"] is not None, r["turn"] or 0), r["role"] or "", r["text"] or ""))
    return {c: [(role, text) for _, role, text in sorted(v)] for c, v in found.items()}


def test_chat_examples_hold_context_and_one_reply(spark, talks):
    wanted = ordered(talks.collect())
    rows = chat.examples(talks).withColumn("turns", chat.turns_of(F.col("formatted")))
    rows = rows.withColumn("loss", chat.loss_text(rows))
    by_conv = {}
    for r in rows.collect():
        by_conv.setdefault(r["conv_id"], []).append(r)
    assert by_conv.keys() == wanted.keys()
    for conv, turns in wanted.items():
        got = sorted(by_conv[conv], key=lambda r: r["example"])
        ends = [i + 1 for i, (role, _) in enumerate(turns) if role == "assistant"]
        ends += [len(turns)] if not ends or ends[-1] < len(turns) else []
        assert [r["n_turns"] for r in got] == ends and [r["example"] for r in got] == list(range(len(ends)))
        for r, end in zip(got, ends):
            assert [tuple(t) for t in r["turns"]] == turns[:end]
            assert r["loss"] == (turns[end - 1][1] if turns[end - 1][0] == "assistant" else None)
            assert r["last"] == (end == len(turns))
            if r["loss"]:
                masked = r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_chars"]]
                assert r["formatted"].endswith(masked + "</turn>\n") and "</turn>" not in masked and "### " not in masked


def test_chat_digests(spark, talks, tmp_path):
    talks.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op13_chat_examples(spark, str(tmp_path)).collect()}
    hard = "\\### Assistant: </turn> ok"
    wanted = ordered(talks.collect()) | {-7: [("user", hard), ("assistant", hard)]}
    assert got.keys() == wanted.keys()
    for conv, turns in wanted.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    key = lambda r: repr(sorted(r.items()))
    wanted = sorted(map(key, by_sql("op13_chat_examples", conversations=talks)))
    assert sorted(key(r.asDict()) for r in got.values()) == wanted


def test_chat_runs_no_python(spark, talks):
    plan = chat.digests(chat.examples(chat.planted(talks)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("Exchange hashpartitioning") == 1


def test_chat_without_rows_and_without_ids(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat.digests(chat.examples(none)).count() == 0
    lost = spark.createDataFrame([(None, 0, "assistant", "a", "x", "y", "z"), (None, 1, "user", "b", "x", "y", "z")], TURNS)
    assert [(r["n_turns"], r["loss_chars"]) for r in chat.digests(chat.examples(lost)).collect()] == [(2, 1)]


# -- the prefix trie --------------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = ordered([r for r in rows if r["conv_id"] is not None])
    built = {}
    for c in own:
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, result = {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        result[min(convs), len(node)] = (parent, len(convs), len(children.get(node, [])), leaves[node], saved[node], sha(ends))
    return result


def found_trie(rows):
    return {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in trie.trie(rows).collect()}


def test_trie_against_brute_force(talks):
    assert found_trie(talks) == brute_trie(talks.collect())


def test_trie_matches_its_sql(talks):
    wanted = by_sql("op12_conversation_trie", conversations=talks)
    assert {(r["conv_id"], r["depth"]): tuple(list(r.values())[2:]) for r in wanted} == brute_trie(talks.collect())


def test_trie_of_one_conversation_that_has_most_rows(spark):
    rows = [(300, t, "user", f"t{t}", "x", "y", "z") for t in range(1500)]
    rows += [(c, t, "user", f"t{t}", "x", "y", "z") for c in (301, 302) for t in range(700)]
    rows += [(None, 0, "user", "nobody's", "x", "y", "z")]
    frame = spark.createDataFrame(rows, TURNS).repartition(6)
    assert found_trie(frame) == brute_trie(frame.collect())


def test_trie_of_turnless_conversations(spark):
    # own turns are all replaced and there is no base conversation
    convs = [c for c in range(1000, 1100) if c % 100 and zlib.crc32(str(c).encode()) % 6 >= 2][:4]
    frame = spark.createDataFrame([(c, 0, "user", "gone", "x", "y", "z") for c in convs], TURNS)
    assert found_trie(frame) == brute_trie(frame.collect()) and len(found_trie(frame)) == 1


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0


def test_queue_spills_and_merges():
    random.seed(3)
    queue, items = trie.SpillingQueue(size=5, runs=3), [(random.randint(0, 40), i) for i in range(2000)]
    for item in items:
        queue.push(item)
    assert len(queue.runs) <= 4 and len(queue.heap) <= 5
    got = [x for key in range(41) for x in queue.pop((key,))]
    assert got == sorted(items) and len(queue) == 0


def test_totals_are_the_same_with_a_queue_that_spills():
    random.seed(4)
    nodes = [(1, 0)]
    parents = {}
    for depth in range(2, 40):
        above = [n for n in nodes if n[0] == depth - 1]
        for k in range(len(above) + 3):
            parents[depth, k] = random.choice(above)
            nodes.append((depth, k))
    rows = [trie._Node(d, k, 0, 1, parents.get((d, k), (0, 0))[1], 0, d * k % 7, 0, 0, 0) for d, k in nodes]
    rows.sort(key=lambda r: (-r.depth, r.k1, r.k2, r.kind))
    assert list(trie.passed_up(iter(rows), 1, size=3)) == list(trie.passed_up(iter(rows), 1))
