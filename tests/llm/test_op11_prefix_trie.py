import hashlib
import random

import numpy as np
import pytest
from llm_cases import SF, folder

from evalspark.llm import op11_prefix_trie as trie
from evalspark.llm.common import table

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(convs: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    """Nodes of the trie by the definition, one conversation after the other."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            a = p[:d]
            leaves[a] = leaves.get(a, 0) + (p not in kids)
            saved[a] = saved.get(a, 0) + ((len(members) - 1) * len(p[-1][1]) if p else 0)
    out = set()
    for p, m in nodes.items():
        ends = sorted(c for c in m if len(convs[c]) == len(p))
        out.add((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def trie_of(spark, convs, **sizes):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns or [(None, None)])]
    df = spark.createDataFrame(rows, "c bigint, place int, r string, t string")
    named = df.withColumn("name", trie.turn_names(df.r, df.t))
    got = [tuple(r) for r in trie.prefix_trie(trie.sequences(named, "c", "place", "name"), **sizes).collect()]
    assert len(got) == len(set(got))
    return set(got)


def random_convs(seed, n, longest, words):
    rng = random.Random(seed)
    convs = {}
    for c in rng.sample(range(-n, 5 * n), n):
        base = rng.choice(list(convs.values())) if convs and rng.random() < 0.7 else []
        tail = [(rng.choice("ua"), rng.choice(words)) for _ in range(rng.randrange(longest))]
        convs[c] = (base[:rng.randrange(len(base) + 1)] + tail)[:longest]
    return convs


@pytest.mark.parametrize("seed,n,longest,shards", [(1, 300, 6, 1), (2, 300, 40, 7), (3, 120, 12, 30)])
def test_equals_brute_force_in_any_number_of_shards(spark, seed, n, longest, shards):
    convs = random_convs(seed, n, longest, ["", "x", "yy", "é🙂", "x" * 50])
    turns = sum(map(len, convs.values()))
    assert trie_of(spark, convs, shard_turns=max(1, turns // shards), small_shard=1 << 30) == brute(convs)


def test_a_sequence_of_most_conversations_spans_shards(spark):
    hot = [("u", "hi"), ("a", "there"), ("u", "bye")]
    convs = {c: list(hot) for c in range(400)}
    convs |= {c: hot[:c % 3] for c in range(400, 500)} | {c: hot + [("a", str(c))] for c in range(500, 520)}
    got = trie_of(spark, convs, shard_turns=100, small_shard=1 << 30)
    assert got == brute(convs)
    assert max(r[3] for r in got if r[1] == 3) == 420


def test_no_two_turns_are_mixed_up(spark):
    # Role and text are kept apart, and empty turns are turns.
    convs = {1: [("a", "bc")], 2: [("ab", "c")], 3: [("", "")], 4: [("", ""), ("", "")], 5: [("1:a", "")]}
    assert trie_of(spark, convs) == brute(convs)


def test_one_very_long_conversation(spark):
    long = [("u", str(i)) for i in range(400)]
    convs = {1: long, 2: long[:300], 3: long[:300] + [("u", "other")], 4: [("u", "0")]}
    assert trie_of(spark, convs, shard_turns=250, small_shard=1 << 30) == brute(convs)


def test_shared_turns_of_sorted_rows():
    rng = np.random.default_rng(5)
    lens = rng.integers(0, 30, 200)
    ids = rng.integers(1, 3, lens.sum())
    convs = rng.permutation(200)
    order, lcp = trie.sort_rows(ids, lens, convs, width=4)
    seqs = [tuple(p) for p in np.split(ids, np.cumsum(lens)[:-1])]
    want = sorted(range(200), key=lambda r: (seqs[r], convs[r]))
    assert order.tolist() == want
    for i in range(1, 200):
        a, b = seqs[want[i - 1]], seqs[want[i]]
        shared = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[i] == shared


def _by_sql(path):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/conversations.parquet/*.parquet')")
    res = con.execute(trie.SQL)
    at = [[d[0] for d in res.description].index(c) for c in trie.COLUMNS]
    return sorted((tuple(r[i] for i in at) for r in res.fetchall()), key=repr)


def test_damaged_rows(spark, tmp_dir):
    """Nulls in every column, repeats, ties, absent bases, negative ids, clashing columns."""
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, None, None, None), (0, 1, "assistant", "b"),
            (None, 0, "user", "a"), (7, 5, "user", "late"), (7, 5, "assistant", "late"), (7, None, "user", ""),
            (100, 0, "user", "x" * 30000), (-5, 0, "user", "a"), (-105, 0, "user", "z"), (250, 3, None, "only")]
    rows += [(300 + i, t, "user", f"q{t % 3}") for i in range(100) for t in range(i % 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("depth", "place", "name", "shard", "ends", "kind"):
        df = df.selectExpr("*", f"'x' AS {c}")
    path = folder(spark, tmp_dir, conversations=df)
    got = trie.prefix_trie(trie.rebuilt(table(spark, path, "conversations")), shard_turns=20, small_shard=1 << 30)
    assert got.columns == trie.COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _by_sql(path)


def test_no_conversation_has_no_node(spark, tmp_dir):
    for rows in ([], [(None, 1, "user", "a")]):
        path = folder(spark, tmp_dir, f"t{len(rows)}", conversations=spark.createDataFrame(rows, SCHEMA))
        assert trie.query(spark, path).collect() == []


def test_python_sees_names_only(spark):
    plan = trie.rebuilt(table(spark, SF, "conversations"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan
