import random

import numpy as np
import pytest
from llm_cases import SF, no_docs, odd_docs

from evalspark.llm import op9_order_near_dups as op
from evalspark.llm.components import add_links, connected_components


def plain_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[:], i
        for j, y in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
    return d[-1]


def test_banded_alignment_is_exact():
    r = random.Random(3)
    for _ in range(6000):
        a = [r.choice("abcd") for _ in range(r.randint(0, 14))]
        b = list(a) if r.random() < 0.6 else [r.choice("abcd") for _ in range(r.randint(0, 14))]
        for _ in range(r.randint(0, 4)):
            if b and r.random() < 0.5:
                del b[r.randrange(len(b))]
            else:
                b.insert(r.randint(0, len(b)), r.choice("abcd"))
        most = r.randint(0, 14)
        assert op.edit_distance(a, b, most) == min(plain_distance(a, b), most + 1)


def brute_classes(docs):
    seq = [(i, op.words(t or "")) for i, t in docs]
    parent = list(range(len(seq)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(seq)):
        for j in range(i):
            if op.similar(seq[i][1], seq[j][1], 0.8):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(seq)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for g in groups.values():
        first = min((seq[i][0] is None, seq[i][0] or 0) for i in g)
        for i in g:
            out[i] = (None if first[0] else first[1], len(g))
    return sorted(((docs[i][0], *v) for i, v in out.items()), key=str)


def test_classes_by_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = op.query(spark, SF).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in rows), key=str) == brute_classes(docs)
    assert sum(r["kept"] for r in rows) == len({r["class_id"] for r in rows})


def test_a_large_group_and_a_shared_passage(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    draw = lambda n: [r.choice(vocab) for _ in range(n)]
    base, passage = draw(120), draw(60)
    docs = []
    for _ in range(150):  # near copies, three words changed
        w = list(base)
        for _ in range(3):
            w[r.randrange(len(w))] = r.choice(vocab)
        docs.append(" ".join(w))
    for _ in range(40):  # pairs that share a passage with all the others
        w = draw(60) + passage + draw(60)
        docs += [" ".join(w), " ".join(w[:50] + draw(2) + w[52:])]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(7)
    sizes = sorted(x["class_size"] for x in op.near_duplicates(df).collect())
    assert sizes == [2] * 80 + [150] * 150


@pytest.mark.parametrize("shared, changed", [(0, 12), (78, 12), (78, 6), (75, 4)])
def test_recall_near_the_limit(spark, shared, changed):
    """Pairs of 100 words, ``shared`` of them in all texts: at least 0.9 are found."""
    r = random.Random(shared + changed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    head, docs, pairs = [word() for _ in range(shared)], [], 1000
    for _ in range(pairs):
        w = head + [word() for _ in range(100 - shared)]
        x = list(w)
        for i in r.sample(range(100), changed):
            x[i] = word()
        docs += [" ".join(w), " ".join(x)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(5)
    found = {x["doc_id"]: x["class_id"] for x in op.near_duplicates(df).collect()}
    recall = sum(found[2 * i] == found[2 * i + 1] for i in range(pairs)) / pairs
    print(f"recall {recall}")
    assert recall >= 0.9


def test_smallest_is_argsort():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 129, 3000):
        v = rng.integers(0, 2 ** 64, size=(6, n), dtype=np.uint64)
        most = min(8, n)
        assert (op.smallest(v, most) == np.argsort(v, axis=1)[:, :most]).all()
        assert (op.smallest(v // np.uint64(2 ** 40) + np.uint64(2 ** 63), most).shape == (6, most))


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_of_random_links_in_two_steps(spark):
    r = random.Random(6)
    links = [(r.randrange(120), r.randrange(120)) for _ in range(90)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for x, y in links:
        a, b = find(x), find(y)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    frame = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    collect = lambda df: {x["node"]: x["component"] for x in df.collect()}
    assert collect(connected_components(frame(links))) == want
    first = connected_components(frame(links[:50]))
    assert collect(add_links(first, frame(links[50:]))) == want
    assert collect(add_links(first, frame([]))) == collect(first)


def test_keys_do_not_depend_on_the_step(monkeypatch):
    s = op.Settings()
    tokens = [f"w{i % 97}" for i in range(30_000)]
    one = op.Sketcher(s).keys(tokens)
    assert len(one) == s.tables * s.picks * (s.picks - 1) // 2 and (one == op.Sketcher(s).keys(tokens)).all()
    assert len(op.Sketcher(s).keys([])) == 0
    assert len(np.unique(op.Sketcher(s).keys(["a", "b"]))) == s.tables


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = op.near_duplicates(docs, carry=("source",)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in got), key=str) == brute_classes(rows)
    assert op.near_duplicates(no_docs(spark)).collect() == []


def test_pairs_in_a_shared_template(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(9000)]
    draw = lambda n: [r.choice(vocab) for _ in range(n)]
    template, docs = draw(75), []
    for _ in range(150):  # 100 words, 75 of them in all texts; four changed in the copy
        w = template + draw(25)
        v = list(w)
        for i in r.sample(range(100), 4):
            v[i] = r.choice(vocab)
        docs += [" ".join(w), " ".join(v)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(5)
    at = {x["doc_id"]: x["class_id"] for x in op.near_duplicates(df).collect()}
    found = sum(at[2 * i] == at[2 * i + 1] for i in range(150))
    assert found >= 149


def test_chains_of_texts_are_one_class(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(9000)]
    docs = []
    for _ in range(60):  # 100 ~ 98 ~ 79 words, 100 and 79 too far apart
        w = [r.choice(vocab) for _ in range(100)]
        docs += [" ".join(w[:n]) for n in (100, 98, 79)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(5)
    got = op.near_duplicates(df).collect()
    assert sorted(((x["doc_id"], x["class_id"], x["class_size"]) for x in got), key=str) == brute_classes(list(enumerate(docs)))


def test_cells_hold_every_similar_pair():
    """The word-count bound leaves out no pair of different classes that is a link."""
    import pandas as pd
    r = random.Random(3)
    s, vocab = op.Settings(), [f"w{i}" for i in range(300)]
    base = [r.choice(vocab) for _ in range(40)]
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(14)):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(w[r.randrange(6):])
    own = op.Sketcher(s)
    bag = lambda w: np.bincount((own.hashes(w) % np.uint64(s.bins)).astype(int), minlength=s.bins).astype(np.uint16).tobytes()
    p = pd.DataFrame({"text_id": [b"%03d" % i for i in range(90)], "mine": [b"%d" % (i % 4) for i in range(90)],
                      "words": [len(w) for w in texts], "bag": [bag(w) for w in texts], "block": [i % 2 for i in range(90)]})
    for lo, hi in ((0, 0), (0, 1), (1, 1)):
        cell = p[p["block"].isin([lo, hi])].assign(lo=lo, hi=hi)
        got = {(int(x), int(y)) for x, y in op.possible_pairs(cell, s)[["a", "b"]].itertuples(index=False)}
        want = {(i, j) for i in range(90) for j in range(i + 1, 90)
                if sorted((i % 2, j % 2)) == [lo, hi] and i % 4 != j % 4 and op.similar(texts[i], texts[j], s.similarity)}
        assert want and want <= got and all(i % 4 != j % 4 for i, j in got)


def test_no_pair_of_a_large_bucket_is_dropped(spark):
    """Texts that share one bucket only: each pair of different classes comes out that the bound allows."""
    n = 100
    texts = [" ".join([f"w{i}_{k}" for k in range(20)]) for i in range(n // 2)]
    texts += [t + " more" for t in texts]
    rows = spark.createDataFrame([(b"%03d" % i, t) for i, t in enumerate(texts)], "text_id binary, text string")
    members = rows.selectExpr("cast(7 as bigint) key", "text_id")
    names = rows.selectExpr("text_id node", "text_id component").limit(0)
    for block in (512, 16):
        got = op._rest(members, names, rows, op.Settings(block=block)).collect()
        pairs = [(int(x["a"]), int(x["b"])) for x in got]
        assert len(set(pairs)) == len(pairs) and {(i, i + n // 2) for i in range(n // 2)} <= set(pairs)


def template_texts(n):
    """``n`` texts of 100 words, 82 of them in all: most pairs pass the word counts in bins; each has a copy, two words off."""
    r = random.Random(12)
    template = [f"t{i}" for i in range(60)]
    common = [f"c{i}" for i in range(30)]
    texts = []
    for i in range(n // 2):
        w = template + r.sample(common, 22) + [f"x{i}_{k}" for k in range(18)]
        texts += [w, w[:50] + ["new", "words"] + w[52:]]
    return [" ".join(w) for w in texts]


def test_pairs_of_a_large_bucket_grow_with_its_texts(spark):
    """Buckets of n texts, the same in each, give fewer than n pairs; they join the classes as all links do."""
    for n, block in ((120, 2048), (240, 2048), (240, 50)):
        texts = template_texts(n)
        rows = spark.createDataFrame([(b"%03d" % i, t) for i, t in enumerate(texts)], "text_id binary, text string")
        members = rows.selectExpr("explode(array(7L, 9L)) key", "text_id")
        names = rows.selectExpr("text_id node", "text_id component").limit(0)
        pairs = [(int(x["a"]), int(x["b"])) for x in op._rest(members, names, rows, op.Settings(block=block)).collect()]
        assert len(set(pairs)) == len(pairs) < n
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in pairs:
            assert op.similar(op.words(texts[a]), op.words(texts[b]), 0.8)
            parent[find(a)] = find(b)
        want = brute_classes(list(enumerate(texts)))
        assert sorted((i, min(j for j in range(n) if find(j) == find(i))) for i in range(n)) == sorted(x[:2] for x in want)


def test_long_texts_are_dealt_by_their_characters(spark):
    """However few characters a block holds, no link of a large bucket is lost."""
    texts = template_texts(80)
    rows = spark.createDataFrame([(b"%03d" % i, t) for i, t in enumerate(texts)], "text_id binary, text string")
    members = rows.selectExpr("cast(7 as bigint) key", "text_id")
    names = rows.selectExpr("text_id node", "text_id component").limit(0)
    joined = set()
    for chars in (4_000_000, 3_000):
        got = op._rest(members, names, rows, op.Settings(block_chars=chars)).collect()
        joined.add(frozenset(i for x in got for i in (int(x["a"]), int(x["b"]))))
    assert joined == {frozenset(range(80))}


def class_and_strangers(n):
    """``n`` texts of 100 words: near copies of one text, but for eight that share half of it; of these 1 is
    linked to 0, and 5 to no one but a near copy in the large class."""
    r = random.Random(21)
    base = [f"t{i}" for i in range(100)]
    texts = []
    for i in range(n):
        w = list(base)
        for k in r.sample(range(100), 6):
            w[k] = f"x{i}_{k}"
        texts.append(w)
    for i in range(8):
        texts[i] = base[:50] + [f"y{i}_{k}" for k in range(50)]
    texts[1] = texts[0][:90] + [f"z{k}" for k in range(10)]
    texts[5] = texts[n - 1][:82] + [f"v{k}" for k in range(18)]
    return [" ".join(w) for w in texts]


@pytest.mark.parametrize("size", ["block", "block_chars"])
def test_strangers_of_a_large_class_are_what_is_repeated(spark, monkeypatch, size):
    """Rows of the cells grow with a bucket's texts, not with their square, and no link is lost."""
    made = []

    def group(self, *by, groupBy=type(spark.range(0)).groupBy):
        if by == ("key", "lo", "hi"):
            made.append(self.count())
        return groupBy(self, *by)
    monkeypatch.setattr(type(spark.range(0)), "groupBy", group)
    for n in (100, 200):
        texts = class_and_strangers(n)
        rows = spark.createDataFrame([(b"%03d" % i, t) for i, t in enumerate(texts)], "text_id binary, text string")
        members = rows.selectExpr("cast(7 as bigint) key", "text_id")
        names = rows.selectExpr("text_id node", "case when text_id < cast('008' as binary) then text_id else cast('008' as binary) end component")
        made.clear()
        settings = op.Settings(block=10) if size == "block" else op.Settings(block_chars=5_000)
        got = {(int(x["a"]), int(x["b"])) for x in op._rest(members, names, rows, settings).collect()}
        assert n <= sum(made) <= 4 * n
        assert (0, 1) in got and any(a == 5 and b >= 8 for a, b in got)
        for a, b in got:
            assert op.similar(op.words(texts[a]), op.words(texts[b]), 0.8)


def test_blocks_of_a_large_bucket_meet_once(spark):
    """Whatever bucket a pair's texts share and however they are dealt, each pair of different classes is in a cell."""
    n = 90
    texts = [f"a{i // 2} b{i // 2} c{i // 2} d{i // 2} e{i // 2}" + " f" * (i % 2) for i in range(n)]
    rows = spark.createDataFrame([(b"%03d" % i, t) for i, t in enumerate(texts)], "text_id binary, text string")
    members = (rows.selectExpr("cast(7 as bigint) key", "text_id").filter("text_id < cast('070' as binary)")
               .unionByName(rows.selectExpr("cast(5 as bigint) key", "text_id").filter("text_id >= cast('030' as binary)"))
               .unionByName(rows.selectExpr("cast(9 as bigint) key", "text_id")))
    names = rows.selectExpr("text_id node", "text_id component").limit(0)
    for block in (2048, 40, 7):
        got = {(int(x["a"]), int(x["b"])) for x in op._rest(members, names, rows, op.Settings(block=block)).collect()}
        assert got == {(i, i + 1) for i in range(0, n, 2)}
