import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from llm_cases import SF, folder, no_docs, odd_docs

from evalspark.llm import op12_pii_spans as pii
from evalspark.llm.common import table

# The contract's patterns, as they stand.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def right(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        odd, even = d[::-1][::2], d[::-1][1::2]
        return 14 <= len(d) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if right(k, m.group())]


def joined(spans):
    return ",".join("%s:%d:%d" % s for s in sorted(spans, key=lambda s: (s[1], list(PATTERNS).index(s[0]))))


def random_text(rng):
    parts = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8.9",
             "+1 (988) 555-2485", "+49.30.1234567", "a.b@c.de", "a@b", "x@y.z@w.v", "@", ".", " ", "-", "+", "(", "é",
             "🙂", "12", "0007.0.0.1", "abc", "@@", "a@-.-", "%@1.2.3.4", "\n", "9" * 25]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(12)))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = random_text(rng)
        assert sorted(pii.base_spans(text)[0]) == sorted(plain(text)), text


@pytest.mark.parametrize("text", ["9" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "+1(" * 50_000,
                                  "0" * 10_000 + ".1.1.1", "12 34 " * 40_000, "(at)" * 50_000])
def test_long_texts_take_linear_time(text):
    weights = {"card any": 1.0}
    pii.find(text, weights, pii._pairs(weights))


def brute_best(n, candidates, weights, pairs):
    """The best of all segmentations, one by one."""
    names = [*pii.KINDS, "other"]
    best, out = -np.inf, None
    for r in range(len(candidates) + 1):
        for some in itertools.combinations(candidates, r):
            some = sorted(some, key=lambda c: c[0])
            if any(a[1] > b[0] for a, b in zip(some, some[1:])):
                continue
            at, prev, score = 0, len(names), 0.0
            for c in [*some, None]:
                for _ in range(at, c[0] if c else n):
                    score += pairs[prev, pii.OTHER]
                    prev = pii.OTHER
                if c:
                    k = names.index(c[2])
                    score += pairs[prev, k] + sum(weights.get(f, 0) for f in c[5])
                    at, prev = c[1], k
            if score > best:
                best, out = score, some
    return best, out


def random_island(rng, n):
    return [(i, j, k, i, j, [f"{k} {rng.randrange(4)}", f"{k} long {j - i}"])
            for i in range(n) for j in range(i + 1, min(n, i + 3) + 1)
            for k in rng.sample(["card", "phone"], rng.randrange(3))][:10]


def random_weights(rng):
    names = [*pii.KINDS, "other"]
    w = {f"{k} {i}": rng.gauss(0, 1) for k in ("card", "phone") for i in range(4)}
    w |= {f"{k} long {i}": rng.gauss(0, 1) for k in ("card", "phone") for i in range(1, 4)}
    return w | {f"{a} then {b}": rng.gauss(0, 1) for a in [*names, "start"] for b in names}


def test_decoding_finds_the_best_segmentation():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randrange(1, 6)
        cands, w = random_island(rng, n), random_weights(rng)
        pairs = pii._pairs(w)
        assert pii.decode(n, cands, w, pairs) == brute_best(n, cands, w, pairs)[1]


def test_gradient_is_that_of_the_likelihood():
    rng = random.Random(2)
    names = [*pii.KINDS, "other"]
    for _ in range(10):
        n, w = 4, random_weights(rng)
        number = {f: i for i, f in enumerate(w)}
        pair_at = np.array([[number[f"{a} then {b}"] for b in names] for a in [*names, "start"]])
        cands = [(i, j, pii.KINDS.index(k), tuple(number[f] for f in fs)) for i, j, k, _, _, fs in random_island(rng, n)]
        gold = {cands[0][:3]} if cands else set()
        x = np.array(list(w.values()))
        value, grad = pii.gradient(n, cands, gold, x, pair_at)
        assert value <= 1e-9
        for i in range(len(x)):
            step = np.zeros(len(x))
            step[i] = 1e-5
            up, down = (pii.gradient(n, cands, gold, x + s, pair_at)[0] for s in (step, -step))
            assert abs((up - down) / 2e-5 - grad.get(i, 0.0)) < 1e-4


def taught(spark, tmp_dir):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9)))

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    one = [card, lambda: f"+1 ({rng.randrange(100, 1000)}) 555-{rng.randrange(1000, 10000)}",
           lambda: ".".join(str(rng.randrange(1, 256)) for _ in range(4)), lambda: f"{word()}.{rng.randrange(99)}@mail.example.com",
           lambda: hashlib.sha1(word().encode()).hexdigest(), lambda: str(rng.randrange(10 ** 6, 10 ** 9))]
    rows = [(i, " ".join([word(), rng.choice(one)(), word() + "."])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return pii.learn(docs), card


def test_neighbours_that_a_pattern_runs_together_are_taken_apart(spark, tmp_dir):
    weights, card = taught(spark, tmp_dir)
    pairs = pii._pairs(weights)
    a, b, phone, ip = card(), card(), "+1 (269) 555-3296", "17.42.201.9"
    for parts, kinds in [((a, b), ("card", "card")), ((phone, a), ("phone", "card")), ((phone, ip), ("phone", "ip")),
                         ((a, phone), ("card", "phone")), ((phone, a, b), ("phone", "card", "card"))]:
        text = "some words " + " ".join(parts) + " and more"
        base, added = pii.find(text, weights, pairs)
        got = {(k, text[x:y]) for k, x, y in base + added}
        assert got == set(zip(kinds, parts))
        assert len(base) + len(added) == len(parts) and (added or parts == (a, phone))
    for clean in ("in 2019 and 2020, 1 234 567 items", "sum 1234567 8901234 5678901", "v1.2.3 of 10.000.000",
                  "id 30d97cbd701412341234560000", "mail @ noon", ""):
        assert pii.find(clean, weights, pairs) == ([], [])
    spelt = "write to jo.doe (at) mail.example.com soon"
    assert [(k, spelt[x:y]) for k, x, y in pii.find(spelt, weights, pairs)[1]] == [("email", "jo.doe (at) mail.example.com")]


def test_ambiguous_islands_teach_nothing():
    both = "+4111 1111 1111 1111"[:19]
    for text in ("+4111 1111 1111 11", both, "x +41111111111111 y", "4111111111111111 4111111111111111"):
        examples = list(pii.labelled(text))
        pii.fit([(e, 1) for e in examples], rounds=2)  # no overlapping labels reach the fit


def check_rows(docs, got):
    """Every row's base columns by the patterns; added spans valid and apart from them."""
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
    rows = sorted((str(r["doc_id"]), r) for r in got.collect())
    assert [i for i, _ in texts] == [i for i, _ in rows]
    left = {}
    for i, r in rows:
        left.setdefault(i, []).append(r)
    for i, text in texts:
        base = plain(text)
        want = [sum(s[0] == k for s in base) for k in PATTERNS]
        digest = hashlib.sha256(joined(base).encode()).hexdigest()
        r = next(r for r in left[i] if [r.n_email, r.n_ip, r.n_card, r.n_phone] == want and r.base_sha256 == digest)
        left[i].remove(r)
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base) <= set(spans) and joined(spans) == r.spans and r.n_added == len(spans) - len(base)
        for k, a, b in set(spans) - set(base):
            assert not any(x < b and a < y for _, x, y in base)
            assert k == "email" or right(k, text[a:b])


def test_query_on_whole_table(spark):
    check_rows(table(spark, SF, "documents"), pii.query(spark, SF))


def test_odd_tables(spark, tmp_dir):
    for i, clash in enumerate((False, True)):
        df = odd_docs(spark, clash)
        if clash:
            for c in ("n_card", "base", "example", "count"):
                df = df.selectExpr("*", f"'x' AS {c}")
        df = df.unionByName(df.selectExpr(*[f"'call +1 (988) 555-2485, a@b.cd' AS {c}" if c == "text" else
                                            "9007199254740993 AS doc_id" if c == "doc_id" else c for c in df.columns]).limit(3))
        check_rows(df, pii.query(spark, folder(spark, tmp_dir, f"t{i}", documents=df)))
    assert pii.query(spark, folder(spark, tmp_dir, "none", documents=no_docs(spark))).collect() == []


def test_other_columns_are_kept(spark):
    df = spark.createDataFrame([(1, None, "x@y.zz"), (None, "k", None)], "doc_id bigint, extra string, text string")
    got = sorted(pii.pii_spans(df, {}).collect(), key=lambda r: r.n_email)
    assert [(r.doc_id, r.extra, [tuple(s) for s in r.spans]) for r in got] == [(None, "k", []), (1, None, [("email", 0, 6)])]
