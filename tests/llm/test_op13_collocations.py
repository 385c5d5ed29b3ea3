import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import folder, no_docs, odd_docs

from evalspark.llm import count_automaton as wa
from evalspark.llm import op13_collocations as co

COLS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, longest, share=50, top=2000):
    """The formula, phrase by phrase, with Python's whole numbers."""
    out = set()
    for lang in {'und' if g is None else g for g, _ in rows}:
        f, n = Counter(), 0
        for text in (t or "" for g, t in rows if ("und" if g is None else g) == lang):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
                ws = tuple(w for w in re.split("[ \t]+", piece) if w)
                n += len(ws)
                f.update(ws[i:i + k] for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
        cand = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        spans = {}
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    spans[p[i:i + k]] = max(spans.get(p[i:i + k], 0), a)
        rows_ = []
        for p, a in cand.items():
            if 100 * spans.get(p, 0) >= share * a and p in spans:
                continue
            cuts = [(10 ** 6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows_.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], n, score))
        rows_.sort()
        out |= {(lang, i + 1, r[2].decode(), *r[3:]) for i, r in enumerate(rows_[:top])}
    return out


def random_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "b", "A", "é", "Éa", "x-y", "\x00", "🙂", "lorem", "ipsum"]
    return [(rng.choice(["en", "fr", None, "und", ""]),
             "".join(rng.choice(words) + rng.choice([" ", " ", "\t ", ". ", "\n", ",", "\x0b"])
                     for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("seed,chunk,held,longest", [(1, 1 << 20, 1 << 20, 3), (2, 300, 50, 3), (3, 100, 20, 4), (4, 1000, 10, 2)])
def test_equals_brute_force_in_any_chunks(spark, seed, chunk, held, longest):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = co.collocations(df, least=4, longest=longest, chunk=chunk, held=held)
    assert got.columns == COLS
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 4, longest)
    assert len(got) > 30


def test_clashing_hashes_change_nothing(spark, monkeypatch):
    # A full table: nothing is sieved, the exact counts decide.
    monkeypatch.setattr(co, "passes", lambda h, bits: h == h)
    rows = random_rows(7)
    texts = {g: [t for h, t in rows if (h or "und") == g] for g, _ in rows if g}
    data = "\n".join(texts["en"]).encode().lower().translate(co.BREAKS)
    every = [ok for *_, ok in co.phrases(b"en", data, 3, [None, None, None])]
    assert all(ok.all() for ok in every)


def test_sieve_keeps_all_frequent_hashes(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2 ** 63, 500).astype(np.uint64) >> np.uint64(6)  # range 0 of 64 and below
    c = rng.integers(1, 6, 1000).astype(np.uint8)
    two = np.concatenate([h, h])
    pdf = pd.DataFrame({"range": [0, 0], "hashes": [two[:700].tobytes(), two[700:].tobytes()],
                        "counts": [c[:700].tobytes(), c[700:].tobytes()]})
    got = co._frequent(6, 6)(pdf)
    size = 1 << (co.FILTER_LOG2 - 6)
    bits = np.unpackbits(np.frombuffer(got["bits"][0], np.uint8), bitorder="little")
    heavy = {int(x) for x, n in zip(h, c[:500].astype(int) + c[500:]) if n >= 6}
    assert got["n"][0] == len(heavy)
    assert {x >> (64 - co.FILTER_LOG2) & (size - 1) for x in heavy} == set(np.flatnonzero(bits).tolist())


def test_top_and_ties(spark):
    rows = [("en", "p q. r s. t u. v w")] * 5
    df = spark.createDataFrame(rows, "lang string, text string")
    got = [tuple(r) for r in co.collocations(df, least=5, top=3).collect()]
    assert sorted(got) == sorted(brute(rows, 5, 3, top=3))
    assert [r[2] for r in sorted(got)] == ["p q", "r s", "t u"]


def test_odd_tables(spark, tmp_dir):
    for i, clash in enumerate((False, True)):
        df = odd_docs(spark, clash)
        if clash:
            for c in ("rank", "phrase", "a", "l", "r", "n", "words", "range"):
                df = df.selectExpr("*", f"'x' AS {c}")
        rows = [(r["lang"], r["text"]) for r in df.collect()]
        got = co.query(spark, folder(spark, tmp_dir, f"t{i}", documents=df))
        assert {tuple(r) for r in got.collect()} == brute(rows, 10, 3)
    assert co.query(spark, folder(spark, tmp_dir, "none", documents=no_docs(spark))).collect() == []


def peak_mb(fn):
    tracemalloc.start()
    try:
        out = fn()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_task_holds_numbers_not_phrases():
    # All phrases pass: some 480,000 of one chunk.
    rng = random.Random(3)
    words = ["w%d" % i for i in range(20_000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 400), pa.array(texts)], names=["lang", "text"])
    full = SimpleNamespace(value=np.full((1 << co.FILTER_LOG2) // 8, 255, np.uint8))
    bounds = sorted({(b"en", b"w%d" % i) for i in range(2500, 20_000, 2500)})

    def run():
        got, rows = Counter(), 0
        for b in co._transducers(3, [full] * 3, bounds, 12 << 20, 1000)(iter([batch])):
            for r, a in zip(b.column("range").to_pylist(), b.column("automaton").to_pylist()):
                if r >= 0:
                    rows += 1
                    got[r] += int(wa.loads(a).rows()[1].sum())
        return got, rows

    (got, rows), mb = peak_mb(run)
    assert rows == len(got) == len(bounds) + 1
    assert sum(got.values()) == 400 * (400 + 399 + 398)
    assert mb < 80, mb


def test_union_reads_one_automaton_after_the_other():
    want = {(b"%d" % i, b"%d" % (i % 7), b"%d" % (i % 11)): i + 1 for i in range(2000)}
    data = wa.build(sorted(want.items())).dumps()
    got, mb = peak_mb(lambda: dict(wa.union(wa.loads(data) for _ in range(300))))
    assert got == {p: 300 * c for p, c in want.items()}
    assert mb < 50


def test_ranges_stay_small_whatever_lengths_the_phrases_have(spark, monkeypatch):
    # 30 words, 900 pairs, but 25,000 triples, most of them behind few pairs.
    monkeypatch.setattr(co, "RANGE_PHRASES", 1000)
    rng = random.Random(4)
    words = ["w%d" % i for i in range(30)]
    rows = [("en", " ".join(rng.choices(words, k=200))) for _ in range(600)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    counts, _, bounds = co.phrase_counts(df, 2, 3)
    sizes = [r["count"] for r in counts.filter("words IS NOT NULL").groupBy("range").count().collect()]
    assert sum(sizes) > 20_000 and len(sizes) == len(bounds) + 1
    assert max(sizes) < 3000


def test_language_names_may_hold_blanks(spark):
    rows = [(g, t) for g in ("e n", " ", "e") for t in ["a b c. a b", "b c"] * 5]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = {tuple(r) for r in co.collocations(df, least=5, held=4).collect()}
    assert got == brute(rows, 5, 3) and {g[0] for g in got} == {"e n", " ", "e"}


# ------------------------------------------------------------ automata
def random_phrases(seed, n=400):
    rng = random.Random(seed)
    ws = [b"a", b"ab", b"b", b"\xc3\xa9", b"", b"c"]
    return dict(sorted({tuple(rng.choice(ws) for _ in range(rng.randrange(1, 5))): rng.randrange(1, 4)
                        for _ in range(n)}.items()))


def test_automaton_gives_back_its_phrases():
    for seed in range(5):
        want = {p: c for p, c in random_phrases(seed).items() if all(p)}
        a = wa.build(want.items())
        assert dict(a) == want and list(dict(a)) == list(want)
        assert dict(wa.loads(a.dumps())) == want
    assert dict(wa.loads(wa.build([]).dumps())) == {}


def test_automaton_is_minimal():
    # Equal continuations are one state: two levels of 20 words with equal counts need 2 inner states.
    ws = [b"%02d" % i for i in range(20)]
    a = wa.build(sorted(((x, y, z), 1) for x in ws for y in ws for z in ws))
    assert len(a.states) == 3
    with pytest.raises(ValueError):
        wa.build([((b"b",), 1), ((b"a",), 1)])
    with pytest.raises(ValueError):
        wa.build([((b"b",), 1), ((b"b",), 1)])


def test_states_are_one_at_any_depth_and_if_all_hashes_clash(monkeypatch):
    # "b c", "c" behind "a b" and "c" at the start lead on alike.
    phrases = [((b"a", b"b", b"c"), 2), ((b"a", b"c"), 2), ((b"b", b"c"), 2), ((b"c", b"b", b"c"), 2), ((b"c", b"c"), 2)]
    want = wa.build(phrases)
    assert [len(s) for s in want.states] == [0, 1, 2] and dict(want) == dict(phrases)
    sets = [sorted((p, c) for p, c in random_phrases(s).items()) for s in range(3)]
    before = [wa.build(x) for x in sets]
    for name in "ABCD":
        monkeypatch.setattr(wa, name, np.uint64(0))
    for a, x in zip(before, sets):
        b = wa.build(x)
        assert list(b) == x and len(b.states) == len(a.states) == len(set(b.states))


def test_order_of_rows_too_wide_for_one_number():
    rng = np.random.default_rng(2)
    cols = [rng.integers(0, 2, 500).astype(np.int32) * (2 ** 31 - 1 - j) for j in range(3)]
    rows = list(zip(*[c.tolist() for c in cols]))
    assert [rows[i] for i in wa._order(cols).tolist()] == sorted(rows)


def test_union_sums_and_compose_looks_up():
    sets = [random_phrases(s) for s in range(4)]
    total = Counter()
    for s in sets:
        total.update(s)
    got = list(wa.union([wa.build(s.items()) for s in sets]))
    assert got == sorted(total.items())
    rng = random.Random(9)
    asked = sorted(set(rng.sample(sorted(total), 50)) | {(b"zz",), (b"a", b"zz"), (b"a",) * 9})
    found = wa.compose(wa.build((p, 1) for p in asked), wa.build(got))
    assert dict(found) == {p: total[p] for p in asked if p in total}
