import hashlib

import numpy as np
from llm_cases import SF, folder, no_docs, odd_docs

from evalspark.llm import op5_order_fingerprint as op
from evalspark.llm.order_minhash import binned_sketch, kmers, label, mix


def plain_sketch(items, k, bins_log2, picks):
    """One text's sketch, item by item."""
    h = [int(x) for x in kmers(np.array(items, dtype=np.uint32), k)]
    seen, bins = {}, {}
    g = [int(x) for x in label(np.array(h, dtype=np.uint64))]
    for i, x in enumerate(h):
        n = seen[x] = seen.get(x, -1) + 1
        want = int(mix(np.array([(x + n * 0x9E3779B97F4A7C15) % 2 ** 64], dtype=np.uint64))[0])
        assert g[i] == want
        bins.setdefault(g[i] >> (64 - bins_log2), []).append((g[i], i))
    out = []
    for b in range(1 << bins_log2):
        best = sorted(i for _, i in sorted(bins.get(b, []))[:picks])
        entry = np.zeros(1, dtype=np.uint64)
        for i in range(picks):
            item = np.uint64(h[best[i]] if i < len(best) else 0)
            entry = mix(entry * np.uint64(0x9E3779B97F4A7C15) + item)
        out.append(max(int(entry[0] >> np.uint64(32)), 1) if best else 0)
    return out


def test_sketch_matches_plain_definition():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3, 7, 8, 9, 40, 300, 3000):
        items = rng.integers(97, 97 + (3 if n % 2 else 26), size=n).astype(np.uint32)
        got = binned_sketch(kmers(items, 4), 4, 2)
        assert list(got) == plain_sketch(items, 4, 4, 2)


def test_order_matters_and_edits_lower_likeness():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), size=5)) for _ in range(120)]  # no word comes twice
    a, moved = " ".join(words), " ".join(reversed([" ".join(words[i:i + 6]) for i in range(0, 120, 6)]))
    s = lambda t: op.sketch(op._codes(t))
    close, far = a.replace(words[60], "idle"), "completely different words with nothing shared at all " * 12
    assert op.likeness(s(a), s(a)) == 1
    assert op.likeness(s(a), s(close)) > op.likeness(s(a), s(moved)) > op.likeness(s(a), s(far))


def check(rows, docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    assert len(rows) == len(docs)
    by = {r["doc_id"]: r for r in rows}
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = by[doc_id]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == op.fingerprint(text) and r["edited_fingerprint"] == op.fingerprint(edited)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_query_matches_neighbours_by_id(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = op.query(spark, SF).collect()
    check(rows, docs)
    assert np.mean([r["near_edited"] for r in rows]) > 0.05 + np.mean([r["near_next"] for r in rows])


def test_odd_rows(spark, tmp_dir):
    docs = odd_docs(spark).dropDuplicates(["doc_id"]).orderBy("doc_id")
    path = folder(spark, tmp_dir, documents=docs)
    check(op.query(spark, path).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert op.edited_pairs(odd_docs(spark)).count() == odd_docs(spark).count()  # repeated ids
    assert op.edited_pairs(no_docs(spark)).collect() == []
    alone = op.edited_pairs(no_docs(spark).unionByName(spark.createDataFrame(
        [(5, "abcdef", "en", "s", 6)], no_docs(spark).schema))).collect()
    check(alone, [(5, "abcdef")])
