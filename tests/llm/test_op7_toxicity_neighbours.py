import random

import numpy as np
import pytest
from llm_cases import folder, no_docs, odd_docs

from evalspark.llm import op7_toxicity_neighbours as op


def labelled(n, seed=3):
    r = random.Random(seed)
    plain = ["".join(r.choice("aeinrst") for _ in range(r.randint(3, 8))) for _ in range(300)]
    bad = ["blergh", "snark", "vexor", "grumblo", "grumbla", "grumbli"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [r.choice(plain) for _ in range(r.randint(15, 60))]
        if toxic:
            for w in r.sample(bad, 3):
                words.insert(r.randrange(len(words)), w)
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def setting(spark, tmp_path_factory):
    docs, labels = labelled(600)
    d = spark.createDataFrame(docs, no_docs(spark).schema)
    y = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return folder(spark, str(tmp_path_factory.mktemp("tox")), documents=d, labels=y), docs, labels


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    terms = {f"t{i}": i for i in range(40)}
    s = op.Settings(block=8, neighbours=5)
    vectors = []
    for _ in range(150):
        t = np.sort(rng.choice(40, size=rng.integers(1, 8), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, (w / np.sqrt(w @ w)).astype(np.float32)))
    index = op.Index(terms, np.ones(40), vectors, list(range(150)), np.zeros(150), np.ones(150), s)
    assert sorted(index.ids.tolist()) == list(range(150))
    dense = np.zeros((150, 40))
    for row, i in enumerate(index.ids):
        dense[row, vectors[i][0]] = vectors[i][1]
    for t, w in vectors[:40]:
        cosine = dense[:, t] @ w
        n, got = index.nearest((t, w))
        want = np.sort(cosine[cosine > 0])[::-1][:5]
        assert np.allclose(got, want, atol=1e-6) and np.allclose(cosine[n], got, atol=1e-6)


def test_blocks_below_the_kth_best_are_not_scored(tmp_dir):
    """Examples of six kinds that share no common term: other kinds' blocks are skipped, nothing is lost."""
    rng = np.random.default_rng(2)
    s = op.Settings(block=16, neighbours=5, common=10_000)
    vectors = []
    for i in range(600):
        t = np.sort(rng.choice(30, size=8, replace=False)) + 30 * (i % 6)
        w = rng.random(8) + 0.1
        vectors.append((t, (w / np.sqrt(w @ w)).astype(np.float32)))
    built = op.Index(np.arange(180, dtype=np.uint64), np.ones(180), vectors, list(range(600)), np.zeros(600), np.ones(600), s)
    assert (built.row >= 0).all()  # every term has block maxima
    built.save(tmp_dir)
    index = op.Index.load(tmp_dir, s, frozenset())
    dense = np.zeros((600, 180))
    for row, i in enumerate(index.ids):
        dense[row, vectors[i][0]] = vectors[i][1]
    for t, w in vectors[:60]:
        for skip in (-1, 7):
            cosine = dense[:, t] @ w
            if skip >= 0:
                cosine[skip] = 0
            n, got = index.nearest((t, w), skip)
            assert np.allclose(got, np.sort(cosine)[::-1][:5], atol=1e-6) and np.allclose(cosine[n], got, atol=1e-6)
            assert skip not in n
    assert index.visited[0] < 0.5 * index.visited[1]


def test_isotonic_rises_and_pools():
    x, y = np.array([0.1, 0.2, 0.2, 0.3, 0.9]), np.array([0, 1, 0, 0, 1])
    steps, scores = op.isotonic(x, y, np.ones(5), 0.5)
    assert (np.diff(scores) >= 0).all() and len(steps) < 5 and 0 < scores[0] < scores[-1] < 1


def test_held_out_accuracy_and_evidence(spark, setting):
    path, _, labels = setting
    toxic = {i: t for i, _, t in labels}
    rows = op.query(spark, path).collect()
    assert len(rows) == len(labels)
    held = [r for r in rows if r["held_out"]]
    import zlib
    assert {r["doc_id"] for r in held} == {i for i in toxic if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) > 0.97
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert all(zlib.crc32(str(e["doc_id"]).encode()) % 3 != 1 for e in r["evidence"])


def test_labels_of_the_held_out_fold_teach_nothing(spark, setting, tmp_dir):
    import zlib
    path, docs, labels = setting
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    other = folder(spark, tmp_dir, documents=spark.read.parquet(path + "/documents.parquet"),
                   labels=spark.createDataFrame(flipped, "doc_id bigint, quality int, toxic int"))
    a, b = ({r["doc_id"]: r["score"] for r in op.query(spark, p).collect()} for p in (path, other))
    assert a == b


def test_odd_rows(spark, tmp_dir, setting):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (4, 0, None), (99, 1, 0)], none.schema)
    for name, labels in (("n", none), ("s", some)):
        rows = op.query(spark, folder(spark, tmp_dir, name, documents=docs, labels=labels)).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert op.query(spark, folder(spark, tmp_dir, "e", documents=no_docs(spark), labels=some)).collect() == []
    model = op.learn(spark, spark.read.parquet(setting[0] + "/documents.parquet"), setting[0])
    rows = op.score(docs, model).select("text", "_toxic.*").collect()
    bare = {r["score"] for r in rows if not r["text"]}
    assert bare == {model.base} and model.base < 0.7


def test_texts_without_a_telling_term_are_searched(spark, setting):
    path, docs, labels = setting
    more = [(1000 + i, f"zorb{'abcdefgh'[i]}x quill{'hgfedcba'[i]}y mist{'abcdefgh'[i]}z", "en", "s", 0) for i in range(8)]
    frame = spark.createDataFrame(docs + more, no_docs(spark).schema)
    y = spark.createDataFrame(labels + [(i, 1, 1) for i, *_ in more], "doc_id bigint, quality int, toxic int")
    model = op.train(frame, y)
    rows = op.score(spark.createDataFrame(more, frame.schema), model).select("doc_id", "_toxic.*").collect()
    for r in rows:  # a copy of a labelled toxic text finds it and is rejected
        assert r["evidence"][0]["doc_id"] == r["doc_id"] and r["evidence"][0]["similarity"] > 0.999
        assert r["predicted"] == 1
    # Exact cosine over all words, against a dense computation.
    n, cosine = model.index.nearest(model.index.vector(docs[1][1]))
    words = lambda x: op.Counter(op._WORD.findall(x.lower()))
    df = op.Counter(w for d in docs + more for w in words(d[1]))
    assert set(model.index.terms.tolist()) >= {op.word_terms(w, frozenset(), model.settings)[0] for w in df}
    assert docs[1][0] == model.index.ids[n[0]] and len(n) == model.settings.neighbours
    text = dict((d[0], d[1]) for d in docs + more)
    whole = np.zeros((len(model.index.ids), len(model.index.terms)))
    for i, d in enumerate(model.index.ids.tolist()):
        t, w = model.index.vector(text[d])
        whole[i, t] = w
    for d in (docs[1], docs[4], more[2]):
        t, w = model.index.vector(d[1])
        want = np.sort(whole[:, t] @ w)[::-1][:model.settings.neighbours]
        n, cosine = model.index.nearest((t, w))
        assert np.allclose(cosine, want[want > 0], atol=1e-5)
        # The score is the calibrated vote of these neighbours.
        vote = (cosine * model.index.weight[n] * model.index.toxic[n]).sum() / model.index.weight[n].sum()
        row = op.score(spark.createDataFrame([d], frame.schema), model).select("_toxic.*").first()
        assert abs(row["score"] - model.score(vote)) < 1e-9
        assert [e["doc_id"] for e in row["evidence"]] == model.index.ids[n].tolist()
