import zlib

import numpy as np
import pytest
from llm_cases import SF, folder, no_docs, odd_docs

from evalspark.llm import op10_language_id as op


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = op.codewords(n, 7)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (1 if n == 2 else 2)


def test_a_wrong_bit_is_corrected():
    code = op.codewords(4, 7)
    model = op.Model(("a", "b", "c", "d"), code, None, None, np.ones(code.shape[1]), op.Settings())
    for i in range(4):
        for bit in range(code.shape[1]):
            margins = code[[i]].copy()
            margins[0, bit] *= -1
            best, p, gap = op.decode(margins, model)
            assert best[0] == i and gap[0] > 0
    _, _, gap = op.decode((code[[0]] + code[[1]]) / 2, model)
    assert gap[0] < op.Settings().ambiguous


def test_features_do_not_depend_on_the_block():
    text = "Größe und Straße, niño y señal. " * 40
    a = op.ngram_features(text, op.Settings())
    for block in (1, 2, 3, 7, 100):
        b = op.ngram_features(text, op.Settings(block=block))
        assert np.allclose(a, b, atol=1e-6)


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op.query(spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) > 0.97
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)


def test_many_languages():
    rng, s = np.random.default_rng(0), op.Settings(dims=256)
    langs = [f"l{i}" for i in range(12)]
    centre = {v: rng.random(256) for v in langs}
    y = [langs[i % 12] for i in range(360)]
    x = np.array([centre[v] + 0.2 * rng.random(256) for v in y])
    model = op.fit(x, y, s)
    best, _, _ = op.decode(x @ model.weights + model.bias, model)
    assert np.mean([langs.index(v) == model.languages.index(langs[b]) or model.languages[b] == v
                    for v, b in zip(y, best)]) > 0.98


@pytest.mark.parametrize("langs", [None, "en"])
def test_odd_rows(spark, tmp_dir, langs):
    from pyspark.sql import functions as F
    docs = odd_docs(spark).withColumn("lang", F.lit(langs).cast("string"))
    rows = op.query(spark, folder(spark, tmp_dir, documents=docs)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        t = texts[r["doc_id"]]
        known = langs and t and any(c.isalpha() for c in t)
        assert r["lang_pred"] == (langs if known else "und") and r["score"] == (1.0 if known else 0.0)
    assert op.query(spark, folder(spark, tmp_dir, "e", documents=no_docs(spark))).collect() == []
