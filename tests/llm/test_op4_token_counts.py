import random

import pytest
from llm_cases import SF, no_docs, odd_docs

from evalspark.llm import op4_token_counts as op


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=op.vocabulary())


def test_whole_tokens_are_proved(library):
    proof = op.prove(op.vocabulary())
    some = random.Random(1).sample(sorted(proof.whole), 500)
    assert all(len(x) == 1 for x in library.encode(some))
    assert proof.newline_splits and len(proof.whole) > 10_000


def test_counts_match_the_library(library):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(" \n\tabthein▁é.<s>0x1A") for _ in range(rnd.randint(0, 16))) for _ in range(4000)]
    texts += ["", " ", "  ", "\n", " \n ", "▁", "<s> </s> <unk>", "a" * 3000, " " * 50, "日本語 🙂\n🙂", "\x00"]
    assert op.Counter(op.prove(op.vocabulary())).batch(texts) == [len(x) for x in library.encode(texts)]


def test_memory_of_merged_words_is_bounded(monkeypatch, library):
    monkeypatch.setattr(op, "MAX_MEMO", 50)
    counter = op.Counter(op.prove(op.vocabulary()))
    rnd = random.Random(2)
    for _ in range(20):
        texts = [" ".join("".join(rnd.choice("qxzjv") for _ in range(6)) for _ in range(9)) for _ in range(9)]
        assert counter.batch(texts) == [len(x) for x in library.encode(texts)]


def test_query_and_odd_rows(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op.query(spark, SF).collect():
        n = len(library.encode(docs[r["doc_id"]]))
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 4096)
        assert r["n_bytes"] == len(docs[r["doc_id"]].encode())
    rows = op.count_tokens(odd_docs(spark), "text", op.vocabulary()).collect()
    assert all(r["n_tokens"] == len(library.encode(r["text"] or "")) for r in rows)
    assert op.count_tokens(no_docs(spark), "text", op.vocabulary()).collect() == []
