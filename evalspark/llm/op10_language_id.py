"""Language identification by error-correcting output codes.

Every language gets a binary codeword.  One linear classifier per bit, over
hashed character n-grams, predicts that bit; a text gets the language whose
codeword has the smallest loss, each bit weighted by how well it did on
training rows that did not fit it.  Two close losses mark the text ambiguous.

The classifiers are fitted on the driver from a bounded sample
(``Settings.sample_rows`` whole texts in total, chosen by a hash of the id);
the sample's n-gram counts, not its texts, travel there.  Scoring reads every
whole text once, without a shuffle.

Null texts and texts without a letter are ``und`` with score 0, as is every
text when no language could be learned.  Labels that are null teach nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import crc_fold, small_arrow_batches, table, unit_uniform

QUERY = "op10_language_id"
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    dims: int = 4096          # hashed n-gram features
    sample_rows: int = 2400   # bound on the rows that fit the classifiers, over all languages
    ridge: float = 0.02
    ambiguous: float = 0.15   # least gap of the two best probabilities
    block: int = 1 << 20      # characters counted at a time
    seed: int = 7


@dataclass(frozen=True)
class Model:
    languages: tuple
    codes: np.ndarray    # languages x bits, -1 or +1
    weights: np.ndarray  # dims x bits
    bias: np.ndarray     # bits
    trust: np.ndarray    # bits
    settings: Settings


def ngram_features(text: str, s: Settings) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-grams, at unit length."""
    counts = np.zeros(s.dims)
    text = text.lower()
    for at in range(0, len(text), s.block):
        back = min(at, 2)  # so that no n-gram is lost between blocks
        part = text[at - back:at + s.block]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        gram = code
        for n in range(3):
            if n:
                gram = gram[:-1] * np.uint64(0x9E3779B1) + code[n:]
            fresh = gram[max(0, back - n):]  # others end before this block and are counted
            mixed = (fresh + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % s.dims, minlength=s.dims)
    root = np.sqrt(counts)
    norm = np.sqrt(counts.sum())
    return (root / norm if norm else root).astype(np.float32)


def codewords(n: int, seed: int) -> np.ndarray:
    """One row per language: all two-way splits for up to five languages, else
    the best of a number of random codes by its least distance between rows."""
    if n <= 5:
        splits = [[1] + [1 - 2 * ((k >> i) & 1) for i in range(n - 1)] for k in range(1, 2 ** (n - 1))]
        return np.array(splits, dtype=np.float64).reshape(-1, n).T
    rng, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


def _ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares weights and bias, solved in the rows (fewer than columns)."""
    mean, base = x.mean(axis=0), y.mean(axis=0)
    xc, yc = x - mean, y - base
    gram = (xc @ xc.T).astype(np.float64)
    w = xc.T @ np.linalg.solve(gram + penalty * np.eye(len(x)), yc).astype(x.dtype)
    return w, base - mean @ w


def fit(x: np.ndarray, langs: list[str], s: Settings) -> Model | None:
    names = tuple(sorted(set(langs)))
    if not names:
        return None
    codes = codewords(len(names), s.seed)
    y = codes[[names.index(v) for v in langs]]
    if len(names) == 1:
        zero = np.zeros((s.dims, 0))
        return Model(names, codes, zero, np.zeros(0), np.zeros(0), s)
    half = np.random.default_rng(s.seed).permutation(len(x)) % 2 == 0
    right = np.zeros(codes.shape[1])
    for a, b in ((half, ~half), (~half, half)):
        if a.any() and b.any():
            w, c = _ridge(x[a], y[a], s.ridge)
            right += ((x[b] @ w + c) * y[b] > 0).mean(axis=0) / 2
    w, c = _ridge(x, y, s.ridge)
    return Model(names, codes, w.astype(np.float32), c, np.clip(right - 0.5, 0.01, 0.5) * 2, s)


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest codeword's index, its probability, and the gap to the next."""
    if len(model.languages) == 1:
        one = np.ones(len(margins))
        return np.zeros(len(margins), dtype=int), one, one
    loss = np.maximum(0, 1 - margins[:, None, :] * model.codes[None]) ** 2 @ model.trust
    p = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)) / model.trust.sum())
    p /= p.sum(axis=1, keepdims=True)
    order = np.sort(p, axis=1)
    return p.argmax(axis=1), order[:, -1], order[:, -1] - order[:, -2]


def _sample_features(docs: DataFrame, s: Settings) -> tuple[np.ndarray, list[str]]:
    """N-gram features of the sample: the same number of rows for each
    language, those with the smallest hash of their id."""
    spark = docs.sparkSession
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .orderBy("lang").limit(s.sample_rows).collect()}
    if not counts:
        return np.zeros((0, s.dims)), []
    each = max(1, s.sample_rows // len(counts))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.3 * each / n))])
    picked = (docs.withColumn("_u", unit_uniform(F.col("doc_id")))
              .filter(F.col("_u") < share[F.col("lang")]).select("lang", "_u", "text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = [bool(_LETTER.search(t)) for t in b["text"]]
            b = b[keep]
            yield pd.DataFrame({"lang": b["lang"], "u": b["_u"],
                                "x": [ngram_features(t, s).tobytes() for t in b["text"]]})

    small_arrow_batches(spark)
    # Bounded: about 1.3 * sample_rows rows of 4 * dims bytes.
    rows = (picked.mapInPandas(features, "lang string, u double, x binary")
            .orderBy("u", "lang").limit(2 * s.sample_rows).collect())
    taken: dict[str, int] = {}
    xs, langs = [], []
    for r in rows:
        if taken.get(r["lang"], 0) < each:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            xs.append(np.frombuffer(r["x"], dtype=np.float32))
            langs.append(r["lang"])
    return np.array(xs, dtype=np.float32).reshape(-1, s.dims), langs


def train(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on ``docs`` (doc_id, text, lang); rows without text or label teach nothing."""
    docs = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    return fit(*_sample_features(docs, settings), settings)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_lang``: lang_pred, score, ambiguous."""
    schema = "lang_pred string, score double, ambiguous boolean"

    @F.pandas_udf(schema)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n = len(texts)
            out = pd.DataFrame({"lang_pred": [UNKNOWN] * n, "score": [0.0] * n, "ambiguous": [True] * n})
            known = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)]
            if model is not None and known:
                margins = np.stack([ngram_features(texts.iloc[i], model.settings) @ model.weights
                                    for i in known]) + model.bias
                best, p, gap = decode(margins, model)
                out.iloc[known, 0] = [model.languages[i] for i in best]
                out.iloc[known, 1] = p
                out.iloc[known, 2] = gap < model.settings.ambiguous
            yield out

    small_arrow_batches(docs.sparkSession)
    return docs.withColumn("_lang", predict(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", crc_fold("doc_id", 4) == 2)
    model = train(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select(
        "doc_id", "held_out", "_lang.lang_pred", "_lang.score", "_lang.ambiguous")
