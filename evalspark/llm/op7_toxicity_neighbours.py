"""Toxicity by the nearest labelled examples.

A text is a TF-IDF vector over every word of the examples, and over the word
beginnings that labelled rows tie to toxicity (a likelihood-ratio test).  Its
neighbours are found by exact cosine in a block-max inverted index, in which
every term of a text counts and blocks that cannot hold a neighbour are not
scored.  The neighbours vote, each by its similarity; an isotonic fit on leave-one-out
votes turns the vote into a probability.  The neighbours are returned as
evidence.

Learning reads at most ``Settings.per_class`` labelled rows of each label
(smallest hash of the id); that bounds the examples, and the index by their
whole texts' words.  A task builds it and writes it to the shared folder, and
tasks open it there.  Votes are weighted back to the labels' real shares.  Scoring reads
every whole text once, without a shuffle.  A text that is itself an example
finds itself, with its label; the calibration leaves each example out.

Null and empty texts, and texts that share no word with the examples, get the
rate of toxic rows among examples without a word.  Rows labelled null teach nothing; an id
labelled both ways counts as toxic; without any labels the score is 0.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import KEPT, crc_fold, materialise, small_arrow_batches, table
from evalspark.session import scratch_path, ship_package

QUERY = "op7_toxicity_neighbours"
_WORD = re.compile(r"[^\W_]+")
TEXTS = 128        # texts that are searched together
FIRST_BLOCKS = 6   # blocks of a text that are scored before any is skipped


@dataclass(frozen=True)
class Settings:
    per_class: int = 6000     # bound on labelled rows of each label that are learned from
    max_terms: int = 5000     # bound on the word beginnings of the index; words have none
    prefixes: tuple = (3, 4, 5, 6, 7, 8)  # lengths of word beginnings
    least_toxic: int = 4      # toxic examples a beginning needs
    least_g2: float = 20.0    # likelihood ratio a beginning needs
    least_share: float = 0.5  # of the rows with a beginning, by weight, that are toxic
    neighbours: int = 15
    block: int = 64           # examples of a block
    common: int = 16          # a term in one of so many examples is a dense row
    threshold: float = 0.7


def beginnings(word: str, s: Settings) -> list[str]:
    return [f"{word[:n]}*" for n in s.prefixes if len(word) > n]


def word_terms(word: str, telling: frozenset, s: Settings) -> list[int]:
    """Hashes of a word and of its telling beginnings."""
    import xxhash
    return [xxhash.xxh64_intdigest(t) for t in [word, *(p for p in beginnings(word, s) if p in telling)]]


def similar_first(common: np.ndarray, size: np.ndarray, rounds: int = 4, centres: int = 16) -> np.ndarray:
    """An order of the examples in which like ones stand together: by the nearest
    of a few centres over the common terms, then by the number of terms."""
    n = len(common)
    if n < 2 or not common.shape[1]:
        return np.argsort(size, kind="stable")
    middle = common[np.linspace(0, n - 1, min(centres, n)).astype(int)]
    for _ in range(rounds):
        near = (common @ middle.T).argmax(axis=1)
        for c in range(len(middle)):
            own = common[near == c]
            if len(own):
                total = own.sum(axis=0)
                middle[c] = total / max(float(np.sqrt(total @ total)), 1e-12)
    return np.lexsort((size, near))


class Index:
    """A block-max inverted index.

    Terms of few examples have posting lists, read whole.  The others have one
    row of weights per block of ``block`` like examples, and the greatest weight
    of each block.  A text's lists and those maxima bound what any example of a
    block can score.  The blocks of the highest bounds are scored first, and of
    the others those whose bound reaches the k-th best score so far.  ``save`` writes the arrays to a
    shared folder, one file each; tasks on a shared mount map them.
    """

    ARRAYS = ("terms", "idf", "ids", "toxic", "weight", "age", "row", "rows", "most", "example", "value", "start")

    def __init__(self, terms, idf: np.ndarray, vectors: list, ids: list, toxic: np.ndarray,
                 weight: np.ndarray, s: Settings, telling: frozenset = frozenset()):
        self.s, self.telling, self.memo, self.visited = s, telling, {}, [0, 0]
        self.terms, self.idf = terms, idf  # terms: sorted hashes
        count, size = len(vectors), np.array([len(t) for t, _ in vectors], dtype=np.int64)
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, dtype=np.int64)])
        value = np.concatenate([w for _, w in vectors] or [np.zeros(0, dtype=np.float32)]).astype(np.float32)
        example = np.repeat(np.arange(count, dtype=np.int32), size)
        often = np.bincount(term, minlength=len(terms))
        common = np.flatnonzero(often >= max(count / s.common, s.block))
        self.row = np.full(len(terms), -1, dtype=np.int32)
        self.row[common] = np.arange(len(common))
        held = self.row[term] >= 0
        dense = np.zeros((count, len(common)), dtype=np.float32)
        dense[example[held], self.row[term[held]]] = value[held]
        order = similar_first(dense, size)
        place = np.empty(count, dtype=np.int32)
        place[order] = np.arange(count)
        blocks = -(-count // s.block)
        self.rows = np.zeros((blocks, len(common), s.block), dtype=np.float32)
        for b in range(blocks):
            own = order[b * s.block:(b + 1) * s.block]
            self.rows[b, :, :len(own)] = dense[own].T
        del dense
        self.most = np.ascontiguousarray(self.rows.max(axis=2).T) if blocks else np.zeros((len(common), 0), np.float32)
        self.age = order                     # ties go to the example given first
        self.ids = np.array(ids, dtype=np.int64)[order]
        self.toxic = np.asarray(toxic, dtype=float)[order]
        self.weight = np.asarray(weight, dtype=float)[order]
        term, example, value = term[~held], place[example[~held]], value[~held]
        by = np.argsort(term, kind="stable")
        self.example, self.value = example[by], value[by]
        self.start = np.searchsorted(term[by], np.arange(len(terms) + 1))

    def save(self, folder: str) -> None:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        for name in self.ARRAYS:
            with store.open_output_stream(f"{base}/{name}.npy") as f:
                np.save(f, getattr(self, name))

    @classmethod
    def load(cls, folder: str, s: Settings, telling: frozenset) -> "Index":
        self = cls.__new__(cls)
        self.s, self.telling, self.memo, self.visited = s, telling, {}, [0, 0]
        store, base = _store(folder)
        for name in cls.ARRAYS:
            if isinstance(store, fs.LocalFileSystem):
                array = np.asarray(np.load(f"{base}/{name}.npy", mmap_mode="r"))
            else:
                with store.open_input_stream(f"{base}/{name}.npy") as f:
                    array = np.load(io.BytesIO(f.read()))
            setattr(self, name, array)
        return self

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Term numbers and weights of a text, at unit length; None without a term."""
        memo = self.memo
        if len(memo) > 600_000:
            memo.clear()
        found = Counter(_WORD.findall((text or "").lower()))
        terms = list(map(memo.get, found))
        if None in terms:
            new = [word for word, known in zip(found, terms) if known is None]
            own = [word_terms(word, self.telling, self.s) for word in new]
            h = np.array([t for o in own for t in o], dtype=np.uint64)
            at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
            at = iter(np.where(self.terms[at] == h, at, -1).tolist())
            for word, o in zip(new, own):
                memo[word] = tuple(t for t in (next(at) for _ in o) if t >= 0)
            terms = list(map(memo.get, found))
        size = np.fromiter(map(len, terms), np.int64, len(terms))
        if not size.sum():
            return None
        # Words may share a beginning: its counts add up.
        t, of = np.unique(np.fromiter(chain.from_iterable(terms), np.int64, int(size.sum())), return_inverse=True)
        n = np.bincount(of, np.repeat(np.fromiter(found.values(), np.int64, len(found)), size))
        return t, unit(n, self.idf[t])

    def _listed(self, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the terms with posting lists add to every example."""
        start = self.start[t]
        size = self.start[t + 1] - start
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)
        return np.bincount(self.example[where], self.value[where] * np.repeat(w, size),
                           minlength=len(self.rows) * self.s.block)

    def nearest_many(self, queries: list, skips: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text, numbers and cosines of its nearest examples, best first (exact).

        A block is scored for those texts only whose k-th best it can still reach."""
        blocks, common, width = self.rows.shape
        k, n = self.s.neighbours, len(queries)
        heavy = np.zeros((n, common), np.float32)
        score = np.zeros((n, blocks * width), np.float32)
        for i, (t, w) in enumerate(queries):
            row = self.row[t]
            dense = row >= 0
            heavy[i, row[dense]] = w[dense]
            score[i] = self._listed(t[~dense], w[~dense])
        cell = score.reshape(n, blocks, width)
        bound = cell.max(axis=2) + (heavy @ self.most) * (1 + 1e-5) + 1e-6
        seen = np.zeros((n, blocks), bool)
        kth = np.zeros(n, np.float32)

        def visit(want: np.ndarray) -> None:
            for b in np.flatnonzero(want.any(axis=0)):
                own = np.flatnonzero(want[:, b])
                cell[own, b] += heavy[own] @ self.rows[b]
            seen[want] = True
            if skips is not None:
                at = np.array(skips)
                hit = np.flatnonzero(at >= 0)
                score[hit, at[hit]] = 0

        if blocks and n:
            first = min(FIRST_BLOCKS, blocks)
            best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
            want = np.zeros((n, blocks), bool)
            np.put_along_axis(want, best, True, axis=1)
            visit(want)
            # The k-th best of these blocks: no block below it holds a neighbour.
            some = np.take_along_axis(cell, best[:, :, None], axis=1).reshape(n, -1)
            if some.shape[1] > k:
                kth = np.partition(some, -k, axis=1)[:, -k]
            # Rounding: a block that reaches it but for a hair is scored too.
            visit((bound > kth[:, None] - 1e-6) & (bound > 2e-6) & ~seen)
        self.visited[0] += int(seen.sum())
        self.visited[1] += n * blocks
        out = []
        for i in range(n):
            at = np.flatnonzero((score[i] >= kth[i]) & (score[i] > 0))
            at = at[seen[i, at // width] & (at < len(self.ids))]
            top = at[np.lexsort((self.age[at], -score[i, at]))[:k]]
            out.append((top, score[i, top].astype(float)))
        return out

    def nearest(self, query, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_many([query], [skip])[0]

    def vote(self, found) -> float:
        n, cosine = found
        if not len(n):
            return 0.0
        w = self.weight[n]
        return float((np.minimum(cosine, 1) * w * self.toxic[n]).sum() / w.sum())


def unit(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(n)) * idf
    return (w / np.sqrt(w @ w)).astype(np.float32)


def _store(folder: str):
    return (fs.LocalFileSystem(), folder) if "://" not in folder and not folder.startswith("file:") \
        else fs.FileSystem.from_uri(folder)


@dataclass
class Model:
    place: str | None  # folder of the index
    telling: frozenset
    steps: np.ndarray  # votes at which the score changes
    scores: np.ndarray
    base: float        # score without a known term
    settings: Settings

    @property
    def index(self) -> Index | None:
        """The index, opened once per process."""
        if self.place is None:
            return None
        if self.place not in KEPT:
            KEPT.clear()
            KEPT[self.place] = Index.load(self.place, self.settings, self.telling)
        return KEPT[self.place]

    def score(self, vote: float) -> float:
        i = int(np.searchsorted(self.steps, vote, side="right")) - 1
        return float(self.scores[max(i, 0)]) if len(self.scores) else self.base


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising step function by pooling adjacent violators; each pool is drawn
    towards ``prior`` by one example's weight."""
    pools: list = []
    for i in np.argsort(x, kind="stable"):
        if pools and pools[-1][0] == x[i]:
            pools[-1][1] += w[i] * y[i]
            pools[-1][2] += w[i]
        else:
            pools.append([x[i], w[i] * y[i], w[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, a, b = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += b
    unit = float(w.mean()) if len(w) else 1.0
    return (np.array([p[0] for p in pools]),
            np.array([(p[1] + unit * prior) / (p[2] + unit) for p in pools]))


def _sample(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[DataFrame, dict]:
    """Whole texts of the labelled rows that are learned from, copies once, and
    what each row of a label stands for."""
    marks = (labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id")
             .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
             .withColumn("_h", F.xxhash64("doc_id")))
    all_of = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [marks.filter(F.col("toxic") == y).orderBy("_h", "doc_id").limit(s.per_class) for y in (0, 1)]
    weight = {y: n / min(n, s.per_class) for y, n in all_of.items()}
    # At most 2 * per_class ids: a proven bound for the broadcast.
    ids = F.broadcast(picked[0].unionByName(picked[1]).select("doc_id", "toxic"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")
    rows = rows.groupBy(F.sha2("text", 256).alias("_text")).agg(
        F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    return rows, weight


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    s = settings
    ship_package(docs.sparkSession)
    small_arrow_batches(docs.sparkSession)
    rows, weight = _sample(docs, labels, s)
    rows = materialise(rows, "toxicity-sample")  # at most 2 * per_class texts

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for b in batches:
            by = [Counter(), Counter()]
            for text, y in zip(b["text"], b["toxic"]):
                own: set = set()
                for word in set(_WORD.findall(text.lower())):
                    if word not in known:
                        known[word] = beginnings(word, s)
                    own.update(known[word])
                by[y].update(own)
            frames = [pd.DataFrame({"term": list(c), "y": y, "n": list(c.values())}) for y, c in enumerate(by) if c]
            yield from frames

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    w1, w0 = weight.get(1, 1.0), weight.get(0, 1.0)
    prior = n1 * w1 / (n1 * w1 + n0 * w0) if n1 + n0 else 0.0
    if not n1 or not n0:
        return Model(None, frozenset(), np.zeros(0), np.zeros(0), prior, s)
    t, c = F.col("t"), F.col("c")
    # Likelihood ratio of the term's share of toxic rows against all rows'.
    share = n1 / (n1 + n0)
    part = lambda k, p: F.when(k > 0, k * F.log(k / ((t + c) * p))).otherwise(0.0)
    picked = (rows.select("text", "toxic").mapInPandas(tally, "term string, y int, n bigint").groupBy("term")
              .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"),
                   F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
              .filter((t >= s.least_toxic) & (t / (t + c) > share)
                      & (t * w1 >= s.least_share * (t * w1 + c * w0)))
              .withColumn("g2", 2 * (part(t, share) + part(c, 1 - share)))
              .filter(F.col("g2") >= s.least_g2)
              .orderBy(F.desc("g2"), "term").limit(s.max_terms).collect())
    telling = frozenset(r["term"] for r in picked)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for b in batches:
            t, n = [], []
            for text in b["text"]:
                own: Counter = Counter()
                for word, k in Counter(_WORD.findall(text.lower())).items():
                    if word not in known:
                        known[word] = word_terms(word, telling, s)
                    for h in known[word]:
                        own[h] += k
                t.append(np.array(list(own), dtype=np.uint64).tobytes())
                n.append(np.array(list(own.values()), dtype=np.int32).tobytes())
            yield b[["doc_id", "_text", "toxic"]].assign(t=t, n=n)

    place = scratch_path(docs.sparkSession, "toxicity-index")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Writes the index of all examples; their places in it (-1: no word)."""
        import uuid
        folder = f"{place}/{uuid.uuid4().hex}"  # a task that is run again writes another
        rows, own, size = [], [], []
        for b in batches:
            own += [np.frombuffer(t, dtype=np.uint64) for t in b["t"] if t]
            size += [np.frombuffer(n, dtype=np.int32) for n in b["n"] if n]
            rows.append(b[["doc_id", "_text", "toxic"]].assign(bare=[not t for t in b["t"]]))
        if not rows:
            return
        every = pd.concat(rows, ignore_index=True)
        some = every[~every["bare"]]
        if not len(some):
            yield every.assign(i=-1, folder=folder)[["_text", "toxic", "i", "folder"]]
            return
        terms, number, rows_of = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        idf = np.log((1 + n1 + n0) / (1 + rows_of)) + 1
        ends = np.cumsum([len(t) for t in own])[:-1]
        vectors = [(t, unit(n, idf[t])) for t, n in zip(np.split(number, ends), size)]
        del own, size
        y = some["toxic"].to_numpy()
        index = Index(terms, idf, vectors, some["doc_id"].tolist(), y, np.where(y == 1, w1, w0), s, telling)
        index.save(folder)
        at = np.full(len(every), -1, dtype=np.int64)
        at[some.index.to_numpy()[index.age]] = np.arange(len(some))
        yield every.assign(i=at, folder=folder)[["_text", "toxic", "i", "folder"]]

    # At most 2 * per_class examples: the terms are those of their texts, and one
    # task orders and blocks them.  The driver gets one narrow row an example.
    found = materialise(
        rows.mapInPandas(vectors, "doc_id bigint, _text string, toxic int, t binary, n binary")
        .repartition(1).sortWithinPartitions("doc_id", "_text")
        .mapInPandas(build, "_text string, toxic int, i int, folder string"), "toxicity-examples").collect()
    bare = [r["toxic"] for r in found if r["i"] < 0]
    base = (sum(bare) * w1 + prior) / (sum(bare) * w1 + (len(bare) - sum(bare)) * w0 + 1)
    if len(bare) == len(found):
        return Model(None, frozenset(), np.zeros(0), np.zeros(0), base, s)
    at = {r["_text"]: r["i"] for r in found if r["i"] >= 0}
    y = np.zeros(len(at), dtype=int)
    for r in found:
        if r["i"] >= 0:
            y[r["i"]] = r["toxic"]
    weights = np.where(y == 1, w1, w0)
    model = Model(found[0]["folder"], telling, np.zeros(0), np.zeros(0), base, s)

    def leave_one_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = model.index
        for b in batches:
            b = b[b["_text"].isin(at)]
            i = b["_text"].map(at)
            votes = []
            for f in range(0, len(b), TEXTS):
                found = index.nearest_many([index.vector(x) for x in b["text"][f:f + TEXTS]], i[f:f + TEXTS].tolist())
                votes += map(index.vote, found)
            yield pd.DataFrame({"i": i, "vote": votes})

    votes = np.zeros(len(y))
    for r in rows.select("_text", "text").mapInPandas(leave_one_out, "i int, vote double").collect():
        votes[r["i"]] = r["vote"]
    model.steps, model.scores = isotonic(votes, y, weights, prior)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_toxic``: score, predicted, evidence."""
    schema = ("score double, predicted int, "
              "evidence array<struct<doc_id: bigint, similarity: double, toxic: int>>")

    @F.pandas_udf(schema)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = model.index
        for texts in batches:
            out = []
            for f in range(0, len(texts), TEXTS):
                found = [index.vector(t) if index else None for t in texts[f:f + TEXTS]]
                near = iter(index.nearest_many([v for v in found if v is not None]) if index else ())
                for v in found:
                    if v is None:
                        out.append((model.base, int(model.base >= model.settings.threshold), []))
                        continue
                    n, cosine = next(near)
                    p = model.score(index.vote((n, cosine)))
                    out.append((p, int(p >= model.settings.threshold),
                                [{"doc_id": int(index.ids[i]), "similarity": min(1.0, float(c)),
                                  "toxic": int(index.toxic[i])} for i, c in zip(n, cosine)]))
            yield pd.DataFrame(out, columns=["score", "predicted", "evidence"])

    small_arrow_batches(docs.sparkSession)
    return docs.withColumn("_toxic", predict(F.col(text)))


def learn(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model of a folder: texts from ``docs``, labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").filter(crc_fold("doc_id", 3) != 1)
    return train(docs, labels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", crc_fold("doc_id", 3) == 1)
    return score(docs, learn(spark, docs, sf_dir)).select(
        "doc_id", "held_out", "_toxic.score", "_toxic.predicted", "_toxic.evidence")
