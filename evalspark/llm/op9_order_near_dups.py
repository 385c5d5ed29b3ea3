"""Near-duplicate documents by Order MinHash and banded alignment.

Words (lower-cased runs of letters and digits) form 5-word shingles with
occurrence numbers.  For each of 12 hash functions the four smallest labelled
shingles are put in text order, and every two of them, in that order, make a
bucket key: 72 keys a text.  In every bucket each text is
paired with one centre, the same text in all tables where possible, so a
bucket of any size gives one pair per member.  Members that do not match their
centre's class are paired again with a new centre among themselves, for
``Settings.rounds`` rounds.  Then every bucket that still holds texts of two
two classes, members of a centre's class among them, has all its pairs of different
classes tried.  In buckets of more than ``Settings.group`` texts this is done in
cells, of a block of members with itself and then, for classes that are still
apart, of two blocks: lower bounds of the edit distance (word counts,
in bins and in full) leave the pairs that can be links, these are aligned in the
cell, and only links that join two classes leave it, fewer than it has texts.  A
pair is a link when the edit distance of the two word sequences, found by a
bit-parallel alignment inside the band that the threshold allows, is at most
20 % of the longer one.  Classes are the
connected components of the links.

Equal word sequences are one text throughout, so copies are never expanded to
pairs.  A text without a word stands for itself as a whole (empty and null
texts are one class).  Of a class the smallest id is kept (null ids last,
equal ids: the first row).  Extra columns are ignored unless listed in
``carry``.  The candidate search is probabilistic: the more words differ, and
the more of a text stands in very many others, the likelier a pair shares no
bucket in which it is aligned (figures in the README).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import KEPT, materialise, small_arrow_batches, table
from evalspark.llm.components import add_links, connected_components
from evalspark.llm.order_minhash import kmers, label, mix

QUERY = "op9_order_near_dups"
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    tables: int = 12       # hash functions
    picks: int = 4         # smallest shingles of a function; every two make a key
    similarity: float = 0.8
    rounds: int = 3
    group: int = 32        # texts whose pairs are all aligned without a bound
    block: int = 2048      # texts of a larger bucket that one side of a cell holds, on average
    block_chars: int = 4_000_000  # and their characters
    bins: int = 128        # word counts of a text, for the bound


def words(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    return found or ([text.strip()] if text.strip() else [])


def smallest(values: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` smallest (distinct) values of each row, smallest first."""
    rows, n = values.shape
    if n > 16 * most:
        # Evenly spread 64-bit values: about three times as many as needed lie below this.
        low = values < np.uint64(3 * most / n * 2.0 ** 64)
        count = low.sum(axis=1)
        if (count >= most).all():
            r, c = np.nonzero(low)
            by = np.lexsort((values[r, c], r))
            return c[by[(np.cumsum(count) - count)[:, None] + np.arange(most)]]
    some = (np.argpartition(values, most - 1, axis=1)[:, :most] if most < n
            else np.tile(np.arange(most), (rows, 1)))
    return np.take_along_axis(some, np.argsort(np.take_along_axis(values, some, axis=1), axis=1), axis=1)


class Sketcher:
    """Bucket keys of texts in one worker."""

    def __init__(self, s: Settings):
        KEPT.clear()  # here, not in the shipped function, which holds copies of globals
        rng = np.random.default_rng(20)
        self.s = s
        self.salt = rng.integers(0, 2 ** 63, size=(s.tables, 1), dtype=np.uint64)
        self.odd = rng.integers(0, 2 ** 63, size=(s.tables, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.memo: dict = {}

    def hashes(self, tokens: list[str]) -> np.ndarray:
        import xxhash
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        for w in set(tokens).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, tokens), dtype=np.uint64, count=len(tokens))

    def keys(self, tokens: list[str]) -> np.ndarray:
        """64-bit keys, those of a table together; none for a text without a word."""
        h = kmers(self.hashes(tokens), self.s.shingle)
        if not len(h):
            return np.zeros(0, dtype=np.int64)
        g, most = label(h), min(self.s.picks, len(h))
        at = np.empty((self.s.tables, most), dtype=np.int64)
        step = max(1, 400_000 // len(h))
        for t in range(0, self.s.tables, step):
            at[t:t + step] = smallest((g[None] ^ self.salt[t:t + step]) * self.odd[t:t + step], most)

        def key(places) -> np.ndarray:
            out = self.salt[:, 0]
            for i in places:
                out = mix(out * np.uint64(3) + h[i])
            return out.view(np.int64)

        two = list(combinations(np.sort(at, axis=1).T, 2)) or [at.T]  # a lone shingle is a key by itself
        return np.stack([key(p) for p in two], axis=1).ravel()

    @staticmethod
    def identity(tokens: list[str]) -> bytes:
        import xxhash
        return xxhash.xxh3_128_digest(" ".join(tokens).encode("utf-8", "surrogatepass"))


def edit_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences, or ``most`` + 1 if it is larger.

    Hyyrö's bit-parallel recurrence over a band of 2 * most + 1 cells around the
    diagonal: the band slides one row down per step, and only its cells are held.
    """
    lead = 0
    for x, y in zip(a, b):
        if x != y:
            break
        lead += 1
    a, b = a[lead:], b[lead:]
    tail = 0
    for x, y in zip(reversed(a), reversed(b)):
        if x != y:
            break
        tail += 1
    if tail:
        a, b = a[:-tail], b[:-tail]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > most:
        return most + 1
    if not n:
        return m
    if most == 0:
        return 1  # something differs once the common ends are gone
    most = min(most, m)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    if sum(x not in where for x in b) > most:
        return most + 1
    width = 2 * most + 1
    full, half = (1 << width) - 1, 1 << most
    # Bit r of step j is row j - most + r; the diagonal is bit ``most``.
    up, down = full ^ (half - 1), 0
    distance = 0
    for j, y in enumerate(b):
        own = where.get(y, 0)
        shift = j - most
        hit = (own >> shift if shift >= 0 else own << -shift) & full
        flat = (((hit & up) + up) ^ up) | hit | down
        right_up = down | (full & ~(flat | up))
        right_down = flat & up
        if not flat & half:
            distance += 1  # the diagonal step costs an edit
            if distance > most + m - n:  # the way down can win back no more
                return most + 1
        low = (flat & full) >> 1
        up = right_down | (full & ~(low | right_up))
        down = low & right_up
        up &= full
    # From the diagonal's end down to the last row.
    for i in range(m - n):
        bit = 1 << (most + i)
        distance += bool(up & bit) - bool(down & bit)
    return min(distance, most + 1)


def similar(a: list, b: list, least: float) -> bool:
    longest = max(len(a), len(b))
    if a == b:
        return True
    most = int((1 - least) * longest + 1e-9)
    return edit_distance(a, b, most) <= most


def _verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose texts are similar.

    A centre is the ``b`` of many pairs, so its text is joined to narrow rows."""
    left = texts.select(F.col("text_id").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("text_id").alias("b"), F.col("text").alias("b_text"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            good = [similar(words(x), words(y), s.similarity) for x, y in zip(p["a_text"], p["b_text"])]
            yield p.loc[good, ["a", "b"]]

    return pairs.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text").mapInPandas(check, "a binary, b binary")


def _hashed(texts: DataFrame, s: Settings) -> DataFrame:
    """(text_id, tokens): the 64-bit hashes of a text's words, in order."""
    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Sketcher(s)
        for p in batches:
            yield pd.DataFrame({"text_id": p["text_id"], "tokens": [own.hashes(words(x)).tobytes() for x in p["text"]]})

    return texts.select("text_id", "text").mapInPandas(hashes, "text_id binary, tokens binary")


def _possible(n: np.ndarray, bags: np.ndarray, mine: np.ndarray, at: np.ndarray, lo: int, hi: int,
              s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the texts of possible links, slab by slab; see ``possible_pairs``."""
    coarse = bags.reshape(len(n), -1, 4).sum(axis=2)
    left, right = np.flatnonzero(at == lo), np.flatnonzero(at == hi)
    step = max(1, 32_768 // max(1, len(right)))
    for l0 in range(0, len(left), step):
        l = left[l0:l0 + step]
        most = ((1 - s.similarity) * np.maximum(n[l][:, None], n[right][None]) + 1e-9).astype(np.int64)
        may = (mine[l][:, None] != mine[right][None]) & (np.abs(n[l][:, None] - n[right][None]) <= most)
        if lo == hi:
            may &= l[:, None] < right[None]
        i, j = np.nonzero(may)
        good = np.abs(coarse[l[i]] - coarse[right[j]]).sum(axis=1) <= 2 * most[i, j]
        i, j = i[good], j[good]
        good = np.abs(bags[l[i]] - bags[right[j]]).sum(axis=1) <= 2 * most[i, j]
        yield l[i[good]], right[j[good]]


def possible_pairs(p: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """Pairs (a < b) of a cell, one of each block, of different classes that may
    be similar: an edit changes the number of words by at most one and the word
    counts by at most two in all."""
    ids, mine = p["text_id"].to_numpy(object), pd.factorize(p["mine"])[0]
    bags = np.frombuffer(b"".join(p["bag"]), dtype=np.uint16).reshape(len(p), s.bins).astype(np.int32)
    found = [(min(x, y), max(x, y)) for i, j in _possible(
        p["words"].to_numpy(np.int64), bags, mine, p["block"].to_numpy(), p["lo"].iat[0], p["hi"].iat[0], s)
        for x, y in zip(ids[i], ids[j])]
    return pd.DataFrame(list(dict.fromkeys(found)), columns=["a", "b"])


def cell_links(p: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """Links (a < b) that join the classes of a cell as all its links would: at
    most one fewer than it has classes.  Every pair of different classes, one of
    each block, is aligned unless word counts show it to be no link, a link
    found here has joined its classes, or it is the work of another bucket (the
    smallest that both texts are in)."""
    ids, mine, key = p["text_id"].to_numpy(object), pd.factorize(p["mine"])[0], p["key"].iat[0]
    tokens = [np.frombuffer(x, dtype=np.uint64) for x in p["tokens"]]
    buckets, shared = list(p["keys"]), {}
    bags = np.stack([np.minimum(np.bincount((x % np.uint64(s.bins)).astype(np.int64), minlength=s.bins), 65535)
                     for x in tokens]).astype(np.int32)
    up = list(range(mine.max() + 1))
    counts: dict[int, np.ndarray] = {}
    lists: dict[int, list] = {}

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    def once(made: dict, make, i: int):
        if i not in made:
            made[i] = make(tokens[i])
        return made[i]

    def here(i: int, j: int) -> bool:
        for k in (i, j):
            if k not in shared:
                shared[k] = frozenset(x for x in buckets[k] if x < key)
        return shared[i].isdisjoint(shared[j])

    found = []
    n = np.array([len(x) for x in tokens], dtype=np.int64)
    for left, right in _possible(n, bags, mine, p["block"].to_numpy(), p["lo"].iat[0], p["hi"].iat[0], s):
        for i, j in zip(left.tolist(), right.tolist()):
            x, y = root(mine[i]), root(mine[j])
            if x == y or not here(i, j):
                continue
            longest = max(n[i], n[j])
            both = np.concatenate([once(counts, label, i), once(counts, label, j)])
            both.sort()
            # An edit takes at most one word off those that the texts have in common.
            if (both[1:] == both[:-1]).sum() < longest - int((1 - s.similarity) * longest + 1e-9):
                continue
            if similar(once(lists, np.ndarray.tolist, i), once(lists, np.ndarray.tolist, j), s.similarity):
                up[x] = y
                found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pd.DataFrame(found, columns=["a", "b"])


def _blocks(n, chars, s: Settings):
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(n / s.block), F.ceil(chars / s.block_chars))


def _with_words(many: DataFrame, at, deal: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Members of large buckets with their words: text_id, mine, tokens, keys (all
    large buckets of the text) and the columns of ``at``, a row for each of its
    buckets in ``deal``.  A text's buckets travel together to its words."""
    many = (many.join(deal, "key", "left").groupBy("text_id", "mine")
            .agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("all").isNotNull(), at)).alias("at"))
            .filter(F.size("at") > 0))
    hashed = _hashed(texts.join(many.select("text_id"), "text_id", "left_semi"), s)
    return many.join(hashed, "text_id").select("text_id", "mine", "tokens", "keys", F.inline("at"))


def _own_cells(many: DataFrame, deal: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The cells of each block with itself: every member (key, text_id, mine) once."""
    return (_with_words(many, F.struct("key", "all"), deal, texts, s)
            .withColumn("block", F.pmod(F.xxhash64("text_id"), "all"))
            .select("key", F.col("block").alias("lo"), F.col("block").alias("hi"),
                    "block", "text_id", "mine", "tokens", "keys"))


def _cross_cells(many: DataFrame, deal: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The cells of two blocks, for buckets of several blocks that still hold two classes.

    Texts of one class are not paired, so the largest class of a bucket may have
    blocks of its own (below 0) that only meet blocks of the other members: where
    a bucket is one class and some strangers, its rows grow with its texts and
    the strangers are what is repeated.  A bucket is dealt this way or all alike,
    as in ``_own_cells``, whichever makes fewer rows.  Members of different
    classes throughout (a passage that unrelated texts share) meet block by block."""
    sizes = materialise(
        many.join(deal.filter("all > 1"), "key").join(texts.select("text_id", F.length("text").cast("bigint").alias("chars")), "text_id")
        .groupBy("key", "all", "mine").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")), "near-sizes")
    n, chars, main = F.col("n"), F.col("chars"), F.col("main")
    alike, split = n * (F.col("all") - 1), n * F.col("rest") + (n - main.n) * F.col("own")
    deal = materialise(
        sizes.groupBy("key", "all").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"),
                                        F.max(F.struct("n", "mine", "chars")).alias("main"))
        .filter(n > main.n)
        .withColumns({"own": _blocks(main.n, main.chars, s), "rest": _blocks(n - main.n, chars - main.chars, s)})
        .withColumn("split", split < alike)
        .select("key", "all", "split", main.mine.alias("main"),
                F.when(F.col("split"), F.col("own")).otherwise(F.lit(0)).alias("own"),
                F.when(F.col("split"), F.col("rest")).otherwise(F.col("all")).alias("rest")), "near-deal")
    at = F.struct("key", "split", (F.col("split") & (F.col("mine") == main)).alias("is_main"), "own", "rest")
    h = F.xxhash64("text_id")
    return (_with_words(many, at, deal, texts, s)
            .withColumn("block", F.when(F.col("is_main"), -1 - F.pmod(h, "own")).otherwise(F.pmod(h, "rest")))
            .withColumn("others", F.sequence(
                F.when(F.col("is_main"), F.lit(0).cast("bigint")).otherwise(-F.col("own")), F.col("rest") - 1))
            .withColumn("other", F.explode(F.expr("filter(others, o -> split or o <> block)")))
            .select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                    "block", "text_id", "mine", "tokens", "keys"))


def _rest(members: DataFrame, names: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a < b) of texts of different classes that stand in one bucket: all
    of them, but in buckets of more than ``s.group`` texts links only, as many
    as join the classes like all links would.  So the pairs grow with the
    buckets' texts, not with their square.

    In large buckets each block is tried with itself first, which takes every
    member once and joins most near copies; what is of different classes then
    is tried across blocks."""
    def mine(names: DataFrame) -> DataFrame:
        return names.select(F.col("node").alias("text_id"), F.col("component").alias("mine"))

    def classed(rows: DataFrame, names: DataFrame) -> DataFrame:
        return rows.join(mine(names), "text_id", "left").withColumn("mine", F.coalesce("mine", "text_id"))

    def cell(p: pd.DataFrame) -> pd.DataFrame:
        return cell_links(p, s)

    def links(cells: DataFrame) -> DataFrame:
        return materialise(cells.groupBy("key", "lo", "hi").applyInPandas(cell, "a binary, b binary"), "near-cells")

    left = materialise(classed(members.select("key", "text_id"), names), "near-members")
    groups = materialise(left.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("mine").alias("lo"), F.max("mine").alias("hi"))
        .filter("lo <> hi").select("key", "n"), "near-groups")
    left = materialise(left.join(groups, "key"), "near-members")
    few = left.filter(F.col("n") <= s.group)
    one = few.select("key", F.col("text_id").alias("a"), F.col("mine").alias("a_in"))
    two = few.select("key", F.col("text_id").alias("b"), F.col("mine").alias("b_in"))
    pairs = one.join(two, "key").filter("a < b and a_in <> b_in").select("a", "b")
    many = left.filter(F.col("n") > s.group).select("key", "text_id", "mine")
    deal = materialise(
        many.join(texts.select("text_id", F.length("text").cast("bigint").alias("chars")), "text_id")
        .groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
        .select("key", _blocks(F.col("n"), F.col("chars"), s).alias("all")), "near-deal")
    own = links(_own_cells(many, deal, texts, s))
    pairs = pairs.unionByName(own)
    if deal.filter("all > 1").limit(1).count():
        if own.limit(1).count():
            many = classed(many.drop("mine"), add_links(names, own))
        pairs = pairs.unionByName(links(_cross_cells(many, deal, texts, s)))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    carry: tuple = (), settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the ``carry`` columns, class_id (the
    class's smallest id), class_size and kept."""
    s = settings
    spark = docs.sparkSession
    small_arrow_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    extra = [F.col(c) for c in carry]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *extra,
                       text.alias("text"), F.xxhash64(text).alias("x"), F.hash(text).alias("y"))

    sketch = _sketch_udf(s)
    sketched = materialise(
        rows.withColumn("_s", sketch("text")).withColumn("row", F.monotonically_increasing_id())
        .select("doc_id", *carry, "x", "y", "row", "_s.text_id", "_s.keys"), "near-sketches")

    # Buckets with at least two texts, and their centre.
    texts_of = sketched.groupBy("text_id").agg(F.first("keys").alias("keys"))
    member = texts_of.select(F.explode("keys").alias("key"), "text_id")
    # Aggregates are written before they are joined: a join that stands alone
    # in its stage is one whose large partitions Spark can split.
    h = F.xxhash64("text_id")
    shared = materialise(member.groupBy("key").agg(F.min(h).alias("lo"), F.max(h).alias("hi"))
                         .filter("lo <> hi").select("key"), "near-shared")
    members = materialise(member.join(shared, "key"), "near-buckets")
    centre = materialise(members.groupBy("key").agg(F.min("text_id").alias("centre")), "near-centres")
    buckets = materialise(members.select("key", "text_id").join(centre, "key"), "near-buckets")

    needed = (sketched.groupBy("text_id").agg(F.min(F.struct("x", "y")).alias("at"))
              .join(members.select("text_id").distinct(), "text_id", "left_semi")
              .select("text_id", "at.x", "at.y"))
    texts = materialise(rows.select("x", "y", "text").join(needed, ["x", "y"])
                        .groupBy("text_id").agg(F.first("text").alias("text")), "near-texts")

    pairs = (buckets.filter("text_id <> centre")
             .select(F.col("text_id").alias("a"), F.col("centre").alias("b")).distinct())
    links = materialise(_verified(pairs, texts, s), "near-links")
    tried = materialise(pairs, "near-tried")
    names = materialise(connected_components(links), "near-names")
    for round_ in range(1, s.rounds):
        named = lambda c: F.coalesce(F.col(c), F.col("text_id"))
        # Members outside their centre's class look for a centre among themselves.
        mine = names.select(F.col("node").alias("text_id"), F.col("component").alias("mine"))
        its = names.select(F.col("node").alias("centre"), F.col("component").alias("its"))
        buckets = (buckets.join(mine, "text_id", "left").join(its, "centre", "left")
                   .withColumn("mine", named("mine")).withColumn("its", F.coalesce("its", "centre"))
                   .filter("mine <> its").select("key", "text_id", "mine"))
        order = F.struct(F.xxhash64("text_id", F.lit(round_)).alias("h"), F.col("text_id").alias("id"),
                         F.col("mine").alias("mine"))
        buckets = materialise(buckets, "near-strangers")
        fresh = materialise(buckets.groupBy("key").agg(F.min(order).alias("c")), "near-centres")
        buckets = materialise(buckets.join(fresh, "key").filter("text_id <> c.id")
                              .select("key", "text_id", F.col("c.id").alias("centre"),
                                      (F.col("mine") != F.col("c.mine")).alias("apart")), "near-buckets")
        pairs = (buckets.filter("apart").select(F.col("text_id").alias("a"), F.col("centre").alias("b"))
                 .distinct().join(tried, ["a", "b"], "left_anti"))
        pairs = materialise(pairs, "near-tried")
        new = materialise(_verified(pairs, texts, s), "near-links")
        buckets = buckets.drop("apart")
        tried = tried.unionByName(pairs)
        if new.limit(1).count():
            names = add_links(names, new)
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialise(_rest(members, names, texts, s).join(tried, ["a", "b"], "left_anti"), "near-rest")
    new = materialise(_verified(pairs, texts, s), "near-links")
    if new.limit(1).count():
        names = add_links(names, new)

    named = (sketched.select("doc_id", *carry, "row", "text_id")
             .join(names.withColumnRenamed("node", "text_id"), "text_id", "left")
             .withColumn("class", F.coalesce("component", "text_id")))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                     F.col("row").alias("row"))
    named = materialise(named, "near-named")
    classes = materialise(
        named.groupBy("class").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("class_size")),
        "near-classes")
    return (named.join(classes, "class", "left")
            .select("doc_id", *carry, F.col("first.id").alias("class_id"), "class_size",
                    (F.col("row") == F.col("first.row")).alias("kept")))


def _sketch_udf(s: Settings):
    @F.pandas_udf("text_id binary, keys array<bigint>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Sketcher(s)
        for texts in batches:
            tokens = [words(t) for t in texts]
            yield pd.DataFrame({"text_id": [own.identity(t) for t in tokens], "keys": [own.keys(t) for t in tokens]})

    return sketch


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
