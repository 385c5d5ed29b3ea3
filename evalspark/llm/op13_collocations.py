"""Phrases whose words come together more often than apart, per language.

``collocations`` scores every phrase of 2 to ``longest`` words that occurs at
least ``least`` times (see :func:`query` for the formula).  Counts are exact.

1. A phrase as frequent as ``least`` has only parts as frequent.  So one pass
   per phrase length counts 64-bit hashes of the phrases whose parts passed
   before it, in ranges of hashes, and marks the frequent ones in a bit table
   of fixed size (``FILTER_LOG2``), which the next pass gets.  Clashes of hashes
   let more phrases pass, never fewer, and the exact counts follow.
2. Each task counts the phrases that pass every table, sorts them, and builds
   one count transducer per language and range of phrases as it goes
   (``count_automaton``).  Range bounds come from a sample of the phrases that
   pass; they decide about balance only.  There are as many ranges as the
   phrases that pass, and those that tasks hold, need for a range to stay small.
3. The transducers of a range are united, one after the other, and their weights
   summed; phrases below ``least`` go.
4. Parts of the phrases left are asked for once each: an acceptor of a range's
   asked parts is composed with the range's transducer.

Texts are lower-cased in A-Z only and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces
and at blanks and tabs into words.  Null texts count as empty, a null language
as ``und``, repeated rows each count.  A text longer than a chunk is cut between pieces.  An
empty table, or one without a frequent phrase, gives no rows.  Other columns
are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm import count_automaton as wa
from evalspark.llm.common import materialise, small_arrow_batches, table
from evalspark.session import ship_package

QUERY = "op13_collocations"
FILTER_LOG2 = 26          # bits of a table of frequent hashes: 8 MB
CHUNK = 12 << 20          # bytes of text counted at once
RANGE_ENTRIES = 1 << 20   # hashes of a range, at most about
PHRASES = 1 << 20         # phrases that a task holds before it builds transducers
SAMPLE = 1 << 13          # one of so many phrases is in the sample for the bounds of ranges
SAMPLED = 1 << 15         # phrases in the sample, at least about (or all), and twice as many at most
RANGE_PHRASES = 1 << 17   # different phrases of a range, at most about
RANGE_HELD = 1 << 22      # phrases of a range in all tasks' transducers, at most about
ROWS = 10_000             # rows that a task gives at once
BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# ------------------------------------------------------------ phrases of a chunk
def tokens(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different words in order, number of each word of the text, its piece) of
    normalised text: newlines and blanks are all that is between words."""
    raw = np.frombuffer(data, np.uint8)
    brk = raw == 10
    inside = ~(brk | (raw == 32))
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    if not len(starts):
        return [], np.zeros(0, np.int32), np.zeros(0, np.int32)
    piece = np.searchsorted(np.flatnonzero(brk), starts).astype(np.int32)
    wide = len(raw) >> 31
    offsets = np.zeros(len(starts) + 1, np.int64 if wide else np.int32)
    np.cumsum(stops - starts, out=offsets[1:])
    del brk, edge, starts, stops
    coded = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(piece),
                                  [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order).to_pylist(), rank[coded.indices.to_numpy()], piece


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(29))) * M1 + b * M2
    return h ^ (h >> np.uint64(32))


def passes(hashes: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    if bits is None:
        return np.ones(len(hashes), bool)
    at = hashes >> np.uint64(64 - FILTER_LOG2)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def phrases(lang: bytes, data: bytes, longest: int, filters: list):
    """For each length k up to ``longest``: (words, hashes, counts, first, last) of
    the different phrases whose parts pass, as numbers into the lists of length
    k-1 and 1, and whether they pass ``filters[k-1]`` themselves."""
    words, codes, piece = tokens(data)
    hashes = np.array([xxhash.xxh64_intdigest(lang + b"\0" + w) for w in words], np.uint64)
    counts = np.bincount(codes, minlength=len(words))
    ok = passes(hashes, filters[0] if filters else None)
    yield words, hashes, counts, None, None, ok
    number, live, first_hash, v = codes, ok[codes] if len(codes) else np.zeros(0, bool), hashes, max(1, len(words))
    for k in range(2, longest + 1):
        n = len(codes) - k + 1
        if n <= 0:
            return
        live = live[:n] & live[1:n + 1] & (piece[:n] == piece[k - 1:])
        at = np.flatnonzero(live).astype(np.int32)
        keys = number[at] * np.int64(v) + codes[at + (k - 1)]
        if k < longest:
            order = np.argsort(keys)
            keys = keys[order]
            new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
            number = np.zeros(n, np.int32)
            number[at[order]] = np.cumsum(new, dtype=np.int32) - np.int32(1)
            counts = np.diff(np.r_[np.flatnonzero(new), len(keys)])
            keys = keys[new]
            del order, new
        else:
            keys, counts = np.unique(keys, return_counts=True)
        first = (keys // v).astype(np.int32)
        last = (keys - first * np.int64(v)).astype(np.int32)
        del keys
        h = _mix(first_hash[first], hashes[last])
        ok = passes(h, filters[k - 1] if len(filters) >= k else None)
        yield words, h, counts, first, last, ok
        if k < longest:
            live = np.zeros(n, bool)
            live[at] = ok[number[at]]
            first_hash = h


def _normalised(text: bytes, limit: int) -> Iterator[bytes]:
    """The lower-cased text with every break as a newline, cut between pieces into
    parts of about ``limit`` bytes."""
    data = text.lower().translate(BREAKS)
    at = 0
    while len(data) - at > limit:
        cut = data.rfind(b"\n", at, at + limit)
        if cut < 0:
            cut = data.find(b"\n", at + limit)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut + 1
    yield data[at:]


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[bytes, bytes]]:
    """(language, text) of about ``limit`` bytes, of whole pieces."""
    held: dict[bytes, list[bytes]] = {}
    sizes: dict[bytes, int] = {}
    for b in batches:
        langs = b.column("lang").to_pylist()
        texts = b.column("text").cast(pa.binary()).to_pylist()
        for lang, text in zip(langs, texts):
            lang = lang.encode()
            for part in _normalised(text, limit):
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                if sizes[lang] >= limit:
                    yield lang, b"\n".join(held.pop(lang))
                    sizes.pop(lang)
        if sum(sizes.values()) >= 2 * limit:  # many languages
            for lang in list(held):
                yield lang, b"\n".join(held.pop(lang))
            sizes.clear()
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


# ------------------------------------------------------------ frequent hashes
def _hash_counts(k: int, ranges_log2: int, least: int, filters: list, sample: int, chunk: int):
    """Per chunk and range: hashes of the phrases of k words and their counts, held
    at ``least``; besides, the phrases of up to k words whose hash is below ``sample``."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [f.value for f in filters]
        for lang, data in _chunks(batches, chunk):
            names, parts = [], []
            for words, h, counts, first, last, ok in phrases(lang, data, k, tables):
                if sample:
                    low = np.flatnonzero(ok & (h < np.uint64(sample))).tolist()
                    names += [(-1 - len(parts), h[i].tobytes(), [lang, *_words([*parts, (words, h, first, last)], len(parts), i)])
                              for i in low]
                parts.append((words, h, first, last))
            rows = []
            if len(parts) == k:
                order = np.argsort(h)
                h, c = h[order], np.minimum(counts, least)[order].astype(np.uint8)
                cut = np.searchsorted(h >> np.uint64(64 - ranges_log2), np.arange((1 << ranges_log2) + 1))
                rows = [(int(r), h[cut[r]:cut[r + 1]].tobytes(), c[cut[r]:cut[r + 1]].tobytes(), None)
                        for r in np.flatnonzero(np.diff(cut))]
            rows += [(r, at, None, name) for r, at, name in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.binary()),
                 pa.array([r[3] for r in rows], pa.list_(pa.binary()))],
                names=["range", "hashes", "counts", "phrase"])
    return fn


def _words(parts: list, k: int, i: int) -> list[bytes]:
    """Words of the phrase numbered ``i`` of length k+1."""
    out = []
    while k > 0:
        words, _, first, last = parts[k]
        out.append(words[last[i]])
        i, k = first[i], k - 1
    out.append(parts[0][0][i])
    return out[::-1]


def _frequent(ranges_log2: int, least: int):
    """The part of the bit table that one range of hashes sets, and how many hashes
    are frequent, how many different ones and rows there are, and rows of frequent ones."""
    size = 1 << (FILTER_LOG2 - ranges_log2)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["hashes"]])
        c = np.concatenate([np.frombuffer(b, np.uint8) for b in pdf["counts"]]).astype(np.int64)
        order = np.argsort(h)
        h, c = h[order], c[order]
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        often = np.add.reduceat(c, head) >= least
        heavy = h[head][often]
        bits = np.zeros(size, np.uint8)
        bits[((heavy >> np.uint64(64 - FILTER_LOG2)) & np.uint64(size - 1)).astype(np.int64)] = 1
        return pd.DataFrame({"range": [int(pdf["range"].iloc[0])], "n": [len(heavy)], "different": [len(head)],
                             "held": [len(h)], "often": [int(np.diff(np.r_[head, len(h)])[often].sum())],
                             "bits": [np.packbits(bits, bitorder="little").tobytes()]})
    return fn


def _filter(counted: DataFrame, ranges_log2: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The bit table of frequent hashes (a fixed number of bytes), and about how many
    different phrases pass it, and how many phrases of all chunks."""
    got = (counted.filter("range >= 0").groupBy("range")
           .applyInPandas(_frequent(ranges_log2, least),
                          "range int, n bigint, different bigint, held bigint, often bigint, bits binary"))
    size = (1 << FILTER_LOG2) // 8
    out, n = np.zeros(size, np.uint8), np.zeros(4)
    part = size >> ranges_log2
    for r in got.collect():
        out[r["range"] * part:(r["range"] + 1) * part] = np.frombuffer(r["bits"], np.uint8)
        n += r["n"], r["different"], r["often"], r["held"]
    full = int(np.bitwise_count(out).sum(dtype=np.int64)) / (1 << FILTER_LOG2)
    return out, n[::2] + full * (n[1::2] - n[::2])


def _bounds(counted: DataFrame, bits: np.ndarray, longest: int, sample: int, passed: np.ndarray) -> list[tuple]:
    """Bounds between ranges of about equally many different phrases, and of equally
    many phrases of all chunks, from the sampled phrases that pass."""
    different, held = passed
    tasks = 2 * counted.sparkSession.sparkContext.defaultParallelism
    sample = min(sample, int(sample * 2 * SAMPLED / max(1.0, different * sample / 2 ** 64)))
    # Sampled hashes are the lowest, so the table's beginning has all their bits.
    low = bits[:(sample >> (64 - FILTER_LOG2 + 3)) + 1]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.array([int.from_bytes(x, "little") for x in b.column("hashes").to_pylist()], np.uint64)
            kept = h < np.uint64(sample)
            last = np.flatnonzero(kept & (b.column("range").to_numpy() == -longest))
            kept[last] = passes(h[last], low)
            yield b.filter(pa.array(kept)).select(["phrase"])

    names = counted.filter("range < 0").select("range", "hashes", "phrase").mapInArrow(fn, "phrase array<binary>")
    got = sorted((tuple(map(bytes, r[0])), r[1]) for r in names.groupBy("phrase").count().collect())
    if not got:
        return []
    bounds = set()
    for size, weight in ((max(different / RANGE_PHRASES, min(different / (1 << 14), tasks)), np.ones(len(got))),
                         (held / RANGE_HELD, np.array([n for _, n in got]))):
        upto = np.cumsum(weight)
        parts = int(size) + 1
        bounds |= {got[i][0] for i in np.searchsorted(upto, np.arange(1, parts) * (upto[-1] / parts)).tolist()}
    return sorted(bounds)


# ------------------------------------------------------------ transducers
class _Keys:
    """The rows of a language as keys, for ``bisect``."""

    def __init__(self, lang: bytes, words: list[bytes], cols: list[np.ndarray]):
        self.lang, self.words, self.cols = lang, words, cols

    def __len__(self) -> int:
        return len(self.cols[0])

    def __getitem__(self, i: int) -> tuple:
        return (self.lang, *[self.words[c[i] - 1] for c in self.cols if c[i]])


def _cut(lang: bytes, words: list[bytes], cols: list, counts: np.ndarray, bounds: list) -> Iterator[tuple]:
    """(range, columns, counts) of a language's phrases in order."""
    keys, lo = _Keys(lang, words, cols), bisect_left(bounds, (lang,))
    cuts = [0]
    for bound in bounds[lo:bisect_left(bounds, (lang + b"\0",))]:
        cuts.append(bisect_left(keys, bound, cuts[-1]))
    for r, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(counts)]), lo):
        if a < b:
            yield r, [c[a:b] for c in cols], counts[a:b]


def _passing(parts: list) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """(words, columns, counts) of the phrases of a chunk that pass."""
    at = [np.flatnonzero(ok) for *_, ok in parts]
    cols = [[] for _ in parts]
    for k, i in enumerate(at):
        for j in range(len(parts) - 1, k, -1):
            cols[j].append(np.zeros(len(i), np.int32))
        for j in range(k, 0, -1):
            _, first, last, _ = parts[j][1:]
            cols[j].append(last[i])
            i = first[i]
        cols[0].append(i)
    # Every word of a phrase that passes passes itself.
    number = np.zeros(len(parts[0][0]) + 1, np.int32)
    number[at[0] + 1] = np.arange(1, len(at[0]) + 1)
    words = [parts[0][0][i] for i in at[0].tolist()]
    cols = [np.concatenate([number[c + 1] if k >= j else c for k, c in enumerate(col)]) for j, col in enumerate(cols)]
    return words, cols, np.concatenate([counts[i] for (_, counts, *_), i in zip(parts, at)])


def _transducers(longest: int, filters: list, bounds: list, chunk: int, most: int):
    """Per task: count transducers of the phrases that pass, one per language and
    range, and the words of each language."""
    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for lang in sorted(held):
            words, cols, counts = held.pop(lang).sums()
            rows, size = [], 0
            for r, some, n in _cut(lang, words, cols, counts, bounds):
                rows.append((r, wa.of_rows(words, some, n).dumps(), lang.decode(), None))
                size += len(rows[-1][1])
                if size >= 1 << 22:
                    yield _rows(rows)
                    rows, size = [], 0
            yield _rows(rows)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [f.value for f in filters]
        held: dict = {}
        for lang, data in _chunks(batches, chunk):
            parts = [(words, counts, first, last, ok) for words, _, counts, first, last, ok in phrases(lang, data, longest, tables)]
            yield _rows([(-1, None, lang.decode(), int(parts[0][1].sum()))])
            found = _passing(parts)
            del parts, data
            if sum(s.rows for s in held.values()) + len(found[2]) > most:
                yield from flush(held)
            held.setdefault(lang, wa.Sums(np.inf)).add(*found)
            del found
            if sum(s.rows for s in held.values()) >= most:
                yield from flush(held)
        yield from flush(held)

    def _rows(rows: list) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.binary(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                          names=["range", "automaton", "lang", "words"])
    return fn


def _united(least: int):
    """Frequent phrases of one range and language, and their transducer."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = []

        def automata() -> Iterator[wa.Automaton]:
            for b in batches:
                group[:] = [b.column(c)[0].as_py() for c in ("range", "lang")]
                yield from (wa.loads(a.as_buffer()) for a in b.column("automaton"))

        words, cols, counts = wa.summed(automata())
        kept = np.flatnonzero(counts >= least)
        cols, counts = [c[kept] for c in cols], counts[kept]
        names = pa.array(words, pa.binary()).cast(pa.string())
        for at in range(0, len(counts), ROWS):
            rows = np.column_stack([c[at:at + ROWS] for c in cols])
            sizes = (rows > 0).sum(axis=1)
            texts = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), names.take(pa.array(rows[rows > 0] - 1)))
            yield _batch(*group, len(rows), texts, pa.array(counts[at:at + ROWS], pa.int64()), None)
        yield _batch(*group, 1, None, None, wa.of_rows(words, cols, counts).dumps())

    def _batch(r: int, lang: str, n: int, *columns) -> pa.RecordBatch:
        kinds = [pa.list_(pa.string()), pa.int64(), pa.binary()]
        columns = [c if isinstance(c, pa.Array) else pa.array([c], k) if c is not None else pa.nulls(n, k)
                   for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays([pa.array([r] * n, pa.int32()), pa.array([lang] * n, pa.string()), *columns],
                                          names=["range", "lang", "words", "f", "automaton"])
    return fn


def _looked_up(asked: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Counts of the asked parts of one range and language."""
    if not len(asked):
        return pd.DataFrame({"lang": [], "words": [], "f": []})
    keys = sorted(tuple(w.encode() for w in words) for words in asked["words"])
    found = list(wa.compose(wa.build((k, 1) for k in keys), wa.loads(counts["automaton"].iloc[0])))
    if len(found) != len(keys):
        raise RuntimeError("a part of a frequent phrase has no count")
    return pd.DataFrame({"lang": asked["lang"].iloc[0], "words": [[w.decode() for w in k] for k, _ in found],
                         "f": [c for _, c in found]})


# ------------------------------------------------------------ the operator
def _ranges_log2(entries: float) -> int:
    return int(min(FILTER_LOG2 - 3, max(6, np.ceil(np.log2(max(1.0, entries / RANGE_ENTRIES))))))


def phrase_counts(docs: DataFrame, least: int, longest: int, chunk: int = CHUNK, held: int = PHRASES):
    """(frequent phrases with their transducers, words per language, range bounds)."""
    spark = docs.sparkSession
    ship_package(spark)
    small_arrow_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = _ranges_log2(size / 4)
    # A word takes some 6 bytes.
    sample = int(2.0 ** 64 * min(1 - 2 ** -20, max(1 / SAMPLE, SAMPLED / max(1, size / 6))))
    filters, passed = [], np.zeros(2)
    bounds: list[tuple] = []
    for k in range(1, longest + 1):
        counted = rows.mapInArrow(_hash_counts(k, ranges, least, filters, sample if k == longest else 0, chunk),
                                  "range int, hashes binary, counts binary, phrase array<binary>")
        if k == longest:
            counted = materialise(counted, "phrase-hashes")
        bits, n = _filter(counted, ranges, least)
        passed += n
        if k == longest:
            bounds = _bounds(counted, bits, longest, sample, passed)
        filters.append(spark.sparkContext.broadcast(bits))
    shards = materialise(rows.mapInArrow(_transducers(longest, filters, bounds, chunk, held),
                                         "range int, automaton binary, lang string, words bigint"), "transducers")
    counts = materialise(shards.filter("range >= 0").select("range", "lang", "automaton").groupBy("range", "lang").applyInArrow(
        _united(least), "range int, lang string, words array<string>, f bigint, automaton binary"), "phrases")
    totals = shards.filter("range < 0").groupBy("lang").agg(F.sum("words").alias("n"))
    return counts, totals, bounds


def _range_of(bounds: list):
    @F.pandas_udf("int")
    def range_of(lang: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, (a.encode(), *[w.encode() for w in b])) for a, b in zip(lang, words)],
                         dtype="int32")
    return range_of


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int = 2000,
                 chunk: int = CHUNK, held: int = PHRASES) -> DataFrame:
    """Each language's first ``top`` phrases by score: lang, rank, phrase, a, l, r, n, score."""
    counts, totals, bounds = phrase_counts(docs, least, longest, chunk, held)
    found = counts.filter(F.col("words").isNotNull() & (F.size("words") >= 2)).select("lang", "words", F.col("f").alias("a"))
    # Phrases that a longer one contains, with the count of the most frequent such one.
    starts = F.sequence(F.lit(0), F.size("words") - 2)
    spans = F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(2), F.size("words") - i), lambda m: F.slice("words", i + 1, m))))
    inside = (found.select("lang", "a", F.size("words").alias("_m"), F.explode(spans).alias("part"))
              .filter(F.size("part") < F.col("_m"))
              .groupBy("lang", F.col("part").alias("words")).agg(F.max("a").alias("_longer")))
    left = (found.join(inside, ["lang", "words"], "left")
            .filter(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a"))).drop("_longer"))
    cuts = left.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = materialise(cuts.select("lang", "words", "a", "k", F.expr("slice(words, 1, k)").alias("_l"),
                                   F.expr("slice(words, k + 1, size(words))").alias("_r")), "phrase-cuts")
    asked = (cuts.select("lang", F.explode(F.array("_l", "_r")).alias("words")).distinct()
             .withColumn("range", _range_of(bounds)("lang", "words")))
    automata = counts.filter(F.col("automaton").isNotNull()).select("range", "lang", "automaton")
    parts = materialise(asked.groupBy("range", "lang").cogroup(automata.groupBy("range", "lang")).applyInPandas(
        _looked_up, "lang string, words array<string>, f bigint"), "phrase-parts")
    named = lambda c, out: parts.select("lang", F.col("words").alias(c), F.col("f").alias(out))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    best = (cuts.join(named("_l", "l"), ["lang", "_l"]).join(named("_r", "r"), ["lang", "_r"])
            .withColumns({"_a": wide("a"), "_lr": (wide("l") * wide("r")).cast("decimal(38,0)")})
            .withColumn("score", F.expr("cast(1000000 as decimal(7,0)) * _a * _a div _lr"))
            .groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("_b"))
            .select("lang", F.array_join("words", " ").alias("phrase"), "_b.*"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # The first of each of many parts of a language, then the first of those.
    part = Window.partitionBy("lang", "_part").orderBy(*order)
    some = (best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
            .withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top))
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
            .filter(F.col("rank") <= top).join(totals, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of a cut phrase: floor(1000000 a² / (l r)); its lowest cut counts."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, unnest([ws[i:i], ws[i:i + 1], ws[i:i + 2]][:len(ws) - i + 1]) AS g FROM i),
f AS MATERIALIZED (SELECT lang, len(g) AS k, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS f
  FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM i GROUP BY 1),
c AS (SELECT lang, k, phrase, g, f AS a FROM f WHERE k >= 2),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (
  SELECT lang, array_to_string(g[1:2], ' ') AS phrase, a FROM c WHERE k = 3
  UNION ALL SELECT lang, array_to_string(g[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside s USING (lang, phrase)
  WHERE k = 3 OR s.longer IS NULL OR 100 * s.longer < 50 * a),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, cut, l.f AS l, r.f AS r,
  (1000000::HUGEINT * cuts.a * cuts.a // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.k = cut AND l.phrase = array_to_string(cuts.g[1:cut], ' ')
  JOIN f r ON r.lang = cuts.lang AND r.k = cuts.k - cut AND r.phrase = array_to_string(cuts.g[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"""
