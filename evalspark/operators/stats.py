"""Curation statistics (G1–G6): canonical answers, spread, agreement, bootstrap.

One bootstrap definition holds at every group size.  The values of a group are
ranked and cut into chunks of ``CHUNK_ROWS`` ranks; a replicate's ``n`` draws
first fall to chunks (a binomial at each node of a binary tree over the
chunks, so every chunk finds its own share and the draws below it without
hearing from the others), then to ranks within the chunk.  Chunks are the unit
of work: a group of any size is never in one task, and its chunks only hand
over one sum and at most two order statistics per replicate.  A group of one
chunk draws ranks directly: draw ``i`` of replicate ``b`` in group ``g`` is an
integer mix of (md5 seed of ``g``, ``b``, ``i``) modulo ``n``, which an SQL
oracle recomputes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.text import first_number, split_answers
from evalspark.operators.ordinals import group_ordinal
from evalspark.session import cut_lineage, ship_package

CHUNK_ROWS = 4096
SPLITS = 1024           # steps of a range in one round of rank selection
WHOLE_GROUP = 100_000   # rows of a group whose counted values are one aggregate


def salted(values: DataFrame) -> DataFrame:
    """Add ``_salt``, which tells equal values apart, so that a value held by
    most rows is ranked by many tasks and not by one."""
    return values.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))


def canonical_answers(bank: DataFrame, keys: list[str] | None = None,
                      answer: str = "expected_answer") -> DataFrame:
    """G1: expected answers split on ``;`` and stripped, one list per question.

    The reference explodes and regroups; a per-row ``transform(split(..))``
    gives the same lists with no shuffle.
    """
    keys = keys or ["question_ref", "map_count", "spatial_relationship", "answer_type"]
    return bank.select(*keys, split_answers(answer).alias(answer))


def _answer_values(ann: DataFrame, key: str, answer: str) -> DataFrame:
    a = F.col(answer)
    usable = a.isNotNull() & (a != "None") & (a != "")
    return (ann.filter(usable).select(key, first_number(a).alias("x"))
            .filter(F.col("x").isNotNull()).withColumn("is_expected", F.lit(False)))


def spread_values(bank: DataFrame, ann: DataFrame, key: str = "question_ref",
                  answer: str = "answer", expected: str = "expected_answer") -> DataFrame:
    """Annotator numbers plus the expected value appended (one row each)."""
    exp = (bank.select(key, first_number(F.col(expected)).alias("x"))
           .filter(F.col("x").isNotNull()).withColumn("is_expected", F.lit(True)))
    vals = _answer_values(ann, key, answer).join(bank.select(key).distinct(), key, "left_semi")
    return vals.unionByName(exp)


def select_ranks(values: DataFrame, wanted: DataFrame, key: str, x: str = "x") -> DataFrame:
    """(``key``, ``rank``, ``x``): the values at the 1-based ``wanted`` (key, rank) among a key's values.

    Equal values are counted first (combined on the map side).  Then every
    wanted rank is narrowed down: the counts between its bounds fall in
    ``SPLITS`` equal steps, and the step that holds the rank gives the next
    bounds, until they meet.  No value is sorted, a round shuffles at most
    ``SPLITS`` sums per rank and task, and a key or a value may have any number of rows.
    """
    counts = cut_lineage(values.groupBy(key, x).agg(F.count(F.lit(1)).alias("_c")))
    ends = counts.groupBy(key).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    open_ = wanted.select(key, "rank", F.lit(0).cast("bigint").alias("_before")).join(ends, key)
    found = None
    while True:
        # Halves keep the range of any two doubles finite.
        step = F.floor((F.col(x) / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * SPLITS)
        steps = (counts.join(open_, key).filter(F.col(x).between(F.col("_lo"), F.col("_hi")))
                 .withColumn("_s", F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(F.least(F.lit(SPLITS - 1), step)))
                 .groupBy(key, "rank", "_before", "_s")
                 .agg(F.sum("_c").alias("_c"), F.min(x).alias("_lo"), F.max(x).alias("_hi")))
        upto = F.sum("_c").over(Window.partitionBy(key, "rank").orderBy("_s"))
        open_ = cut_lineage(
            steps.withColumn("_upto", F.col("_before") + upto)
            .filter((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_c")))
            .select(key, "rank", (F.col("_upto") - F.col("_c")).alias("_before"), "_lo", "_hi"))
        done = open_.filter("_lo = _hi").select(key, "rank", F.col("_lo").alias(x))
        found = done if found is None else found.unionByName(done)
        open_ = open_.filter("_lo < _hi")
        if open_.isEmpty():
            return found


def exact_median(values: DataFrame, key: str, x: str = "x", sizes: DataFrame | None = None,
                 whole: int = WHOLE_GROUP) -> DataFrame:
    """Exact per-group median (mean of the two middle values for even n).

    Groups of at most ``whole`` rows are one aggregate over their counted
    values; larger ones find their middle ranks by :func:`select_ranks`.
    ``sizes`` (key, n) saves counting them.
    """
    values = values.select(key, x)
    sizes = cut_lineage(values.groupBy(key).agg(F.count(F.lit(1)).alias("n"))) if sizes is None else sizes.select(key, "n")
    large = sizes.filter(F.col("n") > whole)
    if large.isEmpty():
        return values.groupBy(key).agg(F.percentile(x, F.lit(0.5)).alias("median"))
    large = cut_lineage(large)
    small = (values.join(large, key, "left_anti").groupBy(key).agg(F.percentile(x, F.lit(0.5)).alias("median")))
    middle = large.select(key, F.explode(F.array_distinct(F.array(
        F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)))).alias("rank"))
    picked = select_ranks(values.join(large.select(key), key, "left_semi"), middle, key, x)
    return small.unionByName(picked.groupBy(key).agg(F.avg(x).alias("median")))


def annotator_spread(bank: DataFrame, ann: DataFrame, key: str = "question_ref",
                     answer: str = "answer", expected: str = "expected_answer") -> DataFrame:
    """Per question n, mean, median, sample std (ddof=1), expected value.

    "None"/empty answers are skipped; n < 2 gives a null std (D13).  Moments
    are one grouped aggregation (map-side partial aggregation); the median is
    exact and distributed (:func:`exact_median`).
    """
    v = spread_values(bank, ann, key, answer, expected)
    moments = [F.count(F.lit(1)).alias("n"),
               F.round(F.avg("x"), 6).alias("mean"),
               F.round(F.stddev_samp("x"), 6).alias("std"),
               F.max(F.when(F.col("is_expected"), F.col("x"))).alias("expected_value")]
    # Rows per question, from the key column alone, bound what one aggregate holds.
    rows = ann.select(key).unionByName(bank.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if (rows.agg(F.max("n")).first()[0] or 0) <= WHOLE_GROUP:
        out = v.groupBy(key).agg(*moments, F.round(F.percentile("x", F.lit(0.5)), 6).alias("median")) \
            .filter(F.col(key).isNotNull())
    else:
        stats = cut_lineage(v.groupBy(key).agg(*moments))
        out = stats.join(exact_median(v, key, "x", stats).select(key, F.round("median", 6).alias("median")), key)
    return out.select(key, "n", "mean", "median", "std", "expected_value")


def spread_rows(bank: DataFrame, ann: DataFrame, key: str = "question_ref",
                answer: str = "answer", expected: str = "expected_answer") -> DataFrame:
    """G2, one row per value: every annotator number (and the expected one) of a
    question beside the question's statistics."""
    values = spread_values(bank, ann, key, answer, expected)
    # One row per question on the right: AQE can split a question of many values.
    return values.join(annotator_spread(bank, ann, key, answer, expected), key, "left")


def flag_spread_outliers(bank: DataFrame, ann: DataFrame, key: str = "question_ref",
                         answer: str = "answer", expected: str = "expected_answer",
                         k: float = 1.0) -> DataFrame:
    """Any value outside ``expected ± k·std`` (the reference's intent, D13)."""
    v = spread_values(bank, ann, key, answer, expected)
    st = v.groupBy(key).agg(F.stddev_samp("x").alias("_std"),
                            F.max(F.when(F.col("is_expected"), F.col("x"))).alias("_e"))
    j = v.join(st, key, "inner")  # one row per key: AQE broadcasts it from measured size
    out = F.abs(F.col("x") - F.col("_e")) > F.lit(k) * F.col("_std")
    return j.groupBy(key).agg(F.coalesce(F.bool_or(out), F.lit(False)).cast("int").alias("has_outlier"))


def annotation_agreement(scored: DataFrame, key: str = "question_ref",
                         correct: str = "correct") -> DataFrame:
    """Annotators agreeing with the expected answer and the tier."""
    c = F.coalesce(F.col(correct), F.lit(0))
    agg = scored.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(c).cast("bigint").alias("n_agree"))
    tier = (F.when(F.col("n_agree") == F.col("n"), F.lit("all"))
            .when(F.col("n_agree") > 0, F.lit("partial")).otherwise(F.lit("none")))
    return agg.withColumn("tier", tier)


# --------------------------------------------------------------- bootstrap
# Fixed values of the draw function (any change alters every replicate).
MIX_MOD = 2 ** 31
MIX_B, MIX_I = 1_000_003, 7_919
MIX_A1, MIX_C1 = 1_103_515_245, 12_345
MIX_A2, MIX_C2 = 1_664_525, 1_013_904_223


def group_seed(g) -> int:
    """Per-group seed: first 8 hex digits of md5 of the key's text."""
    import hashlib
    return int(hashlib.md5(str(g).encode("utf-8")).hexdigest()[:8], 16)


def draw_indices(seed: int, b: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    """0-based draw ``i`` of replicate ``b`` (broadcast arrays) in a group of ``n``.

    Integer mixing with every product below 2**62, so numpy, Spark SQL and
    DuckDB compute identical indices (see the oracle).
    """
    x = (np.int64(seed) + b.astype(np.int64) * MIX_B + i.astype(np.int64) * MIX_I) % MIX_MOD
    x = (x * MIX_A1 + MIX_C1) % MIX_MOD
    x = x ^ (x >> 13)
    x = (x * MIX_A2 + MIX_C2) % MIX_MOD
    x = x ^ (x >> 17)
    return x % n


def chunk_draws(seed: int, n: int, chunk: int, at: int, n_boot: int) -> tuple[np.ndarray, np.ndarray]:
    """Per replicate: the draws below chunk ``at`` and those in it, of the ``n``
    draws over ``ceil(n / chunk)`` chunks."""
    lo, hi = 0, -(-n // chunk)
    below, here = np.zeros(n_boot, dtype=np.int64), np.full(n_boot, n, dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, both = mid * chunk - lo * chunk, min(n, hi * chunk) - lo * chunk
        drawn = np.random.default_rng([seed, lo, hi]).binomial(here, left / both)
        if at < mid:
            here, hi = drawn, mid
        else:
            below, here, lo = below + drawn, here - drawn, mid
    return below, here


def chunk_sums(values: np.ndarray, seed: int, n: int, below: np.ndarray, here: np.ndarray,
               winsors: tuple) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each winsor level (None: plain) and replicate: the sum of the chunk's
    draws whose rank in the whole sample is kept, and the sample's lowest and
    highest kept values if they are drawn here (else NaN).

    ``values`` are the chunk's, rising; ``seed`` is the chunk's own."""
    size, n_boot = values.size, below.size
    block = max(1, 262_144 // max(size, int(here.max(initial=1))))  # replicates at a time
    out = [tuple(np.full(n_boot, np.nan) for _ in range(3)) for _ in winsors]
    for b0 in range(0, n_boot, block):
        b = np.arange(b0, min(n_boot, b0 + block))
        p, k = below[b], here[b]
        i = np.arange(k.max(initial=0), dtype=np.int64)
        at = draw_indices(seed, b[:, None], i[None, :], size) + (np.arange(b.size) * size)[:, None]
        weight = np.bincount(at[i[None, :] < k[:, None]], minlength=b.size * size).reshape(b.size, size)
        upto = np.cumsum(weight, axis=1)
        for (inner, low, high), w in zip(out, winsors):
            cut = int(w * n) if w is not None else 0
            first, last = np.clip(cut - p, 0, k), np.clip(n - cut - p, 0, k)
            kept = np.clip(upto, first[:, None], last[:, None])
            kept[:, 1:] -= kept[:, :-1].copy()
            kept[:, 0] -= first
            inner[b] = kept @ values
            for found, rank in ((low, cut - p), (high, n - 1 - cut - p)):
                has = (rank >= 0) & (rank < k)
                found[b[has]] = values[(upto[has] <= rank[has, None]).sum(axis=1)]
    return out


FEW = 16                # draws of a sample that are sorted by comparing columns
BLOCK_DRAWS = 1 << 18   # draws of several groups made at once


def sample_ranks(seeds: np.ndarray, n: int, n_boot: int) -> list[np.ndarray]:
    """The ``n`` ranks that every replicate of every group (rows, columns) draws,
    lowest first: those of :func:`draw_indices`, whose integers modulo 2**31
    need only the low 32 bits."""
    u, low = np.uint32, np.uint32(MIX_MOD - 1)
    start = seeds.astype(np.uint32)[:, None] + np.arange(n_boot, dtype=np.uint32)[None] * u(MIX_B)
    at = []
    for i in range(n):
        x = ((start + u(i * MIX_I)) & low) * u(MIX_A1) + u(MIX_C1) & low
        x ^= x >> u(13)
        x = x * u(MIX_A2) + u(MIX_C2) & low
        x ^= x >> u(17)
        at.append((x - x // u(n) * u(n)).astype(np.uint8))
    for odd in range(n):  # odd-even transposition
        for i in range(odd % 2, n - 1, 2):
            at[i], at[i + 1] = np.minimum(at[i], at[i + 1]), np.maximum(at[i], at[i + 1])
    return at


def small_group_errors(values: np.ndarray, seeds: np.ndarray, n_boot: int, winsors: tuple) -> np.ndarray:
    """Standard errors (groups x winsor levels) of groups of one size, at most
    ``FEW``; ``values`` holds a group's in a row, rising."""
    groups, n = values.shape
    out = np.empty((groups, len(winsors)))
    step = max(1, BLOCK_DRAWS // (n * n_boot))
    for g0 in range(0, groups, step):
        v = values[g0:g0 + step]
        flat, row = v.ravel(), (np.arange(len(v)) * n)[:, None]
        drawn = [flat[at + row] for at in sample_ranks(seeds[g0:g0 + step], n, n_boot)]
        for j, w in enumerate(winsors):
            cut = int(w * n) if w is not None else 0
            total = sum(drawn[cut + 1:n - cut], drawn[cut])
            if cut:
                total = total + cut * (drawn[cut] + drawn[n - 1 - cut])
            out[g0:g0 + step, j] = np.std(total / n, axis=1, ddof=1)
    return out


def group_errors(names: list, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, n_boot: int,
                 winsors: tuple) -> np.ndarray:
    """Standard errors of whole groups (rows) by winsor level (columns); a
    group's rising values are the ``sizes`` ones from ``starts`` in ``flat``."""
    seeds = np.fromiter(map(group_seed, names), dtype=np.int64, count=len(names))
    out = np.empty((len(names), len(winsors)))
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        if n <= FEW:
            some = flat[starts[rows][:, None] + np.arange(n)]
            out[rows] = small_group_errors(some, seeds[rows], n_boot, winsors)
            continue
        none, all_ = np.zeros(n_boot, dtype=np.int64), np.full(n_boot, n, dtype=np.int64)
        for r in rows:
            sums = chunk_sums(flat[starts[r]:starts[r] + n], int(seeds[r]), int(n), none, all_, winsors)
            for j, (inner, low, high) in enumerate(sums):
                cut = int(winsors[j] * n) if winsors[j] is not None else 0
                out[r, j] = np.std((inner + cut * (low + high)) / n, ddof=1)
    return out


def _with_errors(groups: DataFrame, group: str, listed: str, n_boot: int, winsors: tuple, names: list[str]) -> DataFrame:
    """``groups`` with the standard errors of the rising values in ``listed``, which goes."""
    kept = [c for c in groups.columns if c != listed]
    schema = ", ".join([*[f"`{c}` {dict(groups.dtypes)[c]}" for c in kept], *[f"{x} double" for x in names]])

    def fn(batches):
        import pyarrow as pa
        for b in batches:
            lists = b.column(listed)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            se = group_errors(b.column(group).to_pylist(), offsets[:-1], np.diff(offsets),
                              lists.values.to_numpy(zero_copy_only=False), n_boot, winsors)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(x) for x in se.T]],
                                             names=[*kept, *names])

    return groups.mapInArrow(fn, schema).select(*kept, *[F.round(x, 6).alias(x) for x in names])


def _chunks(group: str, n_boot: int, winsors: tuple, chunk: int):
    """Stream of sorted (group, chunk) rows -> one row per chunk and winsor level."""
    def one(g, n: int, c: int, values: np.ndarray):
        below, here = chunk_draws(group_seed(g), n, chunk, c, n_boot)
        for j, sums in enumerate(chunk_sums(values, group_seed(f"{g}/{c}"), n, below, here, winsors)):
            yield g, n, j, None, *sums

    def several(names: list, n: np.ndarray, c: np.ndarray, starts: np.ndarray, sizes: np.ndarray, values: np.ndarray):
        whole = np.flatnonzero(n <= chunk)
        errors = group_errors([names[i] for i in whole], starts[whole], sizes[whole], values, n_boot, winsors)
        for i, se in zip(whole, errors):
            for j, x in enumerate(se):
                yield names[i], int(n[i]), j, float(x), [], [], []
        for i in np.flatnonzero(n > chunk):
            yield from one(names[i], int(n[i]), int(c[i]), values[starts[i]:starts[i] + sizes[i]])

    def fn(batches):
        held = None
        names = [group, "n", "level", "se", "inner", "low", "high"]
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held = b if held is None else pd.concat([held, b], ignore_index=True)
            if held is None or not len(held):
                continue
            key = pd.MultiIndex.from_arrays([held[group], held["_c"]]).to_numpy()
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[edge[1:], len(held)]
            # The last chunk may go on in the next batch.
            done = len(edge) - (b is not None)
            s = edge[:done]
            rows = list(several([held[group].iat[i] for i in s], held["_n"].to_numpy()[s], held["_c"].to_numpy()[s],
                                s, ends[:done] - s, held["_x"].to_numpy(np.float64)))
            held = held.iloc[edge[done]:] if done < len(edge) else None
            if rows:
                yield pd.DataFrame(rows, columns=names)
    return fn


def _bootstrap_many(values: DataFrame, group: str, x: str, n_boot: int, winsors: tuple,
                    chunk: int = CHUNK_ROWS) -> DataFrame:
    """Per-group bootstrap standard errors, one column ``se<j>`` per winsor level
    (``None`` = plain), from the *same* draws; ``n`` and ``method``."""
    if n_boot < 2:
        raise ValueError("n_boot must be >= 2")
    ship_package(values.sparkSession)
    vals = values.select(F.col(group), F.col(x).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    ranked = group_ordinal(salted(vals), [group], ["_x", "_salt"], out="_r", total="_n")
    gtype = dict(vals.dtypes)[group]
    schema = (f"`{group}` {gtype}, n long, level int, se double, inner array<double>, "
              "low array<double>, high array<double>")
    parts = (ranked.select(group, "_x", "_n", "_r", F.expr(f"(_r - 1) div {chunk}").alias("_c"))
             .repartition(group, "_c").sortWithinPartitions(group, "_c", "_r").select(group, "_x", "_n", "_c")
             .mapInPandas(_chunks(group, n_boot, winsors, chunk), schema))
    parts = cut_lineage(parts)  # read twice; one row per chunk and level
    whole = parts.filter(F.col("se").isNotNull()).select(group, "n", "level", "se")
    cuts = F.element_at(F.array(*[F.lit(float(w or 0.0)) for w in winsors]), F.col("level") + 1)
    real = lambda c: F.max(F.when(~F.isnan(c), F.col(c)))
    means = (parts.filter(F.col("se").isNull())
             .select(group, "n", "level", F.posexplode(F.arrays_zip("inner", "low", "high")).alias("b", "z"))
             .select(group, "n", "level", "b", "z.*").groupBy(group, "n", "level", "b")
             .agg(F.sum("inner").alias("inner"), real("low").alias("low"), real("high").alias("high"))
             .withColumn("m", (F.col("inner") + F.floor(cuts * F.col("n")) * (F.col("low") + F.col("high")))
                         / F.col("n")))
    split = means.groupBy(group, "n", "level").agg(F.stddev_samp("m").alias("se"))
    wide = whole.unionByName(split).groupBy(group, "n").agg(*[
        F.round(F.max(F.when(F.col("level") == j, F.col("se"))), 6).alias(f"se{j}") for j in range(len(winsors))])
    return wide.withColumn("method", F.lit("bootstrap"))


def _bootstrap(values: DataFrame, group: str, x: str, n_boot: int, winsor: float | None,
               chunk: int) -> DataFrame:
    return _bootstrap_many(values, group, x, n_boot, (winsor,), chunk).withColumnRenamed("se0", "se") \
        .select(group, "n", "se", "method")


def bootstrap_se(values: DataFrame, group: str, x: str, n_boot: int = 1000,
                 chunk: int = CHUNK_ROWS) -> DataFrame:
    """Standard deviation (ddof=1) of ``n_boot`` resampled means per group."""
    return _bootstrap(values, group, x, n_boot, None, chunk)


def winsorized_bootstrap(values: DataFrame, group: str, x: str, p: float = 0.25,
                         n_boot: int = 1000, chunk: int = CHUNK_ROWS) -> DataFrame:
    """As G4 but each resample is winsorised at ``int(p·n)`` ranks per side."""
    return _bootstrap(values, group, x, n_boot, p, chunk)


def spread_report(bank: DataFrame, ann: DataFrame, key: str = "question_ref", answer: str = "answer",
                  expected: str = "expected_answer", n_boot: int = 1000, p: float = 0.25) -> DataFrame:
    """Spread statistics with ``std``, ``boot_se`` and ``wins_se`` as
    separate columns (the reference overwrote one with the other).  Both
    standard errors come from one pass over the same draws."""
    if n_boot < 2:
        raise ValueError("n_boot must be >= 2")
    rows = ann.select(key).unionByName(bank.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if (rows.agg(F.max("n")).first()[0] or 0) <= CHUNK_ROWS:
        return _spread_report_whole(bank, ann, key, answer, expected, n_boot, p)
    base = annotator_spread(bank, ann, key, answer, expected)
    v = spread_values(bank, ann, key, answer, expected)
    se = _bootstrap_many(v, key, "x", n_boot, (None, p)).select(
        key, F.col("se0").alias("boot_se"), F.col("se1").alias("wins_se"))
    return base.join(se, key, "left")


def _spread_report_whole(bank: DataFrame, ann: DataFrame, key: str, answer: str, expected: str,
                         n_boot: int, p: float) -> DataFrame:
    """:func:`spread_report` where no question has more rows than one chunk: a
    single shuffle, since statistics and sorted values are one aggregate over
    answers and questions alike (groups without a question go)."""
    ship_package(bank.sparkSession)
    told = _answer_values(ann, key, answer).withColumn("asked", F.lit(False))
    asked = bank.select(key, first_number(F.col(expected)).alias("x"), F.lit(True).alias("is_expected"),
                        F.lit(True).alias("asked"))
    x = F.col("x")
    groups = (told.unionByName(asked).filter(F.col(key).isNotNull()).groupBy(key)
              .agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"),
                   F.round(F.stddev_samp("x"), 6).alias("std"),
                   F.max(F.when(F.col("is_expected"), x)).alias("expected_value"),
                   F.sort_array(F.collect_list("x")).alias("_v"), F.bool_or("asked").alias("_asked"))
              .filter("_asked and n > 0"))
    middle = lambda i: F.get("_v", F.floor(i).cast("int"))
    median = (middle((F.col("n") - 1) / 2) + middle(F.col("n") / 2)) / 2
    out = _with_errors(groups.select(key, "n", "mean", F.round(median, 6).alias("median"), "std", "expected_value", "_v"),
                       key, "_v", n_boot, (None, p), ["boot_se", "wins_se"])
    return out.select(key, "n", "mean", "median", "std", "expected_value", "boot_se", "wins_se")
