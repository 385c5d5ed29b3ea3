"""Contextual distractor selection.

Both selectors rank every file of the target's folder and keep the best
``k``.  Emitting every (question, file) pair of a folder as rows would make a
hot folder (say a third of all images) one giant task and a quadratic
shuffle, so the ranking is *blocked*:

1. per folder, candidates and queries are hashed into chunks of at most
   ``block`` rows (chunk counts come from one small per-folder aggregate);
2. each candidate chunk meets each query chunk of its folder in one cogroup
   cell; the cell computes its scores with numpy and emits only the top
   ``k`` per query (Arrow batches in, ``k`` rows per query out);
3. a final window over ``question`` keeps the best ``k`` of the
   ``k × chunks`` survivors (bounded per question).

Compute is the exact brute force (nothing is sampled or capped).  No pair rows
exist, but each query travels to every candidate chunk of its folder and the
reverse, so a folder of ``n`` files moves about ``2 n² / block`` input rows:
raise ``block`` with the executors' memory for very large folders.
Ties rank by the rounded score, then by candidate id/path, on every engine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.assets import SENTINEL_MISSING, parse_asset, split_path
from evalspark.operators.ordinals import global_ordinal, group_ordinal
from evalspark.session import cut_lineage, ship_package

DEFAULT_BLOCK = 4096
UNIT = 100.0  # a step of the image number, in hundredths of distance


# ------------------------------------------------------------ the blocking
def _chunk_counts(queries: DataFrame, cands: DataFrame, group: str, block: int) -> DataFrame:
    qn = queries.groupBy(group).agg(F.countDistinct("qid").alias("_nq"))
    cn = cands.groupBy(group).agg(F.count(F.lit(1)).alias("_nc"))
    return qn.join(cn, group, "inner").select(
        group,
        F.greatest(F.lit(1), F.ceil(F.col("_nq") / F.lit(block))).cast("int").alias("_qchunks"),
        F.greatest(F.lit(1), F.ceil(F.col("_nc") / F.lit(block))).cast("int").alias("_cchunks"))


def _blocked(queries: DataFrame, cands: DataFrame, group: str, block: int):
    """Replicate each side across the other side's chunks of the same folder."""
    ship_package(queries.sparkSession)
    # one row per folder; AQE broadcasts it from its measured size
    counts = _chunk_counts(queries, cands, group, block)
    q = (queries.join(counts, group, "inner")
         .withColumn("_qc", F.pmod(F.xxhash64("qid"), F.col("_qchunks")).cast("int"))
         .withColumn("_cc", F.explode(F.sequence(F.lit(0), F.col("_cchunks") - 1))))
    c = (cands.join(counts, group, "inner")
         .withColumn("_cc", F.pmod(F.xxhash64("cid"), F.col("_cchunks")).cast("int"))
         .withColumn("_qc", F.explode(F.sequence(F.lit(0), F.col("_qchunks") - 1))))
    keys = [group, "_qc", "_cc"]
    return q.drop("_qchunks", "_cchunks"), c.drop("_qchunks", "_cchunks"), keys


def _merge_topk(partial: DataFrame, k: int, descending: bool) -> DataFrame:
    score = F.col("score").desc() if descending else F.col("score").asc()
    w = Window.partitionBy("qid").orderBy(score, F.col("cid").asc())
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


SUB_CHUNK = 512  # queries scored at once inside a cell (bounds the score matrix)
CELL_PAIRS = 1 << 18  # entries of a matrix of name distances


def _empty(cid_dtype) -> pd.DataFrame:
    return pd.DataFrame({"qid": pd.Series([], dtype=object), "cid": pd.Series([], dtype=cid_dtype),
                         "score": pd.Series([], dtype="float64")})


def _topk_rows(qids: np.ndarray, scores: np.ndarray, cids: np.ndarray, k: int, descending: bool,
               slack: float = 0.0, rescore=None) -> pd.DataFrame:
    """Top-k per row of a dense (n_q × n_c) score matrix; ties by candidate id.

    ``rescore(rows, columns)`` gives the scores of single pairs where those of
    the matrix may be off by up to ``slack``.

    Vectorised: a per-row ``np.partition`` threshold keeps the k best (plus
    ties at the threshold), then one ``lexsort`` over the survivors orders
    them by (row, score, candidate id) and the first k per row are kept.
    """
    order_cid = np.argsort(cids, kind="stable")
    cids_sorted = cids[order_cid]
    sc = scores[:, order_cid]
    key = -sc if descending else sc
    key = np.where(np.isfinite(key), key, np.inf)
    kk = min(k, key.shape[1])
    thr = np.partition(key, kk - 1, axis=1)[:, kk - 1]
    rows, cols = np.nonzero((key <= thr[:, None] + 2 * slack) & np.isfinite(key))
    if rows.size == 0:
        return pd.DataFrame({"qid": [], "cid": [], "score": []})
    if rescore is not None:
        sc = sc.copy()
        sc[rows, cols] = rescore(rows, order_cid[cols])
        key[rows, cols] = -sc[rows, cols] if descending else sc[rows, cols]
    vals = key[rows, cols]
    o = np.lexsort((cols, vals, rows))
    rows, cols = rows[o], cols[o]
    pos = np.arange(rows.size) - np.searchsorted(rows, rows, side="left")
    keep = pos < k
    rows, cols = rows[keep], cols[keep]
    return pd.DataFrame({"qid": qids[rows], "cid": cids_sorted[cols],
                         "score": sc[rows, cols].astype("float64")})


# ---------------------------------------------------------- J7: by vectors
def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _ip_cell(k: int):
    def fn(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return _empty("int64")
        cv = _matrix(c["vec"])
        cids = c["cid"].to_numpy()
        longest = float(np.sqrt((cv * cv).sum(axis=1).max()))
        parts = []
        for s0 in range(0, len(q), SUB_CHUNK):
            qq = q.iloc[s0:s0 + SUB_CHUNK]
            qv = _matrix(qq["vec"])
            # A matrix product may sum equal vectors in different orders; single pairs never are.
            slack = 1e-12 * longest * float(np.sqrt((qv * qv).sum(axis=1).max()))
            parts.append(_topk_rows(qq["qid"].to_numpy(object), qv @ cv.T, cids, k, True, slack,
                                    lambda r, c_, qv=qv: (qv[r] * cv[c_]).sum(axis=1)))
        return pd.concat(parts, ignore_index=True).astype({"cid": "int64"})
    return fn


def _ip_cells(q: DataFrame, c: DataFrame, group: str, k: int, block: int) -> DataFrame:
    qb, cb, keys = _blocked(q, c, group, block)
    return (qb.groupBy(*keys).cogroup(cb.groupBy(*keys))
            .applyInPandas(_ip_cell(k), "qid string, cid bigint, score double"))


def _vector_sides(targets: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries ``qid, dir, vec``, candidates ``cid, dir, vec``)."""
    v = vectors.select("vec_id", F.col("embedding").alias("vec"), "dir")
    first = (targets.filter(F.col("target_pos") == 1).select("question_ref", "vec_id")
             .join(v.select("vec_id", "dir"), "vec_id", "inner").select("question_ref", "dir"))
    q = (targets.join(v.select("vec_id", "vec"), "vec_id", "inner").join(first, "question_ref", "inner")
         # The number stands first: a question's name may hold any character.
         .select(F.concat_ws(":", F.col("target_pos").cast("string"), "question_ref").alias("qid"),
                 F.col("dir").alias("dir"), F.col("vec").alias("vec")))
    return q, vectors.select(F.col("vec_id").alias("cid"), F.col("dir").alias("dir"), F.col("embedding").alias("vec"))


def _ranked_vectors(top: DataFrame) -> DataFrame:
    parts = F.split("qid", ":", 2)
    return top.select(parts[1].alias("question_ref"), parts[0].cast("int").alias("target_pos"),
                      "rank", F.col("cid").alias("vec_id"), "score")


def knn_context(targets: DataFrame, vectors: DataFrame, k: int = 10, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Per target image, the ``k`` nearest vectors by inner product in
    the question's folder (the first target's folder, D5).

    ``targets``: ``question_ref, target_pos, vec_id`` (the target's own id);
    ``vectors``: ``vec_id, embedding, dir``.  Targets are not excluded (D1):
    a target ranks first among its own neighbours.  Targets without a vector,
    and questions whose first target has none (no folder), have no rows here;
    :func:`append_contextual_by_vector` gives those questions the sentinel.
    Output: ``question_ref, target_pos, rank, vec_id, score``.

    Folders of more than ``block`` vectors are cut in cells around sampled
    vectors.  A cell's centre and radius bound every inner product in it, so a
    target meets its cells in order of that bound, twice as many each round,
    and stops once the next bound is below its k-th best.  Exact; how much is
    skipped depends on how far the vectors cluster.
    """
    q, c = _vector_sides(targets, vectors)
    largest = c.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= block:
        return _ranked_vectors(_merge_topk(_ip_cells(q, c, "dir", k, block), k, descending=True))
    return _ranked_vectors(search_cells(q, c, k, block)[0])


MOST_CELLS = 256  # cells of a folder


def _assign(c: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """Each vector's nearest centre and its distance."""
    if c.empty:
        return pd.DataFrame({n: pd.Series([], dtype=object) for n in ("cid", "dir", "vec", "cell", "away")})
    x, m = _matrix(c["vec"]), _matrix(centres.sort_values("cell")["vec"])
    near = ((m * m).sum(axis=1)[None, :] - 2 * (x @ m.T)).argmin(axis=1)
    gap = x - m[near]
    return pd.DataFrame({"cid": c["cid"], "dir": c["dir"], "vec": c["vec"], "cell": near,
                         "away": np.sqrt((gap * gap).sum(axis=1))})


def _bounds(q: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    """Each query's cells, by falling upper bound of the inner product."""
    if q.empty or cells.empty:
        return pd.DataFrame({n: pd.Series([], dtype=object) for n in ("qid", "dir", "vec", "cells", "bounds")})
    cells = cells.sort_values("cell")
    m, r = _matrix(cells["vec"]), cells["radius"].to_numpy(np.float64)
    x = _matrix(q["vec"])
    size = np.sqrt((x * x).sum(axis=1))[:, None]
    bound = x @ m.T + size * r[None, :]
    bound += 1e-9 * (np.abs(bound) + size * r[None, :]) + 1e-12  # rounding must not lower it
    order = np.argsort(-bound, axis=1, kind="stable")
    return pd.DataFrame({"qid": q["qid"], "dir": q["dir"], "vec": q["vec"],
                         "cells": list(cells["cell"].to_numpy()[order]),
                         "bounds": list(np.take_along_axis(bound, order, axis=1))})


def vector_cells(q: DataFrame, c: DataFrame, k: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(candidates with their ``cell``, queries with ``cells`` and ``bounds``).

    Equal vectors of a folder tie by id, so the first ``k`` of them suffice.
    """
    ship_package(q.sparkSession)
    same = Window.partitionBy("dir", "vec").orderBy("cid")
    c = cut_lineage(c.withColumn("_same", F.row_number().over(same)).filter(F.col("_same") <= k).drop("_same"))
    sizes = c.groupBy("dir").agg(F.count(F.lit(1)).alias("_n"))
    picked = Window.partitionBy("dir").orderBy(F.xxhash64("cid"), "cid")
    centres = (c.withColumn("cell", F.row_number().over(picked) - 1).filter(F.col("cell") < MOST_CELLS).join(sizes, "dir")
               .filter(F.col("cell") < F.ceil(F.col("_n") / block))
               # new names: the vectors themselves are on the other side below
               .select(F.col("dir").alias("dir"), "cell", F.col("vec").alias("vec")))
    vec = dict(c.dtypes)["vec"]
    spread = lambda df, key: (df.join(sizes, "dir")
                              .withColumn("_part", F.pmod(F.xxhash64(key), F.ceil(F.col("_n") / block))).drop("_n"))
    copied = lambda df: (df.join(sizes, "dir").withColumn(
        "_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("_n") / block) - 1))).drop("_n"))
    by = ["dir", "_part"]
    placed = cut_lineage(spread(c, "cid").groupBy(*by).cogroup(copied(centres).groupBy(*by))
                         .applyInPandas(_assign, f"cid bigint, dir string, vec {vec}, cell int, away double"))
    radii = placed.groupBy("dir", "cell").agg(F.max("away").alias("radius"))
    cells = cut_lineage(centres.join(radii, ["dir", "cell"]))
    asked = cut_lineage(spread(q, "qid").groupBy(*by).cogroup(copied(cells).groupBy(*by)).applyInPandas(
        _bounds, f"qid string, dir string, vec {vec}, cells array<int>, bounds array<double>"))
    return placed, asked


def search_cells(q: DataFrame, c: DataFrame, k: int, block: int) -> tuple[DataFrame, list[int]]:
    """The top ``k`` per query and, per round, how many (query, cell) pairs were searched."""
    placed, left = vector_cells(q, c, k, block)
    group = lambda cell: F.concat_ws("/", cell.cast("string"), F.col("dir"))
    placed = placed.select("cid", "vec", group(F.col("cell")).alias("_grp"))
    best, done, take, visits = None, 0, 2, []
    while True:
        here = cut_lineage(left.select("qid", "vec", "dir", F.explode(F.slice("cells", done + 1, take)).alias("_cell"))
                           .select("qid", "vec", group(F.col("_cell")).alias("_grp")))
        visits.append(here.count())
        found = _ip_cells(here, placed, "_grp", k, block)
        every = found if best is None else found.unionByName(best.drop("rank"))
        best = cut_lineage(_merge_topk(every, k, descending=True))
        done, take = done + take, 2 * take
        kth = best.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_kth"))
        after = F.try_element_at("bounds", F.lit(done + 1))
        left = cut_lineage(left.join(kth, "qid", "left")
                           .filter(after.isNotNull() & ((F.coalesce("_n", F.lit(0)) < k) | (after >= F.col("_kth"))))
                           .drop("_n", "_kth"))
        if left.isEmpty():
            return best, visits


def _signs(planes: np.ndarray, probes: bool):
    """Bucket numbers of vectors, one per table; with ``probes`` also those that differ in one bit."""
    tables, bits, _ = planes.shape

    def fn(batches):
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b["vec"])
            use = b["_bits"].to_numpy(np.int64)
            live = np.arange(bits)[None, :] < use[:, None]
            out = []
            for t in range(tables):
                on = (x @ planes[t].T > 0) & live
                key = (on << np.arange(bits)).sum(axis=1)
                flips = range(-1, bits) if probes else (-1,)
                for f in flips:
                    rows = np.flatnonzero(live[:, f]) if f >= 0 else np.arange(len(b))
                    part = b.iloc[rows].drop(columns="_bits")
                    part["_grp"] = [f"{t}/{v}/{d}" for v, d in zip(key[rows] ^ (1 << f if f >= 0 else 0), part["dir"])]
                    out.append(part.drop(columns="dir"))
            yield pd.concat(out, ignore_index=True)
    return fn


def knn_context_approximate(targets: DataFrame, vectors: DataFrame, k: int = 10, block: int = DEFAULT_BLOCK,
                            tables: int = 8, seed: int = 1) -> DataFrame:
    """J7 by locality-sensitive buckets, for callers that accept missed neighbours.

    Vectors fall in buckets by the signs of their products with random
    directions, as many as bring a folder's buckets down to about ``block``
    vectors, in ``tables`` independent tables.  A target meets its own buckets
    and those that differ in one sign; what it meets is ranked by the exact inner
    product.  Folders of at most ``block`` vectors are searched whole.  Fit for
    vectors of about equal length; :func:`recall` tells what was found.
    """
    ship_package(targets.sparkSession)
    q, c = _vector_sides(targets, vectors)
    c = cut_lineage(c)
    row = c.select(F.size("vec").alias("d")).limit(1).collect()
    sizes = c.groupBy("dir").agg(F.count(F.lit(1)).alias("_n"))
    bits = F.least(F.lit(20), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("_n") / block)))).cast("int")
    sizes = cut_lineage(sizes.select("dir", bits.alias("_bits")))
    most = max(1, sizes.agg(F.max("_bits")).first()[0] or 0)
    planes = np.random.default_rng(seed).normal(size=(tables, most, row[0][0] if row else 1))
    vec = dict(c.dtypes)["vec"]
    cb = c.join(sizes, "dir").mapInPandas(_signs(planes, False), f"cid bigint, vec {vec}, _grp string")
    qb = q.join(sizes, "dir").mapInPandas(_signs(planes, True), f"qid string, vec {vec}, _grp string")
    found = _ip_cells(qb, cb, "_grp", k, block).groupBy("qid", "cid").agg(F.max("score").alias("score"))
    return _ranked_vectors(_merge_topk(found, k, descending=True))


def recall(found: DataFrame, exact: DataFrame, key: tuple[str, ...] = ("question_ref", "target_pos", "vec_id")) -> float:
    """Share of the exact neighbours that ``found`` holds (1 if there are none)."""
    n = exact.count()
    return exact.join(found.select(*key), list(key), "left_semi").count() / n if n else 1.0


def interleave_ranked(ranked: DataFrame, k: int = 10, item: str = "vec_id") -> DataFrame:
    """Rank-major round robin over targets, first occurrence wins, cut at k.

    Each candidate's position is its smallest ``(rank, target_pos)``; the
    per-question window runs over at most ``k × n_targets`` rows.
    """
    best = ranked.groupBy("question_ref", item).agg(
        F.min(F.struct("rank", "target_pos")).alias("_b"))
    w = Window.partitionBy("question_ref").orderBy(F.col("_b.rank"), F.col("_b.target_pos"))
    return (best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("question_ref", "rank", item))


# ------------------------------------------------------------ J8: by names
def _name_cell(k: int, exclude_targets: bool):
    def fn(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return _empty(object)
        cm = c["main"].to_numpy(np.int64)[None, :]
        cl = c["letter_sum"].to_numpy(np.int64)[None, :]
        cs = c["sub"].to_numpy(np.int64)[None, :]
        cids = c["cid"].to_numpy(object)
        pos_of = {cid: i for i, cid in enumerate(cids)} if exclude_targets else {}
        q = q.sort_values("qid", kind="stable")
        qids_all = q["qid"].to_numpy(object)
        uniq, first = np.unique(qids_all, return_index=True)
        parts = []
        # As many questions, and as many of their targets, at once as keep a matrix at CELL_PAIRS.
        step = min(SUB_CHUNK, max(1, CELL_PAIRS // len(cids)))
        for u0 in range(0, len(uniq), step):
            lo = first[u0]
            hi = first[u0 + step] if u0 + step < len(uniq) else len(qids_all)
            row_of = np.searchsorted(first[u0:u0 + step], np.arange(lo, hi), side="right") - 1
            dmin = np.full((row_of[-1] + 1, len(cids)), np.inf)
            for r0 in range(lo, hi, step):
                sub = q.iloc[r0:min(hi, r0 + step)]
                tm = sub["main"].to_numpy(np.int64)[:, None]
                tl = sub["letter_sum"].to_numpy(np.int64)[:, None]
                ts = sub["sub"].to_numpy(np.int64)[:, None]
                # Hundredths are whole numbers, so equal distances compare equal.
                d = UNIT * np.abs(tm - cm).astype(np.float64) + np.abs(tl - cl) + np.abs(ts - cs)
                rows, starts = np.unique(row_of[r0 - lo:r0 - lo + len(sub)], return_index=True)
                dmin[rows] = np.minimum(dmin[rows], np.minimum.reduceat(d, starts, axis=0))
            if exclude_targets:
                for r, path in zip(row_of, q["target_path"].to_numpy(object)[lo:hi]):
                    j = pos_of.get(path)
                    if j is not None:
                        dmin[r, j] = np.inf
            parts.append(_topk_rows(uniq[u0:u0 + step], dmin, cids, k, False))
        return pd.concat(parts, ignore_index=True) if parts else _empty(object)
    return fn


def _parsed(df: DataFrame, name_col: str) -> DataFrame:
    """Parsed names, and their place on a line on which no two files lie farther
    apart than their distance (in hundredths)."""
    p = parse_asset(F.col(name_col))
    return (df.withColumns({c: p[c] for c in ("main", "letter_sum", "sub")})
            .withColumn("place", UNIT * F.col("main").cast("double") + F.col("letter_sum") + F.col("sub")))


def named_bands(targets: DataFrame, files: DataFrame, k: int, spare: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files of each folder in bands of ``block`` by place, and each target's home
    band: (files with ``band``, targets with ``home`` and ``bands``, edges of the bands).

    Files of equal parsed names tie by path for every target, so the first
    ``k + spare`` of them are all that a question can get (``spare``: targets
    that it leaves out).
    """
    same = Window.partitionBy("dir", "main", "letter_sum", "sub").orderBy("cid")
    files = (files.withColumn("_same", F.row_number().over(same)).filter(F.col("_same") <= k + spare).drop("_same"))
    files = global_ordinal(files, ["dir", "place", "cid"], out="_g")
    starts = files.groupBy("dir").agg(F.min("_g").alias("_start"), F.count(F.lit(1)).alias("_n"))
    files = (files.join(starts, "dir").withColumn("band", F.expr(f"(_g - _start) div {block}"))
             .drop("_g", "_start", "_n"))
    # Files before a target: its number among files and targets less that among targets.
    spots = targets.select("dir", "place").distinct()
    mixed = files.select("dir", "place", F.lit(1).alias("_file")).unionByName(spots.withColumn("_file", F.lit(0)))
    mixed = global_ordinal(mixed, ["dir", "place", "_file"], out="_u").filter("_file = 0").drop("_file")
    spots = global_ordinal(spots, ["dir", "place"], out="_t").join(mixed, ["dir", "place"]).join(starts, "dir")
    home = F.expr(f"least((_u - _t - _start + 1) div {block}, (_n - 1) div {block})")
    homes = spots.select("dir", "place", home.alias("home"), F.expr(f"(_n - 1) div {block} + 1").alias("bands"))
    edges = files.groupBy("dir", "band").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    return files, cut_lineage(targets.join(homes, ["dir", "place"])), cut_lineage(edges)


def routed(targets: DataFrame, near: int, far: int) -> DataFrame:
    """Targets at the bands more than ``near`` and at most ``far`` away from home."""
    bands = F.sequence(F.greatest(F.lit(0), F.col("home") - far), F.least(F.col("bands") - 1, F.col("home") + far))
    return targets.withColumn("band", F.explode(F.filter(bands, lambda b: F.abs(b - F.col("home")) > near)))


def _open_targets(targets: DataFrame, best: DataFrame, edges: DataFrame, k: int, far: int) -> DataFrame:
    """Targets of questions for which a file beyond the searched bands could still count."""
    beyond = (targets.withColumns({"_l": F.col("home") - far - 1, "_r": F.col("home") + far + 1})
              .join(edges.select("dir", F.col("band").alias("_l"), F.col("last").alias("_left")), ["dir", "_l"], "left")
              .join(edges.select("dir", F.col("band").alias("_r"), F.col("first").alias("_right")), ["dir", "_r"], "left"))
    gap = F.least(F.col("place") - F.col("_left"), F.col("_right") - F.col("place"))  # null beyond the ends
    gaps = beyond.groupBy("qid").agg(F.min(gap).alias("_gap"))
    kth = best.groupBy("qid").agg(F.count(F.lit(1)).alias("_found"), F.max("score").alias("_kth"))
    # Places of far numbers are rounded; a little slack keeps the bound safe.
    slack = F.lit(1e-12) * F.abs("_gap") + F.lit(1e-6)
    todo = (gaps.join(kth, "qid", "left")
            .filter(F.col("_gap").isNotNull() & ((F.coalesce("_found", F.lit(0)) < k) | (F.col("_kth") >= F.col("_gap") - slack)))
            .select("qid"))
    return cut_lineage(targets.join(todo, "qid", "left_semi"))


def nearest_named(targets: DataFrame, manifest: DataFrame, k: int = 10, exclude_targets: bool = False,
                  block: int = DEFAULT_BLOCK) -> DataFrame:
    """The ``k`` files of the folder closest by name distance to any target.

    ``targets``: ``question_ref, target_pos, path`` (relative); the folder is
    the first target's (D5); names are parsed on both sides from the base
    name (D2).  Distance ``|Δmain| + 0.01·(|Δletters| + |Δsub|)``, minimum
    over targets; ties by path.  Targets stay eligible unless
    ``exclude_targets`` (D1).  A folder with at most ``k`` files returns all
    of them in rank order (J11, D6).  Output: ``question_ref, rank, path, score``.

    Folders of more than ``block`` files are searched in bands: each target
    meets its home band and the next ones, and further bands (twice as far each
    round) only while its question's k-th distance reaches beyond the bands
    searched.  So a folder's work grows with its files and targets, not with
    their product, and the result is exact.
    """
    t = targets.withColumn("_sp", split_path(F.col("path")))
    first = t.filter(F.col("target_pos") == 1).select("question_ref", F.col("_sp.dir").alias("dir"))
    q = _parsed(t.select(F.col("question_ref").alias("qid"), F.col("_sp.name").alias("_name"),
                         F.col("path").alias("target_path")), "_name") \
        .join(first.withColumnRenamed("question_ref", "qid"), "qid", "inner") \
        .select("qid", "dir", "main", "letter_sum", "sub", "target_path", "place")
    c = _parsed(manifest.select(F.col("path").alias("cid"), "dir", "name").distinct(), "name") \
        .select("cid", "dir", "main", "letter_sum", "sub", "place")
    largest = manifest.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= block:
        top = _merge_topk(_name_cells(q, c, "dir", k, exclude_targets, block), k, descending=False)
    else:
        top = _search_bands(q, c, k, exclude_targets, block)
    return top.select(F.col("qid").alias("question_ref"), "rank", F.col("cid").alias("path"),
                      (F.col("score") / UNIT).alias("score"))


def _name_cells(q: DataFrame, c: DataFrame, group: str, k: int, exclude_targets: bool, block: int) -> DataFrame:
    qb, cb, keys = _blocked(q.drop("place"), c.drop("place"), group, block)
    return (qb.groupBy(*keys).cogroup(cb.groupBy(*keys))
            .applyInPandas(_name_cell(k, exclude_targets), "qid string, cid string, score double"))


def _search_bands(q: DataFrame, c: DataFrame, k: int, exclude_targets: bool, block: int) -> DataFrame:
    q = cut_lineage(q)
    spare = q.groupBy("qid").count().agg(F.max("count")).first()[0] or 0 if exclude_targets else 0
    files, left, edges = named_bands(q, c, k, spare, block)
    group = F.concat_ws("/", F.col("band").cast("string"), F.col("dir"))  # the number stands first
    files = files.withColumn("_grp", group).drop("dir", "band")
    best, near, far = None, -1, 1
    while True:
        here = routed(left, near, far).withColumn("_grp", group).drop("dir", "band", "home", "bands")
        found = _name_cells(here, files, "_grp", k, exclude_targets, block)
        # A file that several targets of a question met in different rounds counts once.
        every = found if best is None else found.unionByName(best.drop("rank"))
        best = cut_lineage(_merge_topk(every.groupBy("qid", "cid").agg(F.min("score").alias("score")), k, descending=False))
        left = _open_targets(left, best, edges, k, far)
        if left.isEmpty():
            return best
        near, far = far, 2 * far


# ------------------------------------------------------ J10, T5, G14, all
def check_assets(bank: DataFrame, manifest: DataFrame, key: str = "question_ref",
                 images: str = "image_urls") -> DataFrame:
    """Questions whose targets are not all present.

    Output ``question_ref, n_missing, missing_asset``.  The explode is per
    question (bounded by its image list); the anti-join is an equi-join on
    the path.
    """
    paths = bank.select(key, F.explode_outer(images).alias("path"))
    missing = paths.join(manifest.select("path").distinct(), "path", "left_anti")
    per = missing.groupBy(key).agg(F.count("path").alias("n_missing"))
    return (bank.select(key).join(per, key, "left")
            .withColumn("n_missing", F.coalesce(F.col("n_missing"), F.lit(0)).cast("bigint"))
            .withColumn("missing_asset", F.col("n_missing") > 0))


def natural_asset_order(manifest: DataFrame) -> DataFrame:
    """T5: files of each folder in (main, letters, sub) order, ties by name."""
    p = parse_asset(F.col("name"))
    keyed = manifest.withColumn("_main", p["main"]).withColumn("_letters", p["letters"]) \
        .withColumn("_sub", p["sub"])
    return group_ordinal(keyed, ["dir"], ["_main", "_letters", "_sub", "name"], out="ordinal") \
        .drop("_main", "_letters", "_sub")


def asset_set(bank: DataFrame, columns: tuple[str, ...] = ("image_urls", "contextual_urls")) -> DataFrame:
    """Distinct union of every image column (one explode, one distinct)."""
    arr = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns])
    return bank.select(F.explode(arr).alias("path")).distinct()


def append_contextual_by_vector(bank: DataFrame, vectors: DataFrame, k: int = 10,
                                block: int = DEFAULT_BLOCK) -> DataFrame:
    """The embedding form of the contextual step: per-target neighbours (J7),
    merged round robin (W9) into one ``contextual_urls`` list per question.

    ``bank``: ``question_ref, image_urls``; ``vectors``: ``vec_id, path,
    embedding, dir``.  A question with a target that has no vector, or with no
    target, gets the sentinel.
    """
    known = vectors.filter(F.col("embedding").isNotNull())
    chk = check_assets(bank, known)
    lost = F.col("missing_asset") | (F.coalesce(F.size("image_urls"), F.lit(0)) <= 0)
    flagged = (bank.drop("contextual_urls").join(chk.select("question_ref", "missing_asset"), "question_ref", "left")
               .withColumn("missing_asset", F.coalesce(lost, F.lit(True))))
    targets = (flagged.filter(~F.col("missing_asset"))
               .select("question_ref", F.posexplode("image_urls").alias("pos", "path"))
               .join(known.select("path", "vec_id"), "path")
               .select("question_ref", (F.col("pos") + 1).alias("target_pos"), "vec_id"))
    ranked = interleave_ranked(knn_context(targets, known, k, block), k)
    lists = (ranked.join(known.select("vec_id", "path"), "vec_id").groupBy("question_ref")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda s: s["path"])
                  .alias("contextual_urls")))
    return (flagged.join(lists, "question_ref", "left")
            .withColumn("contextual_urls", F.when(F.col("missing_asset"), F.array(F.lit(SENTINEL_MISSING)))
                        .otherwise(F.coalesce("contextual_urls", F.array().cast("array<string>")))))


def append_contextual(bank: DataFrame, manifest: DataFrame, k: int = 10, exclude_targets: bool = False,
                      block: int = DEFAULT_BLOCK) -> DataFrame:
    """The whole contextual step: sentinel for missing targets, else the
    ranked neighbour list as ``contextual_urls`` (ordered by rank)."""
    chk = check_assets(bank, manifest)
    ok = bank.join(chk.filter(~F.col("missing_asset")).select("question_ref"), "question_ref", "left_semi")
    targets = ok.select("question_ref", F.posexplode("image_urls").alias("target_pos", "path")) \
        .withColumn("target_pos", F.col("target_pos") + 1)
    ranked = nearest_named(targets, manifest, k, exclude_targets, block)
    lists = ranked.groupBy("question_ref").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda s: s["path"])
        .alias("contextual_urls"))
    sentinel = F.array(F.lit(SENTINEL_MISSING))
    return (bank.drop("contextual_urls").join(chk.select("question_ref", "missing_asset"), "question_ref", "left")
            .join(lists, "question_ref", "left")
            .withColumn("contextual_urls", F.when(F.col("missing_asset"), sentinel)
                        .otherwise(F.coalesce(F.col("contextual_urls"), F.array().cast("array<string>")))))

