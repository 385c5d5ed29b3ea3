"""Mixing sources to target weights.

The words of each source are packed, in a pseudorandom order of its documents,
into blocks of one fixed length.  Every output shard has the same number of
slots and draws how many go to each source (a multinomial draw by target).
The n-th slot of a source maps, through a pseudorandom permutation of that
source's block numbers, to a block; past the last block the next pass uses
another permutation.  Slots and blocks are joined by (source, block number).

Draws stray from their expectation, so slots that a source drew beyond its
quota are handed to the sources that fell short: every source takes its target
to within about a block, and never passes three times.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ...;
they share the whole size, none above three times its own, the excess shared
by weight among the others.

Everything is narrow until texts are asked for.  Word offsets use two-level
running totals, so a source with a third of all rows is spread over about
sqrt(rows) tasks' worth of cells.  One row per source is the only table that
is ordered in one task.

A null text has no words, takes none and appears in no block.  Extra columns
are ignored.  Equal ids are separate rows.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.common import materialise, running_total, table

QUERY = "op3_source_mix"
SPACE = r"\x20\x09-\x0D"
MOST = 3  # times a source may be used


@dataclass(frozen=True)
class Settings:
    block_words: int = 128  # a block's length; the last of a source may be shorter
    rounds: int = 16        # of the permutation
    task_slots: int = 50_000  # slots that a task deals out
    seed: int = 17


@dataclass(frozen=True)
class Mix:
    rows: DataFrame   # one per document: row, doc_id, carried columns, size, source_size, target
    spans: DataFrame  # words taken: shard, slot, pass, block, row, first, words


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame) -> DataFrame:
    """Add ``number``, ``weight`` and ``target`` to one row per source (source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = materialise(
        sources.withColumn("number", F.row_number().over(order) - 1)
        .withColumn("weight", F.col("number") % 3 + 1), "mix-sources")
    cap = F.lit(MOST) * F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate, capped = 0.0, -1
    while True:  # the capped sources only grow in number
        over = cap < F.lit(rate) * F.col("weight")
        taken, weight, n = sources.agg(
            F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))),
            F.count(F.when(over, 1))).first()
        if n == capped or not weight:
            break
        rate, capped = (total - taken) / weight, n
    return sources.withColumn("target", F.least(F.lit(float(rate)) * F.col("weight"),
                                                cap.cast("double")))


def permuted(x: Column, size: Column, *key: Column, rounds: int) -> Column:
    """The image of ``x`` under a permutation of [0, size) named by ``key``: the
    swap-or-not cipher, each round pairing x with k - x and maybe swapping."""
    def step(at: Column, r: Column) -> Column:
        k = F.pmod(F.xxhash64(*key, r, F.lit(1)), size)
        other = F.pmod(k - at, size)
        heads = F.xxhash64(*key, r, F.greatest(at, other), F.lit(2)).bitwiseAND(F.lit(1)) == 1
        return F.when(heads, other).otherwise(at)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def _quotas(sources: DataFrame, length: int) -> DataFrame:
    """Blocks and slots of each source, and the slots' running total ``below``."""
    size, target = F.col("source_size"), F.col("target")
    blocks = F.ceil(size / F.lit(length))
    passes = F.floor(target / size)
    rest = (target - passes * size) / (size / blocks)  # in blocks of the source's mean length
    out = (sources.filter(size > 0).withColumn("blocks", blocks)
           .withColumn("quota", F.least(passes * F.col("blocks") + F.round(rest), MOST * F.col("blocks"))
                       .cast("bigint")))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("below", F.coalesce(F.sum("quota").over(before), F.lit(0)))


def _slots(quotas: DataFrame, slots: int, s: Settings) -> DataFrame:
    """(shard, number, blocks, nth): the slots of every source, counted from 0 to its quota."""
    spark = quotas.sparkSession
    per_shard = max(1, int(slots ** 0.5))
    # A draw falls in the interval [below, below + quota) of one source.  Both
    # sides meet by cell of the draw's range.
    cell = -(-slots // 4096)
    interval = quotas.filter("quota > 0").select(
        "number", "below", "quota", F.explode(F.sequence(
            F.expr(f"below div {cell}"), F.expr(f"(below + quota - 1) div {cell}"))).alias("cell"))
    drawn = (spark.range(slots).select(
        F.expr(f"id div {per_shard}").alias("shard"),
        F.pmod(F.xxhash64("id", F.lit(s.seed)), F.lit(slots)).alias("draw"))
        .withColumn("cell", F.expr(f"draw div {cell}")))
    counts = materialise(
        drawn.join(interval, "cell").filter("draw >= below and draw < below + quota")
        .groupBy("shard", "number").agg(F.count(F.lit(1)).alias("count")), "mix-counts")
    before = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    total = counts.groupBy("number").agg(F.sum("count").alias("drawn"))
    by_number = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    info = (quotas.select("number", "blocks", "quota").join(total, "number", "left")
            .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
            .withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)))
            .withColumn("short", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
            .withColumn("over_below", F.coalesce(F.sum("over").over(by_number), F.lit(0)))
            .withColumn("short_below", F.coalesce(F.sum("short").over(by_number), F.lit(0))))
    info = materialise(info, "mix-info")
    # One row per (source, shard) is numbered; the rows are dealt anew before they
    # become slots, so that a hot source's slots are made by many tasks.
    based = materialise(counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))), "mix-bases")
    tasks = min(slots // s.task_slots + 1, 10_000)
    each = (based.join(info, "number").repartition(tasks, "number", "shard")
            .withColumn("nth", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("count") - 1))))
    within = each.filter("nth < quota").select("shard", "number", "blocks", "nth")
    over = each.filter("nth >= quota").select(
        "shard", (F.col("over_below") + F.col("nth") - F.col("quota")).alias("spare"))
    short = (info.filter("short > 0")
             .withColumn("from", F.explode(F.expr(f"sequence(drawn, quota - 1, {s.task_slots}L)")))
             .repartition(tasks, "number", "from")
             .withColumn("nth", F.explode(F.expr(f"sequence(from, least(from + {s.task_slots}, quota) - 1)")))
             .select("number", "blocks", "nth",
                     (F.col("short_below") + F.col("nth") - F.col("drawn")).alias("spare")))
    return within.unionByName(over.join(short, "spare").drop("spare"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        carry: tuple = (), settings: Settings = Settings()) -> Mix:
    """Choose the blocks of every shard; see ``Mix``."""
    s = settings
    sized = materialise(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"),
                    word_count(F.col(text_col)).alias("size"), *[F.col(c) for c in carry])
        .withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    length = s.block_words
    quotas = materialise(_quotas(sources, length), "mix-quotas")
    slots = quotas.agg(F.sum("quota")).first()[0] or 0
    rows = sized.join(sources.withColumnRenamed("source", "_source"),
                      F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    # Word offsets within the source, in a pseudorandom order of its documents.
    cells = max(1, int(sized.count() ** 0.5))
    placed = running_total(
        rows.filter("size > 0").select("row", "number", "size", "doc_id")
        .withColumn("h", F.xxhash64("doc_id", F.lit(s.seed)))
        .withColumn("cell", F.pmod("h", F.lit(cells))),
        ["number"], "cell", ["h", "doc_id", "size", "row"], "size", "start")
    start, end = F.col("start"), F.col("start") + F.col("size")
    pieces = (placed.withColumn("block", F.explode(F.sequence(
        F.expr(f"start div {length}"), F.expr(f"(start + size - 1) div {length}"))))
        .withColumn("first", F.greatest(F.col("block") * length - start, F.lit(0)))
        .withColumn("words", F.least((F.col("block") + 1) * length, end) - start - F.col("first"))
        .select("number", "block", "row", "first", "words"))
    if slots:
        chosen = _slots(quotas, slots, s)
    else:
        chosen = docs.sparkSession.createDataFrame([], "shard bigint, number int, blocks bigint, nth bigint")
    chosen = chosen.withColumn("pass", F.expr("nth div blocks")).withColumn("block", permuted(
        F.expr("nth % blocks"), F.col("blocks"), F.lit(s.seed), F.col("number"), F.col("pass"),
        rounds=s.rounds))
    spans = (pieces.join(chosen, ["number", "block"])
             .select("shard", F.xxhash64("shard", "number", "nth").alias("slot"), "pass", "block", "row",
                     "first", "words"))
    return Mix(rows.select("row", "doc_id", *carry, "size", "source_size", "target"), spans)


def taken_words(mixed: Mix) -> DataFrame:
    """Per document: the words that the mix takes, repeats counted."""
    taken = mixed.spans.groupBy("row").agg(F.sum("words").alias("taken"))
    return (mixed.rows.join(taken, "row", "left")
            .withColumn("taken", F.coalesce("taken", F.lit(0)).cast("bigint")))


def taken_texts(mixed: Mix, docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` once for each unbroken run of words that a pass took of a
    document, ``text_col`` holding the run with its white space.  ``key`` names
    a column of ``docs`` that is unique and was carried through ``mix``."""
    span = F.struct("pass", "first", "words")
    taken = (mixed.spans.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("_spans"))
             .join(mixed.rows.select("row", key), "row").drop("row"))
    # Spans that go on where the one before ends are one run with it.
    begins = F.filter(F.sequence(F.lit(1), F.size("_spans")), lambda i: (i == 1) | ~F.coalesce(
        (F.get("_spans", i - 2)["pass"] == F.get("_spans", i - 1)["pass"])
        & (F.get("_spans", i - 2)["first"] + F.get("_spans", i - 2)["words"] == F.get("_spans", i - 1)["first"]),
        F.lit(False)))
    ends = lambda n: F.coalesce(F.get("_begins", n + 1), F.size("_spans") + 1) - 1
    run = F.transform("_begins", lambda i, n: F.struct(
        F.get("_spans", i - 1)["first"].alias("first"),
        (F.get("_spans", ends(n) - 1)["first"] + F.get("_spans", ends(n) - 1)["words"]).alias("end")))
    taken = (taken.withColumn("_begins", begins).select(key, run.alias("_runs")))
    words = F.split(F.regexp_replace(text_col, f"^[{SPACE}]+", ""), f"(?<=[{SPACE}])(?=[^{SPACE}])")
    text = F.array_join(F.slice("_words", (F.col("_run.first") + 1).cast("int"),
                                (F.col("_run.end") - F.col("_run.first")).cast("int")), "")
    return (docs.join(taken, key).withColumn("_words", words).withColumn("_run", F.explode("_runs"))
            .withColumn(text_col, text).drop("_words", "_runs", "_run"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return taken_words(mixed).select("doc_id", "size", "source_size", "target", "taken")
