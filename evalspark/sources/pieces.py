"""Records that span lines, read from byte ranges of one file by many tasks.

A CSV export with line breaks inside quotes, or one large JSON array, cannot
be cut at any line or brace: whether a cut is inside a string depends on all
that stands before it.  But what a stretch of text does to that state can be
told from the stretch alone, for either state that it may start in:

1. the text reader cuts files at every separator (a line feed, a closing
   brace), in byte ranges, one task each; the pieces are written once with
   their range and their number in it;
2. each range is summed up (does it turn the quotes over, how far does it open
   or close brackets), and running sums over a file's ranges give the state
   that each starts in;
3. within a range, running sums tell which pieces end a record.  Records of
   one piece are done; the others are put together from their pieces, also
   across ranges.

Quotes must be paired as RFC 4180 and JSON ask; a lone quote inside an
unquoted CSV field is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.session import ensure_checkpoint_dir, scratch_path

RANGE = ["file", "range"]


def read_pieces(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """``file, range, at, piece``: what stands between separators.  One scan, written down."""
    raw = (spark.read.option("lineSep", separator).text(path)
           .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
                   F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece")))
    ensure_checkpoint_dir(spark)
    staged = scratch_path(spark, "pieces")
    raw.write.parquet(staged)
    return spark.read.schema(raw.schema).parquet(staged)


def _before(value: Column, within: list[str], order: str) -> Column:
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def _occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _odd(c: Column) -> Column:
    return F.pmod(c, F.lit(2)) == 1


def _records(pieces: DataFrame, separator: str) -> DataFrame:
    """``file, range, number, record`` from pieces with ``ends`` (the piece closes a record)."""
    pieces = pieces.withColumn("number", _before(F.col("ends").cast("int"), RANGE, "at"))
    # The first record of a range may have begun in an earlier one: it belongs
    # to the last range before with a piece after its last end.
    ranges = pieces.groupBy(*RANGE).agg(F.max("number").alias("_last"), F.max_by("ends", "at").alias("_closed"))
    w = Window.partitionBy("file").orderBy("range")
    open_before = F.coalesce(~F.lag("_closed").over(w), F.lit(False))
    # Ranges that hold no end and begin inside a record hand it on.
    own_start = F.when(~open_before | (F.col("_last") > 0), F.struct("range", F.when(
        F.col("_closed"), F.lit(None).cast("bigint")).otherwise(F.col("_last")).alias("number")))
    before = F.last(own_start, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(*RANGE, F.when(open_before, before).alias("_from"))
    placed = pieces.join(ranges, RANGE).withColumn(
        "_key", F.when((F.col("number") == 0) & F.col("_from").isNotNull(), F.col("_from"))
        .otherwise(F.struct("range", F.col("number").cast("bigint").alias("number"))))
    part = F.struct("range", "at", "piece")
    # Collected per record: nearly all are one piece.
    return (placed.groupBy("file", F.col("_key.range").alias("range"), F.col("_key.number").alias("number"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["piece"]), separator).alias("record"),
                 F.max("ends").alias("whole")))


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, range, number, record``: the records of CSV files with quoted line
    breaks, blank lines left out; ``first`` marks each file's first one."""
    pieces = read_pieces(spark, path, "\n").withColumn("_q", _occurrences(F.col("piece"), '"'))
    ranges = pieces.groupBy(*RANGE).agg(F.sum("_q").alias("_q"))
    starts = ranges.select(*RANGE, _odd(_before(F.col("_q"), ["file"], "range")).cast("int").alias("_in"))
    within = _before(F.col("_q"), RANGE, "at") + F.col("_q")
    marked = pieces.join(starts, RANGE).withColumn("ends", ~_odd(F.col("_in") + within))
    out = (_records(marked.drop("_q", "_in"), "\n")
           .withColumn("record", F.regexp_replace(F.regexp_replace("record", "\r$", ""), "^﻿", ""))
           .filter(F.col("record") != "").drop("whole"))
    first = out.groupBy("file").agg(F.min(F.struct("range", "number")).alias("_first"))
    return out.join(first, "file").withColumn("first", F.struct("range", "number") == F.col("_first")).drop("_first")


def json_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, range, number, record``: the objects of files that each hold one JSON array."""
    bare = F.regexp_replace("piece", r"(?s)\\.", "")  # no escapes: every quote left opens or closes a string
    outside = lambda c: F.regexp_replace(c, '(?s)"[^"]*("|$)', "")
    depth = lambda c: (_occurrences(c, "{") + _occurrences(c, "[") - _occurrences(c, "]"))
    out_text, in_text = outside(F.col("_bare")), outside(F.regexp_replace("_bare", '(?s)^[^"]*("|$)', ""))
    # The brace that ends a piece closes one bracket, unless it is in a string.
    pieces = (read_pieces(spark, path, "}").withColumn("_bare", bare).withColumn("_q", _occurrences(F.col("_bare"), '"'))
              .withColumn("_d0", depth(out_text) - F.when(_odd(F.col("_q")), 0).otherwise(1))
              .withColumn("_d1", depth(in_text) - F.when(_odd(F.col("_q")), 1).otherwise(0)).drop("_bare"))
    pieces = pieces.withColumn("_turn", _odd(_before(F.col("_q"), RANGE, "at")))
    sums = [F.sum(F.when(F.col("_turn") == F.lit(t), F.col(a)).otherwise(F.col(b))).alias(n)
            for n, t, a, b in (("_s0", False, "_d0", "_d1"), ("_s1", False, "_d1", "_d0"))]
    ranges = pieces.groupBy(*RANGE).agg(F.sum("_q").alias("_q"), *sums)
    ranges = ranges.withColumn("_in", _odd(_before(F.col("_q"), ["file"], "range")))
    ranges = ranges.withColumn("_depth", _before(F.when(F.col("_in"), F.col("_s1")).otherwise(F.col("_s0")), ["file"], "range"))
    marked = (pieces.join(ranges.select(*RANGE, "_in", "_depth"), RANGE)
              .withColumn("_inside", F.col("_in") != F.col("_turn"))
              .withColumn("_d", F.when(F.col("_inside"), F.col("_d1")).otherwise(F.col("_d0"))))
    deep = F.col("_depth") + _before(F.col("_d"), RANGE, "at") + F.col("_d")
    still = F.col("_inside") != _odd(F.col("_q"))  # in a string at the piece's end
    marked = marked.withColumn("ends", (deep == 1) & ~still).drop("_q", "_d0", "_d1", "_d", "_turn", "_inside", "_in", "_depth")
    # Records stand between the array's bracket, commas and blanks; what follows the last brace is none.
    return (_records(marked, "}").filter("whole")
            .withColumn("record", F.concat(F.regexp_replace("record", r"^[\s\[,\x{feff}]+", ""), F.lit("}"))).drop("whole"))
