"""Document fingerprints by Order MinHash over characters.

``fingerprint`` sketches the 8-mers of code points of a whole text in 64 bins
of 2 picks (see ``order_minhash``); equal texts get equal fingerprints.

``edited_pairs`` also needs every document's successor by id.  Rows are dealt
once into ranges of ids whose bounds are ids that occur (so the first id of
each range is known, one number per range), the first row of a range is copied
to the range before it, and each sorted range is read as a stream holding two
rows at a time.  Texts are shuffled once; nothing is collected but the bounds.

Null texts count as empty: no characters, an all-zero fingerprint, likeness 1
to another empty text and 0 to any other.  Null ids sort first, equal ids by a
hash of their text.  A single document follows itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import small_arrow_batches, table
from evalspark.llm.order_minhash import binned_sketch, kmers, likeness

QUERY = "op5_order_fingerprint"
K, BINS_LOG2, PICKS = 8, 6, 2
SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def sketch(codes: np.ndarray) -> np.ndarray:
    return binned_sketch(kmers(codes, K), BINS_LOG2, PICKS)


def fingerprint(text: str | None) -> str:
    """64 entries of 32 bits, as 512 hexadecimal digits."""
    return sketch(_codes(text or "")).astype(">u4").tobytes().hex()


def _pair(doc_id, text: str, print_: np.ndarray, codes: np.ndarray, after: str,
          after_codes: np.ndarray, after_print: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = text[:len(text) - half] + after[:half]
    edited_print = sketch(np.concatenate([codes[:len(codes) - half], after_codes[:half]]))
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            print_.astype(">u4").tobytes().hex(), edited_print.astype(">u4").tobytes().hex(),
            likeness(print_, edited_print), likeness(print_, after_print))


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one range in order, then the row that follows the range."""
    held = None  # the row that waits for its successor
    for b in batches:
        out = []
        for doc_id, text, guest in zip(b["doc_id"], b["text"], b["guest"]):
            if held is None and guest:
                continue
            codes = _codes(text)
            now = sketch(codes)
            if held is not None:
                out.append(_pair(*held, text, codes, now))
            held = None if guest else (None if pd.isna(doc_id) else int(doc_id), text, now, codes)
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its text with the last half replaced
    by the start of the next document, and their likeness."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)
    first, found, nulls = rows.select("doc_id").agg(
        F.min("doc_id"), cuts, F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    bounds = sorted(set(found or []) - {first})  # at most one number for each range
    last = len(bounds)
    if bounds:
        at = F.array(*[F.lit(b) for b in bounds])
        steps = [1 << i for i in reversed(range(last.bit_length()))]
        # Binary search: how many bounds are at or below the id.
        place = F.aggregate(
            F.array(*[F.lit(s) for s in steps]), F.lit(0),
            lambda n, s: F.when(F.get(at, n + s - 1) <= F.col("doc_id"), n + s).otherwise(n))
        leads = F.get(at, F.col("place") - 1) == F.col("doc_id")
    else:
        place, leads = F.lit(0), F.lit(False)
    is_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(first)
    deal = F.array_compact(F.array(
        F.struct(F.col("place").alias("range"), F.lit(False).alias("guest")),
        F.when(leads, F.struct((F.col("place") - 1).alias("range"), F.lit(True).alias("guest"))),
        F.when(is_first, F.struct(F.lit(last).alias("range"), F.lit(True).alias("guest")))))
    small_arrow_batches(spark)
    return (rows.withColumn("place", place).withColumn("to", F.explode(deal))
            .select("doc_id", "text", "to.range", "to.guest")
            .repartitionById(last + 1, F.col("range"))
            .sortWithinPartitions("guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
            .select("doc_id", "text", "guest").mapInPandas(_stream, SCHEMA))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))
