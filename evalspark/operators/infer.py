"""Inference as data work.

No model ships here.  A *provider* is any picklable object implementing
:class:`Provider`; :func:`infer` runs it with ``mapInPandas`` — loaded once
per task, fed Arrow batches of ``batch_size`` rows, a failed batch becomes
null responses (never a task failure), and those rows re-enter the next run
through :func:`pending`.  Everything around the call (image lists, prompts,
asset URIs, resumption, bucketing) is plain DataFrame expressions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.text import extract_final_answer, marker_count
from evalspark.operators.ordinals import group_ordinal
from evalspark.session import ship_package

# Prompt pieces used by the reference runners.
ANSWER_IN_ENGLISH = "Answer in English only."
QUESTION_SUFFIX = ". "
IMAGE_LINE = "Image %d: <image>"
PROMPT_STYLES = ("prefixed", "text_last", "numbered", "text_first")


# ------------------------------------------------------------- P1, P2, P3
def build_image_list(df: DataFrame, distractor: bool, out: str = "image_lists") -> DataFrame:
    """Contextual images *then* targets, or targets only; ``q_answered`` false.

    ``distractor`` is a Python flag, so the branch is constant-folded.
    """
    lists = F.concat(F.coalesce(F.col("contextual_urls"), F.array().cast("array<string>")),
                     F.col("image_urls")) if distractor else F.col("image_urls")
    return df.withColumn("q_answered", F.lit(False)).withColumn(out, lists)


def cap_images(c, limit: int, compat: bool = True) -> Column:
    """First ``limit + 1`` images under ``compat`` (D7), else ``limit``."""
    arr = F.col(c) if isinstance(c, str) else c
    return F.slice(arr, 1, limit + 1 if compat else limit)


def _text(s: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), s.alias("text"), F.lit(None).cast("string").alias("image"))


def _images(arr: Column) -> Column:
    return F.transform(arr, lambda u: F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"),
                                               u.alias("image")))


def prompt_content(question: Column, images: Column, style: str, img_limit: int | None = None) -> Column:
    """User content parts for ``style``.

    * ``prefixed``: "Answer in English only.", images, ``"<question>. "``;
    * ``text_last``: images, question;
    * ``numbered``: one text part — prefix, ``Image i: <image>`` lines, question;
    * ``text_first``: question, images.
    ``img_limit`` caps images with :func:`cap_images` (prefixed/text_last).
    """
    imgs = cap_images(images, img_limit) if img_limit is not None and style in ("prefixed", "text_last") \
        else images
    if style == "prefixed":
        return F.concat(F.array(_text(F.lit(ANSWER_IN_ENGLISH))), _images(imgs),
                        F.array(_text(F.concat(question, F.lit(QUESTION_SUFFIX)))))
    if style == "text_last":
        return F.concat(_images(imgs), F.array(_text(question)))
    if style == "numbered":
        lines = F.transform(imgs, lambda u, i: F.format_string(IMAGE_LINE, i + 1))
        body = F.concat_ws("\n", F.lit(ANSWER_IN_ENGLISH), F.array_join(lines, "\n"), question)
        return F.array(_text(body))
    if style == "text_first":
        return F.concat(F.array(_text(question)), _images(imgs))
    raise ValueError(f"unknown prompt style {style!r}; one of {PROMPT_STYLES}")


def render_content(content: Column) -> Column:
    """Flat text of a content array (images as ``<image:path>``)."""
    return F.array_join(F.transform(content, lambda p: F.when(p["type"] == "text", p["text"])
                                    .otherwise(F.concat(F.lit("<image:"), p["image"], F.lit(">")))), "\n")


def assemble_prompt(df: DataFrame, style: str, question: str = "question_text",
                    images: str = "image_lists", img_limit: int | None = None,
                    system: str | None = None) -> DataFrame:
    out = df.withColumn("content", prompt_content(F.col(question), F.col(images), style, img_limit))
    if system is not None:
        out = out.withColumn("system_instruction", F.lit(system))
    return out


# ----------------------------------------------------------- P15, J5, J6
def drop_failed_responses(df: DataFrame, response: str) -> DataFrame:
    """Remove null and ``"None"`` responses so they are retried."""
    c = F.col(response)
    return df.filter(c.isNotNull() & (c != "None"))


def pending(bank: DataFrame, answered: DataFrame, key: str = "question_ref",
            response: str | None = None) -> DataFrame:
    """Questions without a usable answer (content-key anti join, D15/D16)."""
    done = drop_failed_responses(answered, response) if response else answered
    return bank.join(done.select(key).distinct(), key, "left_anti")


def resolve_assets(df: DataFrame, uri_map: DataFrame, key: str = "question_ref",
                   images: str = "image_lists", path: str = "path", uri: str = "uri") -> DataFrame:
    """Map every path to its URI keeping list order; missing paths are
    reported (``missing_paths``) and kept as null entries, never dropped."""
    exploded = df.select(key, F.posexplode(images).alias("_pos", path))
    j = exploded.join(uri_map.select(path, uri).dropDuplicates([path]), path, "left")
    per = j.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.col(uri).alias("_u")))),
                    lambda s: s["_u"]).alias("uris"),
        F.array_sort(F.collect_list(F.when(F.col(uri).isNull(), F.col(path)))).alias("missing_paths"))
    return df.join(per, key, "left")


# -------------------------------------------------------------------- G17
def length_buckets(df: DataFrame, images: str, batch_size: int, key: str = "question_ref") -> DataFrame:
    """Batches that hold one image count only, longest lists first.

    Adds ``n_images``, ``batch_in_bucket`` and ``batch_key``, which
    :func:`infer` takes as its ``batch_key``.
    """
    n = df.withColumn("n_images", F.size(images))
    o = group_ordinal(n, ["n_images"], [key], out="_o")
    return (o.withColumn("batch_in_bucket", F.floor((F.col("_o") - 1) / F.lit(batch_size)).cast("bigint"))
            .withColumn("batch_key", F.format_string("%05d-%09d", F.col("n_images"), F.col("batch_in_bucket")))
            .drop("_o"))


# ------------------------------------------------------------- I1 and I3
@runtime_checkable
class Provider(Protocol):
    """What :func:`infer` needs from a model backend.

    ``name``, ``temperature`` (0.0), ``max_new_tokens`` (2048) and
    ``instruction_prefix`` are run settings recorded with the output.
    ``load()`` runs once per task (model weights, clients); ``respond`` maps
    a list of request dicts (``question_text``, ``image_lists``, ``content``
    when present) to one string or ``None`` per request.
    """

    name: str
    temperature: float
    max_new_tokens: int
    instruction_prefix: str | None

    def load(self) -> None: ...

    def respond(self, requests: list[dict]) -> list[str | None]: ...


class ProviderBase:
    def __init__(self, name: str, temperature: float = 0.0, max_new_tokens: int = 2048,
                 instruction_prefix: str | None = None) -> None:
        self.name = name
        self.temperature = temperature
        self.max_new_tokens = max_new_tokens
        self.instruction_prefix = instruction_prefix

    def load(self) -> None:
        return None

    def upload(self, paths: list[str]) -> list[str | None]:
        """Asset path -> URI the model can read.  Default: join the path to an
        optional ``image_prefix`` (local or mounted images); hosted providers
        upload the file here and return its service URI."""
        prefix = getattr(self, "image_prefix", None)
        return [p if not prefix else prefix.rstrip("/") + "/" + p for p in paths]

    def respond(self, requests: list[dict]) -> list[str | None]:  # pragma: no cover - abstract
        raise NotImplementedError

    def __repr__(self) -> str:
        return self.name


def upload_assets(paths: DataFrame, provider, path: str = "path", batch_size: int = 64) -> DataFrame:
    """Map every distinct asset path to a provider URI (lifecycle step 2).

    Distinct paths (one shuffle) are uploaded in parallel tasks through
    ``provider.upload``; a failed batch yields null URIs, which
    :func:`resolve_assets` then reports as missing.  Output ``(path, uri)``.
    """
    ship_package(paths.sparkSession)
    distinct = paths.select(F.col(path).alias("path")).filter(F.col("path").isNotNull()).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider.load()
        for pdf in batches:
            ps = pdf["path"].tolist()
            uris: list = []
            for s0 in range(0, len(ps), batch_size):
                chunk = ps[s0:s0 + batch_size]
                try:
                    got = list(provider.upload(chunk))
                    uris.extend(got if len(got) == len(chunk) else [None] * len(chunk))
                except Exception:  # noqa: BLE001 - report as missing, retry later
                    uris.extend([None] * len(chunk))
            yield pd.DataFrame({"path": ps, "uri": uris})

    return distinct.mapInPandas(run, "path string, uri string")


def response_column(provider_name: str) -> str:
    return f"{provider_name}_response"


def infer(df: DataFrame, provider: Provider, batch_size: int = 1,
          key: str = "question_ref", inputs: tuple[str, ...] = ("question_text", "image_lists"),
          keep: tuple[str, ...] = (), final_answer: bool = True,
          batch_key: str | None = None) -> DataFrame:
    """Run ``provider`` over every row; Arrow batches, model loaded once per task.

    A batch that raises yields null responses (D17: checked per row) and its
    exception in ``error``, so a transient failure never kills the job, the
    rows are retried by :func:`pending`, and a programming error shows.
    ``batch_key`` (G17: one image count) names a column whose values are never
    mixed in a model call: rows are dealt by it and sorted, and a call ends
    where it changes, also across Arrow batches.  Output: ``key``, ``keep``
    columns, ``<name>_response`` (after :func:`extract_final_answer` when
    ``final_answer``), ``raw_response``, ``error``, ``q_answered`` and the run
    settings; helper columns are dropped.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    ship_package(df.sparkSession)
    cols = [key, *keep, *[c for c in inputs if c in df.columns]]
    if "content" in df.columns and "content" not in cols:
        cols.append("content")
    src = df.select(*cols, *([F.col(batch_key).alias("_batch")] if batch_key else []))
    if batch_key:
        src = src.repartition("_batch").sortWithinPartitions("_batch", key)
    out_fields = [src.schema[key], *[src.schema[c] for c in keep],
                  T.StructField("raw_response", T.StringType()), T.StructField("error", T.StringType())]
    schema = T.StructType(out_fields)
    keep_cols = [key, *keep]
    req_cols = [c for c in cols if c not in keep_cols or c in inputs]

    def call(chunk: list[dict]) -> tuple[list, str | None]:
        try:
            res = list(provider.respond(chunk))
        except Exception as e:  # noqa: BLE001 - any model failure -> retry later
            return [None] * len(chunk), f"{type(e).__name__}: {e}"
        if len(res) != len(chunk):
            return [None] * len(chunk), f"{len(res)} responses to {len(chunk)} requests"
        return [None if g is None else str(g) for g in res], None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider.load()
        held = None  # rows of a batch key that may go on in the next Arrow batch
        for pdf in itertools.chain(batches, [None]):
            if batch_key and held is not None:
                pdf, last, held = (held, True, None) if pdf is None else (
                    pd.concat([held, pdf], ignore_index=True), False, None)
            else:
                last = False
            if pdf is None or not len(pdf):
                continue
            cuts = [0, len(pdf)]
            if batch_key:
                b = pdf["_batch"]
                same = (b == b.shift()) | (b.isna() & b.shift().isna())
                cuts = [i for i in range(len(pdf)) if i == 0 or not same.iat[i]] + [len(pdf)]
                if not last:
                    held, cuts = pdf.iloc[cuts[-2]:], cuts[:-1]
            got, errors = [], []
            reqs = pdf[req_cols].iloc[:cuts[-1]].to_dict("records")
            for lo, hi in zip(cuts, cuts[1:]):
                for start in range(lo, hi, batch_size):
                    res, error = call(reqs[start:min(hi, start + batch_size)])
                    got.extend(res)
                    errors.extend([error] * len(res))
            out = pdf[keep_cols].iloc[:cuts[-1]].copy()
            out["raw_response"], out["error"] = got, errors
            yield out

    raw = src.mapInPandas(run, schema)
    resp = extract_final_answer(F.col("raw_response")) if final_answer else F.col("raw_response")
    return (raw.withColumn(response_column(provider.name), resp)
            .withColumn("q_answered", F.col("raw_response").isNotNull())
            # More than one marker usually means the prompt was echoed back
            .withColumn("flag_echo", F.coalesce(marker_count(F.col("raw_response")) > 1, F.lit(False)))
            .withColumn("model", F.lit(provider.name))
            .withColumn("temperature", F.lit(float(provider.temperature)))
            .withColumn("max_new_tokens", F.lit(int(provider.max_new_tokens))))
