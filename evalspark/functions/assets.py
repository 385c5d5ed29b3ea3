"""Asset-name, path, page and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Asset-name patterns (``image43_2.jpeg``, ``image25_m0.png``).
MAIN_PATTERN = r"image(\d+)"
# ``_(\w+)\.`` with a portable word class; greedy over underscores (D3).
SUB_PATTERN = r"_([\p{L}\p{N}_]+)\."
LETTERS_DIGITS = r"^([a-zA-Z]*)(\d*)"
PAGE_REF_PATTERN = r"^[^_]*_(.*?)(\.html)?$"
THANK_YOU_PAGE = "thankyou.html"
SENTINEL_MISSING = "CANNOT FIND IMAGE"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _int_or_minus_one(s: Column) -> Column:
    return F.coalesce(F.when(s != "", s.try_cast("bigint")), F.lit(-1).cast("bigint"))


def letter_sum(s: Column) -> Column:
    """Sum of code points of the letters (X9); '' -> 0."""
    return F.aggregate(F.filter(F.split(s, ""), lambda x: x != ""), F.lit(0).cast("bigint"),
                       lambda acc, x: acc + F.ascii(x).cast("bigint"))


def parse_asset(name) -> Column:
    """``struct(main, letters, sub, letter_sum)``; -1 for absent numbers."""
    n = _c(name)
    main = _int_or_minus_one(F.regexp_extract(n, MAIN_PATTERN, 1))
    part = F.regexp_extract(n, SUB_PATTERN, 1)
    letters = F.regexp_extract(part, LETTERS_DIGITS, 1)
    sub = _int_or_minus_one(F.regexp_extract(part, LETTERS_DIGITS, 2))
    return F.struct(main.alias("main"), letters.alias("letters"), sub.alias("sub"),
                    letter_sum(letters).alias("letter_sum"))


def name_distance(a: Column, b: Column) -> Column:
    """|Δmain| + 0.01·(|Δletter_sum| + |Δsub|) between two parsed assets."""
    return (F.abs(a["main"] - b["main"]).cast("double")
            + F.lit(0.01) * (F.abs(a["letter_sum"] - b["letter_sum"]) + F.abs(a["sub"] - b["sub"])))


def split_path(path) -> Column:
    """``struct(dir, name)`` split at the last ``/`` (dir '' if none)."""
    p = _c(path)
    has = p.contains("/")
    return F.struct(
        F.when(has, F.regexp_extract(p, r"^(.*)/([^/]*)$", 1)).otherwise(F.lit("")).alias("dir"),
        F.when(has, F.regexp_extract(p, r"^(.*)/([^/]*)$", 2)).otherwise(p).alias("name"))


def join_path(*parts) -> Column:
    return F.concat_ws("/", *[_c(p) for p in parts])


def strip_leading_slash(p) -> Column:
    """Paths are relative."""
    return F.regexp_replace(_c(p), r"^/+", "")


def page_name(user_id, question_ref) -> Column:
    return F.concat(_c(user_id), F.lit("_"), _c(question_ref), F.lit(".html"))


def page_ref(filename) -> Column:
    """X11: question ref of ``<user>_<ref>.html`` (after first ``_``, no ``.html``);
    a name without ``_`` is its own reference, as in the reference's fallback."""
    f = _c(filename)
    return F.when(f.contains("_"), F.regexp_extract(f, PAGE_REF_PATTERN, 1)).otherwise(f)


def add_ok(url) -> Column:
    """Append ``ok=1`` with ``?`` or ``&``."""
    u = _c(url)
    return F.concat(u, F.when(u.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("ok=1"))


def question_ref(n) -> Column:
    """``q_%04d``."""
    return F.format_string("q_%04d", _c(n))


def progress_label(k, total) -> Column:
    """``Qk/total``."""
    return F.format_string("Q%d/%d", _c(k), _c(total))
