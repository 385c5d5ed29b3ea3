"""String and list expressions shared by the scoring and inference jobs.

All builders return ``Column`` expressions that stay inside whole-stage
codegen (no Python UDFs).  Regular expressions use classes that mean the same
in Java and RE2 so the DuckDB oracle can use the identical pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
NUMBER_PATTERN = r"\d+\.?\d*"          # first/all numbers in an answer
ANSWER_SEPARATOR = ";"                 # multi-answer separator
FINAL_ANSWER_MARKER = "Final answer:"  # reasoning/answer marker in responses
NUMERIC_TOKEN = r"^\d+(\.\d+)?$"       # an all-numeric normalised token
NON_ALNUM = r"[^a-zA-Z0-9]+"           # removed when normalising text answers
ALNUM_RUN = r"[a-zA-Z0-9]+"            # ... i.e. only these runs are kept
# Unicode-aware strip: every character Python's ``str.strip()`` removes (the
# reference's semantics), derived by rule from ``str.isspace``.
STRIP_CHARS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
STRIP_CLASS = "".join("\\x{%04x}" % ord(ch) for ch in STRIP_CHARS)
STRIP_PATTERN = f"^[{STRIP_CLASS}]+|[{STRIP_CLASS}]+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Strip Unicode whitespace at both ends, as ``str.strip()`` does.

    ``trim`` with an explicit character set: no regex, codegen'd, and it only
    touches the ends of the string.
    """
    return F.trim(_c(c), F.lit(STRIP_CHARS))


def first_answer(c) -> Column:
    """First ``;``-separated answer, stripped (no array is built)."""
    return ustrip(F.substring_index(_c(c), ANSWER_SEPARATOR, 1))


def split_answers(c, sep: str = ANSWER_SEPARATOR) -> Column:
    """Split on ``;`` and strip every element; empties are kept."""
    return F.transform(F.split(_c(c), _re_literal(sep)), lambda x: ustrip(x))


def _re_literal(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch for ch in s)


def first_number(c) -> Column:
    """First ``\\d+\\.?\\d*`` in the text as a double, null if none."""
    raw = F.regexp_extract(_c(c), f"({NUMBER_PATTERN})", 1)
    return F.when(raw == "", F.lit(None).cast("double")).otherwise(raw.try_cast("double"))


def all_numbers(c) -> Column:
    """Every number in the text, as doubles, in order."""
    return F.transform(
        F.regexp_extract_all(_c(c), F.lit(f"({NUMBER_PATTERN})"), F.lit(1)),
        lambda x: x.try_cast("double"),
    )


def normalise_list(c) -> Column:
    """Lower-case, drop ``[^a-zA-Z0-9]+``, drop empty tokens.

    Implemented as "keep the alphanumeric runs and join them", which is the
    same string and several times faster than ``regexp_replace`` on long
    texts.  (Stripping first would be redundant: whitespace is removed.)
    """
    cleaned = F.transform(_c(c), lambda x: F.array_join(
        F.regexp_extract_all(F.lower(x), F.lit(ALNUM_RUN), F.lit(0)), ""))
    return F.filter(cleaned, lambda x: x != "")


def is_numeric_list(c) -> Column:
    """Non-empty and every token all-numeric."""
    arr = _c(c)
    return (F.size(arr) > 0) & F.forall(arr, lambda x: x.rlike(NUMERIC_TOKEN))


def same_set(a, b) -> Column:
    """Set equality of two string arrays."""
    return F.array_sort(F.array_distinct(_c(a))) == F.array_sort(F.array_distinct(_c(b)))


def symmetric_difference_size(a, b) -> Column:
    """|a Δ b| over distinct elements."""
    a, b = _c(a), _c(b)
    return F.size(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def extract_final_answer(c, marker: str = FINAL_ANSWER_MARKER) -> Column:
    """Text after the *last* marker, stripped; whole text if absent.

    Null stays null.  ``element_at(split(..), -1)`` is the tail after the last
    occurrence and the whole string when the marker is absent.
    """
    return ustrip(F.element_at(F.split(_c(c), _re_literal(marker)), -1))


def marker_count(c, marker: str = FINAL_ANSWER_MARKER) -> Column:
    return F.size(F.split(_c(c), _re_literal(marker))) - 1


def yes_verdict(c) -> Column:
    """1 when the judge's text starts with 'yes' after strip+lower, else 0; a
    null text (a failed judge call) stays null (X14)."""
    yes = F.lower(ustrip(_c(c))).startswith("yes")
    return F.when(yes, F.lit(1)).when(_c(c).isNotNull(), F.lit(0))


def nonblank(c) -> Column:
    return F.coalesce(ustrip(_c(c)) != "", F.lit(False))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda-bound name.

    Catalyst does not share sub-expressions across ``CASE`` branches or inside
    higher-order functions, so an expensive value used several times (a
    normalised token list, a sorted array) would be recomputed each time.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
