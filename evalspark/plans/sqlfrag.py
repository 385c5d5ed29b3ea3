"""DuckDB text for the oracle twins of the expression builders.

These produce *oracle SQL strings only*; nothing here executes on Spark.  Each
fragment mirrors one builder in :mod:`evalspark.functions`.
"""

from __future__ import annotations

from evalspark.functions.ring import DIRECTIONS
from evalspark.functions.text import NON_ALNUM, NUMBER_PATTERN, NUMERIC_TOKEN, STRIP_PATTERN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ustrip(x: str) -> str:
    return f"regexp_replace({x}, {q(STRIP_PATTERN)}, '', 'g')"


def split_answers(x: str) -> str:
    return f"list_transform(string_split({x}, ';'), lambda s_: {ustrip('s_')})"


def first_number(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, {q('(' + NUMBER_PATTERN + ')')}, 1), '') AS DOUBLE)"


def all_numbers(x: str) -> str:
    return (f"list_transform(regexp_extract_all({x}, {q('(' + NUMBER_PATTERN + ')')}, 1), "
            f"lambda n_: TRY_CAST(n_ AS DOUBLE))")


def normalise_list(x: str) -> str:
    return (f"list_filter(list_transform({x}, lambda t_: regexp_replace(lower(t_), "
            f"{q(NON_ALNUM)}, '', 'g')), lambda t_: t_ <> '')")


def is_numeric_list(x: str) -> str:
    return (f"(len({x}) > 0 AND list_bool_and(list_transform({x}, "
            f"lambda t_: regexp_matches(t_, {q(NUMERIC_TOKEN)}))))")


def same_set(a: str, b: str) -> str:
    return f"(list_sort(list_distinct({a})) = list_sort(list_distinct({b})))"


def ring_list() -> str:
    return "[" + ", ".join(q(d) for d in DIRECTIONS) + "]"


def accepted_directions(e: str) -> str:
    """Ring neighbours of ``e``; unknown -> [e]."""
    idx = f"list_position({ring_list()}, {e})"
    return (f"CASE WHEN {idx} IS NULL THEN [{e}] ELSE "
            f"[{ring_list()}[{idx}], {ring_list()}[(({idx} + 6) % 8) + 1], "
            f"{ring_list()}[({idx} % 8) + 1]] END")


def distance_correct(r: str, e: str) -> str:
    exp0 = f"({e})[1]"
    nums = all_numbers(exp0)
    tol = f"(CASE WHEN contains({exp0}, '±') THEN coalesce(({nums})[2], 0.0) ELSE 0.0 END)"
    v = first_number(f"({r})[1]")
    ev = f"({nums})[1]"
    return f"(CASE WHEN coalesce({v} BETWEEN {ev} - {tol} AND {ev} + {tol}, false) THEN 1 ELSE 0 END)"


def cardinal_correct(r: str, e: str) -> str:
    return (f"(CASE WHEN coalesce(list_contains({accepted_directions(f'({e})[1]')}, ({r})[1]), false) "
            f"THEN 1 ELSE 0 END)")


def text_correct(r: str, e: str, r_raw: str, e_raw: str) -> str:
    rn, en = normalise_list(r), normalise_list(e)
    blank = lambda x: f"coalesce({ustrip(x)} <> '', false)"
    return (f"(CASE WHEN {is_numeric_list(rn)} AND {is_numeric_list(en)} "
            f"THEN (CASE WHEN {rn} = {en} THEN 1 ELSE 0 END) "
            f"WHEN len({rn}) = 0 AND len({en}) = 0 THEN "
            f"(CASE WHEN NOT {blank(r_raw)} AND NOT {blank(e_raw)} THEN 1 END) "
            f"WHEN {same_set(rn, en)} THEN 1 END)")


def score(t: str, r: str, e: str, r_raw: str, e_raw: str) -> str:
    return (f"(CASE WHEN {t} = 'distance' THEN {distance_correct(r, e)} "
            f"WHEN {t} = 'textual' THEN {text_correct(r, e, r_raw, e_raw)} "
            f"ELSE {cardinal_correct(r, e)} END)")


def yes_verdict(x: str) -> str:
    return f"(CASE WHEN starts_with(lower({ustrip(x)}), 'yes') THEN 1 ELSE 0 END)"
