"""Personal data in texts: fixed patterns, and a semi-Markov CRF for what they miss.

``base_spans`` are the e-mail addresses, IP addresses, card and phone numbers of
fixed patterns and checks.  A pattern that swallows two neighbours (a phone
number and a card number with a blank between them) fails its check and finds
neither.  The model takes such runs apart.

* A text's *islands* are its runs of digit groups with short separators, and
  addresses around an at sign or a bracketed ``at``.  The groups of an island
  are the positions of the chain.
* A *candidate* is a run of at most ``MOST_GROUPS`` groups that could be of a
  kind (enough digits, four parts of at most 255, a Luhn sum that is right).  Its
  features see the whole span: shape, digits, separators, the characters and
  groups on both sides.
* A segmentation labels every group as part of a candidate or as other text.
  Its score is the sum over segments and over pairs of neighbouring labels;
  dynamic programming over end positions and labels finds the best one, and the
  sum over all of them for the fit.
* The model is fitted on islands of a bounded sample of texts
  (``SAMPLE_DOCS``), whose base spans are the labels; islands in which a pattern
  ran past its largest number of digits, or two kinds overlap, are left out there.  Equal examples
  count once with their number, and the ``EXAMPLES`` most frequent are used.

Base spans always stay, and no added span overlaps one.  Offsets are code
points.  Null texts count as empty; ties of segmentations go to the earlier
label as listed; repeated rows each get their row.  A sample without any base
span gives a model that adds nothing.  Columns beside id and text are kept by
``pii_spans`` unless their names clash with its own, which replace them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import small_arrow_batches, table
from evalspark.session import ship_package

QUERY = "op12_pii_spans"
KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000      # texts whose islands teach, at most about
EXAMPLES = 1_000          # different islands of the fit, at most
MOST_GROUPS = 8           # digit groups of one entity
LEARN_GROUPS = 24         # longer islands teach nothing
DIGITS = {"card": (14, 19), "phone": (10, 15)}

ANY = re.compile(r"[0-9@]|[\[(][aA][tT][\])]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBERS = re.compile(r"[0-9]++(?:[\x20()./+-]{1,3}[0-9]++)*+")
GROUP = re.compile(r"[0-9]+")
AT = re.compile(r" ?(?:@|[\[(](?:at|AT|At)[\])]) ?")
SPOKEN = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?[\[(](?:dot|DOT|Dot)[\])] ?)[A-Za-z0-9-]++)+")
LOCAL_MOST = 64
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _fits(kind: str, s: str) -> bool:
    digits = _digits(s)
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in s.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    lo, hi = DIGITS[kind]
    return lo <= len(digits) <= hi and (kind != "card" or luhn(digits))


def _emails(text: str) -> list[Span]:
    """The leftmost match of local@domain, then on from its end.  A match has one
    at sign, so the signs are tried in order."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1] in LOCAL_CHARS):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans by kind, matches of too many digits)."""
    found, over = _emails(text) if "@" in text else [], []
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        if kind == "phone" and "+" not in text:
            continue
        for m in pattern.finditer(text):
            s = m.group()
            if len(s) < 7:
                continue
            if _fits(kind, s):
                found.append((kind, m.start(), m.end()))
            elif kind != "ip" and len(_digits(s)) > DIGITS[kind][1]:
                over.append((kind, m.start(), m.end()))
    return found, over


# ------------------------------------------------------------ islands and candidates
def _side(c: str) -> str:
    return "end" if not c else "space" if c.isspace() else "letter" if c.isalnum() or c == "_" else c


def _number_islands(text: str) -> Iterator[list[tuple[int, int]]]:
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() >= 7 and len(_digits(m.group())) >= 7:
            yield [(m.start() + g.start(), m.start() + g.end()) for g in GROUP.finditer(m.group())]


def _number_candidates(text: str, groups: list[tuple[int, int]]):
    """(first group, group after, kind, start, end, features)."""
    for i, (a, _) in enumerate(groups):
        digits = 0
        for j in range(i, min(len(groups), i + MOST_GROUPS)):
            digits += groups[j][1] - groups[j][0]
            if digits > 19:
                break
            if digits < 7 and j - i != 3:
                continue
            end = groups[j][1]
            inner = text[a:end]
            start = a
            if start and text[start - 1] == "(" and ")" in inner:
                start -= 1
            if start and text[start - 1] == "+":
                start -= 1
            kinds = [k for k in ("card", "phone") if _fits(k, inner)]
            if j - i == 3 and re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", inner) and _fits("ip", inner):
                kinds.append("ip")
            if not kinds:
                continue
            span = text[start:end]
            shape = GROUP.sub(lambda m: str(len(m.group())), span)[:40]
            before, after = text[start - 1:start], text[end:end + 1]
            left = text[groups[i - 1][1]:start] if i else "none"
            right = text[end:groups[j + 1][0]] if j + 1 < len(groups) else "none"
            seen = ["any", f"shape {shape}", f"form {GROUP.sub('d', span)[:40]}", f"digits {digits}",
                    f"plus {span[0] == '+'}", f"left {_side(before)}", f"right {_side(after)}",
                    f"left group {left}", f"right group {right}"]
            for k in kinds:
                yield i, j + 1, k, start, end, [f"{k} {s}" for s in seen]


def _address_islands(text: str) -> Iterator[tuple]:
    """One candidate each: an address around an at sign, perhaps spelt out."""
    for m in AT.finditer(text):
        before = LOCAL_END.search(text[max(0, m.start() - LOCAL_MOST):m.start()])
        domain = SPOKEN.match(text, m.end())
        if not before or not domain:
            continue
        start, end = m.start() - len(before.group()), domain.end()
        last = domain.group().rsplit(".", 1)[-1].strip(" )]")
        sign = "spelt" if "@" not in m.group() else "plain" if m.group() == "@" else "spaced"
        seen = ["any", f"sign {sign}", f"dots {'plain' if '(' not in domain.group() and '[' not in domain.group() else 'spelt'}",
                f"last {last.isalpha() and len(last) >= 2}", f"left {_side(text[start - 1:start])}",
                f"right {_side(text[end:end + 1])}", f"local {min(len(before.group()) // 4, 8)}"]
        yield 0, 1, "email", start, end, [f"email {s}" for s in seen]


def islands(text: str) -> Iterator[tuple[int, list]]:
    """(positions, candidates) of every island of the text."""
    for groups in _number_islands(text):
        yield len(groups), list(_number_candidates(text, groups))
    for c in _address_islands(text):
        yield 1, [c]


# ------------------------------------------------------------ the chain
OTHER = len(KINDS)  # label of a group outside all entities


def _pairs(weights: dict) -> np.ndarray:
    """Weights of neighbouring labels; the row after the last label is the start."""
    names = [*KINDS, "other"]
    return np.array([[weights.get(f"{a} then {b}", 0.0) for b in names] for a in [*names, "start"]])


def decode(n: int, candidates: list, weights: dict, pairs: np.ndarray) -> list:
    """The best segmentation's candidates."""
    ends: dict[int, list] = {}
    for c in candidates:
        ends.setdefault(c[1], []).append((c[0], KINDS.index(c[2]), sum(weights.get(f, 0.0) for f in c[5]), c))
    best = np.full((n + 1, len(KINDS) + 2), -np.inf)
    best[0, -1] = 0.0
    back: dict[tuple[int, int], tuple] = {}
    for at in range(1, n + 1):
        for i, label, score, c in [*ends.get(at, []), (at - 1, OTHER, 0.0, None)]:
            total = best[i] + pairs[:, label] + score
            prev = int(np.argmax(total))
            if total[prev] > best[at, label]:
                best[at, label] = total[prev]
                back[at, label] = (i, prev, c)
    at, label, out = n, int(np.argmax(best[n])), []
    while at:
        at, label, c = back[at, label]
        if c is not None:
            out.append(c)
    return out[::-1]


def _logsum(x: np.ndarray) -> float:
    m = x.max()
    return m if m == -np.inf else float(m + np.log(np.exp(x - m).sum()))


def gradient(n: int, candidates: list, gold: set, weights: np.ndarray, pair_at: np.ndarray):
    """(log-likelihood, gradient as {weight: value}) of one labelled island.
    ``candidates``: (first, after, label, feature numbers)."""
    arcs: list[tuple] = [(i, i + 1, OTHER, ()) for i in range(n)] + candidates
    scores = [float(sum(weights[list(f)])) if f else 0.0 for *_, f in arcs]
    pairs = weights[pair_at]
    wide = len(KINDS) + 2
    fwd = np.full((n + 1, wide), -np.inf)
    fwd[0, -1] = 0.0
    by_end = sorted(range(len(arcs)), key=lambda a: arcs[a][1])
    for a in by_end:
        i, j, label, _ = arcs[a]
        fwd[j, label] = np.logaddexp(fwd[j, label], _logsum(fwd[i] + pairs[:, label]) + scores[a])
    bwd = np.full((n + 1, wide), -np.inf)
    bwd[n] = 0.0
    for a in sorted(range(len(arcs)), key=lambda a: -arcs[a][0]):
        i, j, label, _ = arcs[a]
        bwd[i] = np.logaddexp(bwd[i], pairs[:, label] + scores[a] + bwd[j, label])
    z = bwd[0, -1]
    grad: dict[int, float] = {}
    covered, likelihood = np.zeros(n, bool), 0.0
    for i, j, _ in gold:
        covered[i:j] = True
    chosen = {}
    for a, (i, j, label, f) in enumerate(arcs):
        p = np.exp(fwd[i] + pairs[:, label] + scores[a] + bwd[j, label] - z)
        is_gold = (i, j, label) in gold if label != OTHER else not covered[i]
        if is_gold:
            chosen[i] = (j, label, scores[a])
        for w in f:
            grad[w] = grad.get(w, 0.0) + float(is_gold) - float(p.sum())
        for prev in range(wide):
            if p[prev] > 0:
                w = int(pair_at[prev, label])
                grad[w] = grad.get(w, 0.0) - float(p[prev])
    at, prev = 0, wide - 1
    while at < n:
        j, label, score = chosen[at]
        likelihood += score + pairs[prev, label]
        w = int(pair_at[prev, label])
        grad[w] = grad.get(w, 0.0) + 1.0
        at, prev = j, label
    return likelihood - z, grad


def fit(examples: list[tuple[str, int]], rounds: int = 60, decay: float = 1e-3, rate: float = 0.5) -> dict[str, float]:
    """Weights by adaptive gradient ascent on the penalised likelihood.
    ``examples``: (labelled island as JSON, how often it occurs)."""
    names = [*KINDS, "other"]
    number: dict[str, int] = {}
    pair_at = np.array([[number.setdefault(f"{a} then {b}", len(number)) for b in names] for a in [*names, "start"]])
    data = []
    for text, count in examples:
        n, candidates, gold = json.loads(text)
        data.append((n, [(i, j, KINDS.index(k), tuple(number.setdefault(f, len(number)) for f in fs))
                         for i, j, k, fs in candidates], {(i, j, KINDS.index(k)) for i, j, k in gold}, np.log1p(count)))
    weights, seen = np.zeros(len(number)), np.full(len(number), 1e-6)
    total = sum(c for *_, c in data) or 1.0
    for _ in range(rounds):
        g = -decay * weights
        for n, candidates, gold, count in data:
            for w, v in gradient(n, candidates, gold, weights, pair_at)[1].items():
                g[w] += count * v / total
        seen += g * g
        weights = weights + rate * g / np.sqrt(seen)
    return {f: float(weights[i]) for f, i in number.items() if weights[i]}


def labelled(text: str) -> Iterator[str]:
    """Islands of the text with their base spans, as JSON."""
    found, over = base_spans(text)
    spans = set(found)
    for n, candidates in islands(text):
        if not candidates or n > LEARN_GROUPS:
            continue
        lo, hi = min(c[3] for c in candidates), max(c[4] for c in candidates)
        if any(a < hi and lo < b for _, a, b in over):
            continue
        gold = sorted((i, j, k) for i, j, k, a, b, _ in candidates if (k, a, b) in spans)
        if any(x[1] > y[0] for x, y in zip(gold, gold[1:])):
            continue
        yield json.dumps([n, [(i, j, k, f) for i, j, k, _, _, f in candidates], gold])


# ------------------------------------------------------------ the operator
def _joined(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def find(text: str, weights: dict, pairs: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(base spans, spans that the model adds)."""
    if not ANY.search(text):
        return [], []
    base, _ = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    ends = np.maximum.accumulate(np.array([b for _, b in taken])) if taken else np.zeros(0)
    added: list[Span] = []

    def free(c) -> bool:
        k = int(np.searchsorted(starts, c[4]))  # base spans that begin before the candidate's end
        return not k or ends[k - 1] <= c[3]

    for n, candidates in islands(text):
        open_ = [c for c in candidates if free(c)]
        if open_:
            added += [(c[2], c[3], c[4]) for c in decode(n, open_, weights, pairs)]
    # Islands of numbers and of addresses may cross: the earlier span stays.
    out: list[Span] = []
    for s in sorted(added, key=lambda s: (s[1], KINDS.index(s[0]))):
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return base, out


def learn(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE_DOCS, examples: int = EXAMPLES) -> dict[str, float]:
    """Weights learnt from about ``sample`` texts, chosen by a hash of the text."""
    spark = docs.sparkSession
    ship_package(spark)
    small_arrow_batches(spark)
    n = max(1, docs.count())
    text = F.coalesce(F.col(text_col), F.lit(""))
    share = min(1.0, sample / n)
    part = docs.select(text.alias("text")).filter(
        F.col("text").rlike("[0-9@]") & (F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"example": [e for t in b["text"] for e in labelled(t)]})

    rows = (part.mapInPandas(fn, "example string").groupBy("example").count()
            .orderBy(F.col("count").desc(), "example").limit(examples).collect())
    data = [(r["example"], r["count"]) for r in rows]
    if not any(json.loads(e)[2] for e, _ in data):
        return {}
    return fit(data)


def pii_spans(docs: DataFrame, weights: dict[str, float], text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_email``, ``n_ip``, ``n_card``, ``n_phone``
    (base spans), ``base`` and ``spans`` (arrays of kind, start, end; ``spans`` holds the added
    ones too), ``base_sha256`` and ``spans_text``."""
    spark = docs.sparkSession
    ship_package(spark)
    small_arrow_batches(spark)
    own = {"n_email", "n_ip", "n_card", "n_phone", "base", "spans", "base_sha256", "spans_text", "_text"}
    kept = [c for c in docs.columns if c not in own and c != text_col]
    rows = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema]
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    schema = ", ".join([*fields, *[f"n_{k} bigint" for k in KINDS], f"base {span}", f"spans {span}",
                        "base_sha256 string", "spans_text string"])

    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(weights)
        for b in batches:
            base, every = [], []
            for t in b.column("_text").to_pylist():
                found, added = find(t, weights, pairs) if weights else (base_spans(t)[0], [])
                base.append(found)
                every.append(found + added)
            pack = lambda f: [{"kind": k, "start": a, "end": e} for k, a, e in f]
            cols = {c: b.column(c) for c in kept}
            cols |= {f"n_{k}": pa.array([sum(s[0] == k for s in f) for f in base], pa.int64()) for k in KINDS}
            cols["base"] = pa.array([pack(f) for f in base], spans_type)
            cols["spans"] = pa.array([pack(f) for f in every], spans_type)
            cols["base_sha256"] = pa.array([hashlib.sha256(_joined(f).encode()).hexdigest() for f in base], pa.string())
            cols["spans_text"] = pa.array([_joined(f) for f in every], pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return rows.mapInArrow(fn, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ``base_sha256`` are of the base spans; ``spans`` lists all."""
    docs = table(spark, sf_dir, "documents")
    found = pii_spans(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
                        F.col("spans_text").alias("spans"), (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"))
