"""Weighted acyclic automata over words, built from sorted phrases.

A state is the tuple of its arcs (word, count, next state); the count on an arc
is that of the phrase that ends with it, 0 if the arc only leads on.  Equal
states are one, so phrases share their beginnings, and endings with equal
counts are shared too.

Many phrases are held as rows of numbers: one column per place of a phrase with
the number of the word there plus one, or 0 beyond the phrase's end.  A row
takes some 20 bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np

Phrase = tuple[bytes, ...]
END = 0  # the state without arcs
SUMMED = 1 << 20  # rows that are added up at once, at least
A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


# ------------------------------------------------------------ rows
def _order(cols: list[np.ndarray]) -> np.ndarray:
    """Rows in the order of their columns, the first one first."""
    bits = [int(c.max(initial=0)).bit_length() for c in cols]
    if sum(bits) > 63:
        return np.lexsort(cols[::-1])
    key = np.zeros(len(cols[0]), np.int64)
    for c, b in zip(cols, bits):
        key <<= b
        key |= c
    return np.argsort(key, kind="stable")


def _differs(cols: list[np.ndarray]) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.ones(len(cols[0]), bool)
    if len(out):
        out[1:] = cols[0][1:] != cols[0][:-1]
        for c in cols[1:]:
            out[1:] |= c[1:] != c[:-1]
    return out


def _phrases(words: list[bytes], cols: list[np.ndarray], counts: np.ndarray) -> Iterator[tuple[Phrase, int]]:
    step = 1 << 14
    for at in range(0, len(counts), step):
        part = [c[at:at + step].tolist() for c in cols]
        for *row, n in zip(*part, counts[at:at + step].tolist()):
            yield tuple(words[w - 1] for w in row if w), n


class Sums:
    """Adds up the counts of equal phrases, whatever order they come in.

    Rows that came since the last time are added up as soon as they are as many
    as ``most`` and as the different phrases so far, so memory follows the
    different phrases, not all rows."""

    def __init__(self, most: float = SUMMED):
        self.most, self.number = most, {}
        self.blocks: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.rows = self.different = 0

    def add(self, words: list[bytes], cols: list[np.ndarray], counts: np.ndarray) -> None:
        number = self.number
        to = np.array([0, *[number.setdefault(w, len(number) + 1) for w in words]], np.int32)
        self.blocks.append(([to[c] for c in cols], counts))
        self.rows += len(counts)
        if self.rows - self.different >= max(self.most, self.different):
            self._sum()

    def _sum(self) -> None:
        if len(self.blocks) == 1:
            cols, counts = self.blocks.pop()
        else:
            width = max((len(cols) for cols, _ in self.blocks), default=1)
            cols = [np.concatenate([b[j] if j < len(b) else np.zeros(len(n), np.int32) for b, n in self.blocks]
                                   or [np.zeros(0, np.int32)]) for j in range(width)]
            counts = np.concatenate([n for _, n in self.blocks] or [np.zeros(0, np.int64)])
            self.blocks.clear()
        order = _order(cols)
        for j, c in enumerate(cols):
            cols[j] = c[order]
        counts = counts[order]
        head = np.flatnonzero(_differs(cols))
        if len(head) < len(counts):
            cols, counts = [c[head] for c in cols], np.add.reduceat(counts, head)
        self.blocks, self.rows, self.different = [(cols, counts)], len(counts), len(counts)

    def sums(self) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
        """(ascending words, columns, counts) of the phrases in order, each once."""
        words = sorted(self.number)
        to = np.zeros(len(words) + 1, np.int32)
        to[[self.number[w] for w in words]] = np.arange(1, len(words) + 1)
        for cols, _ in self.blocks:
            for j, c in enumerate(cols):
                cols[j] = to[c]
        self.number = {w: i for i, w in enumerate(words, 1)}
        self._sum()
        return words, *self.blocks[0]


# ------------------------------------------------------------ automata
class Automaton:
    """Arcs of the start, then of every state, as arrays; arcs of a state are in
    the order of their words."""

    def __init__(self, words: list[bytes], word: np.ndarray, count: np.ndarray, to: np.ndarray, sizes: np.ndarray):
        self.words, self.word, self.count, self.to, self.sizes = words, word, count, to, sizes
        self.at = np.cumsum(sizes) - sizes

    @property
    def states(self) -> list[tuple]:
        arcs = list(zip([self.words[w] for w in self.word], self.count.tolist(), self.to.tolist()))
        return [tuple(arcs[a:a + n]) for a, n in zip(self.at[1:].tolist(), self.sizes[1:].tolist())]

    def __iter__(self) -> Iterator[tuple[Phrase, int]]:
        """All phrases with their counts, in order."""
        cols, counts = self.rows()
        order = _order(cols)
        return _phrases(self.words, [c[order] for c in cols], counts[order])

    def rows(self) -> tuple[list[np.ndarray], np.ndarray]:
        """(columns, counts) of all phrases, shorter ones first."""
        arc, path, levels = np.arange(self.sizes[0]), [], []
        while len(arc):
            path = [*path, (self.word[arc] + 1).astype(np.int32)]
            kept = self.count[arc] > 0
            levels.append(([p[kept] for p in path], self.count[arc][kept]))
            to = self.to[arc] + 1
            path = [np.repeat(p, self.sizes[to]) for p in path]
            arc = _spans(self.at[to], self.sizes[to])
        if not levels:
            return [np.zeros(0, np.int32)], np.zeros(0, np.int64)
        none = [np.zeros(len(n), np.int32) for _, n in levels]
        return ([np.concatenate([p[j] if j < len(p) else z for (p, _), z in zip(levels, none)]) for j in range(len(levels))],
                np.concatenate([n for _, n in levels]))

    def dumps(self) -> bytes:
        parts = [np.array([len(w) for w in self.words], np.int64), self.word, self.count, self.to, self.sizes]
        parts = [p.astype(np.min_scalar_type(int(p.max(initial=0)))) for p in parts]
        text = b"".join(self.words)
        head = np.array([len(text), *[x for p in parts for x in (len(p), p.itemsize)]], np.int64)
        return zlib.compress(b"".join([head.tobytes(), text, *[p.tobytes() for p in parts]]), 1)


def loads(data: bytes) -> Automaton:
    raw = zlib.decompress(data)
    n_text, *shapes = np.frombuffer(raw, np.int64, 11).tolist()
    text, at, parts = raw[88:88 + n_text], 88 + n_text, []
    for n, size in zip(shapes[::2], shapes[1::2]):
        parts.append(np.frombuffer(raw, f"u{size}", n, at).astype(np.int64))
        at += n * size
    ends = np.cumsum(parts[0]).tolist()
    return Automaton([text[a:b] for a, b in zip([0, *ends], ends)], *parts[1:])


def _alike(sizes: np.ndarray, word: np.ndarray, count: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first state of each kind, kind of each state) of states given by their arcs."""
    at = np.cumsum(sizes) - sizes
    x = word.astype(np.uint64) * A + count.astype(np.uint64) * B + to.astype(np.uint64) * C
    x = (x ^ (x >> np.uint64(32))) * D
    _, first, kind = np.unique(np.add.reduceat(x ^ (x >> np.uint64(29)), at), return_index=True, return_inverse=True)
    model = first[kind]
    if (sizes == sizes[model]).all():
        there = _spans(at[model], sizes)
        if all((c == c[there]).all() for c in (word, count, to)):
            return first, kind
    # Two states that differ have the same hash.
    arcs, register = np.column_stack([word, count, to]), {}
    kind = np.array([register.setdefault(arcs[a:a + n].tobytes(), len(register))
                     for a, n in zip(at.tolist(), sizes.tolist())])
    return np.unique(kind, return_index=True)[1], kind


def of_rows(words: list[bytes], cols: list[np.ndarray], counts: np.ndarray) -> Automaton:
    """The smallest automaton of different phrases in order; ``words`` ascend."""
    used = np.unique(np.concatenate([[0], *cols]))[1:]
    words = [words[w - 1] for w in used.tolist()]
    # The tree of the phrases: node 0 is the start, then all of one depth follow, in order.
    differs, up, nodes, parts = np.zeros(len(counts), bool), np.zeros(len(counts), np.int64), 1, []
    differs[:1] = True
    for d, c in enumerate(cols):
        differs[1:] |= c[1:] != c[:-1]
        begins = differs & (c > 0)
        at = np.flatnonzero(begins)
        if not len(at):
            break
        ends = cols[d + 1][at] == 0 if d + 1 < len(cols) else True
        parts.append((np.searchsorted(used, c[at]), np.where(ends, counts[at], 0), up[at]))
        up = nodes - 1 + np.cumsum(begins)
        nodes += len(at)
    if not parts:
        return Automaton([], *[np.zeros(0, np.int64)] * 3, np.zeros(2, np.int64))
    word, count, parent = (np.concatenate(x) for x in zip(*parts))
    sizes = np.bincount(parent, minlength=nodes)
    first = np.cumsum(sizes) - sizes
    # Nodes as far from their farthest end as each other can be the same state.
    height, stop = np.zeros(nodes, np.int64), nodes
    for _, _, p in reversed(parts):
        head = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        height[p[head]] = np.maximum.reduceat(height[stop - len(p):stop], head) + 1
        stop -= len(p)
    state, found = np.zeros(nodes, np.int64), 1
    out = [(word[:sizes[0]], count[:sizes[0]], None, sizes[:1]), (*[np.zeros(0, np.int64)] * 3, np.zeros(1, np.int64))]
    for h in range(1, int(height[0])):
        at = np.flatnonzero(height == h)
        arcs = _spans(first[at], sizes[at])
        model, kind = _alike(sizes[at], word[arcs], count[arcs], state[arcs + 1])
        state[at] = found + kind
        found += len(model)
        arcs = _spans(first[at[model]], sizes[at[model]])
        out.append((word[arcs], count[arcs], state[arcs + 1], sizes[at[model]]))
    out[0] = (*out[0][:2], state[1:1 + sizes[0]], sizes[:1])
    return Automaton(words, *[np.concatenate(x) for x in zip(*out)])


def build(phrases: Iterable[tuple[Phrase, int]]) -> Automaton:
    sums, last = Sums(), None
    kept: list[Phrase] = []
    counts: list[int] = []
    for phrase, count in phrases:
        if last is not None and phrase <= last:
            raise ValueError("phrases must ascend")
        last = phrase
        kept.append(phrase)
        counts.append(count)
    words = sorted({w for p in kept for w in p})
    number = {w: i for i, w in enumerate(words, 1)}
    width = max(map(len, kept), default=1)
    rows = np.array([[*[number[w] for w in p], *[0] * (width - len(p))] for p in kept], np.int32).reshape(-1, width)
    sums.add(words, list(rows.T), np.array(counts, np.int64))
    return of_rows(*sums.sums())


def summed(automata: Iterable[Automaton]) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """(ascending words, columns, counts): the phrases of any of ``automata`` in
    order, their counts summed.  One automaton at a time is asked for."""
    sums = Sums()
    for a in automata:
        sums.add(a.words, *a.rows())
    return sums.sums()


def union(automata: Iterable[Automaton]) -> Iterator[tuple[Phrase, int]]:
    """Phrases of any of ``automata`` in order, their counts summed."""
    return _phrases(*summed(automata))


def compose(asked: Automaton, counts: Automaton) -> Iterator[tuple[Phrase, int]]:
    """The asked phrases with their count in ``counts``: both automata are walked
    together, along equal words only."""
    number = {w: i for i, w in enumerate(counts.words)}
    there = np.array([number.get(w, -1) for w in asked.words], np.int64)
    width = max(1, len(counts.words))
    arcs = np.repeat(np.arange(len(counts.sizes)), counts.sizes) * width + counts.word
    a, state, path = np.arange(asked.sizes[0]), np.zeros(asked.sizes[0], np.int64), []
    while len(a) and len(arcs):
        word = there[asked.word[a]]
        b = np.minimum(np.searchsorted(arcs, state * width + word), len(arcs) - 1)
        hit = np.flatnonzero((word >= 0) & (arcs[b] == state * width + word))
        a, b = a[hit], b[hit]
        path = [*[p[hit] for p in path], (asked.word[a] + 1).astype(np.int32)]
        both = (asked.count[a] > 0) & (counts.count[b] > 0)
        yield from _phrases(asked.words, [p[both] for p in path], counts.count[b][both])
        to = asked.to[a] + 1
        n = asked.sizes[to]
        path, state = [np.repeat(p, n) for p in path], np.repeat(counts.to[b] + 1, n)
        a = _spans(asked.at[to], n)
