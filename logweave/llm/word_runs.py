"""Periodic runs of words: a suffix automaton whose tree of suffix links is kept by link-cut access.

Each appended word makes a state of the automaton. The path from it to the root holds all suffixes
of the text so far; link-cut access recolours that path with the word's number, and gives the old
colours on it, segment by segment. A segment of colour j whose deepest state has length L says that
the last L words before and at j are those at the end now, and that j is their last occurrence. With
q = now - j, L >= q is a square of period q, and the L + q words that end here have period q and no
word more at the left. If the next word breaks the period, they are a run. Of a run of at least three
periods the last word gives this segment exactly once and with the smallest period (Fine and Wilf).

A run's first L words come again q later, L being two thirds of it or more, so each of its words lies
in a window of that many words which comes twice in the run. Only stretches of words that such windows
cover within the same stretch go to the automaton; anything else of a text holds no run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.arrow import small, utf8
from logweave.llm.near_copies import _hashes
from logweave.llm.words import utf8_words

MIN_LENGTH, MIN_PERIODS = 24, 3
_ODD = np.uint64(0x9E3779B97F4A7C15)


class SuffixPaths:
    """A suffix automaton and its suffix-link tree as a link-cut forest; `append` gives the old colours met.

    States are numbers from 1, the root; 0 is none. Most states have one transition, which is held in
    two lists; further ones are in a dict. A preferred path is a splay tree by depth, its colour at
    the splay tree's root.
    """

    def __init__(self, most: int):
        size = 2 * most + 2
        self.n, self.states, self.last = 0, 1, 1
        self.length, self.link = [0] * size, [0] * size
        self.word, self.to, self.more = [-1] * size, [0] * size, {}
        self.up, self.left, self.right, self.colour = [0] * size, [0] * size, [0] * size, [-1] * size

    def _step(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        return self.more[state].get(word, 0) if state in self.more else 0

    def _set(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _splay(self, x: int) -> None:
        """Makes x the root of its splay tree; the path's colour moves along."""
        up, left, right = self.up, self.left, self.right
        y = up[x]
        while y and (left[y] == x or right[y] == x):
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if not inner:
                self.colour[x] = self.colour[y]
                self._rotate(x, y, z)
                return
            self._rotate(y, z, up[z]) if (left[z] == y) == (left[y] == x) else self._rotate(x, y, z)
            below = up[x]
            top = up[below]
            if not (top and (left[top] == below or right[top] == below)):
                self.colour[x] = self.colour[z]
            self._rotate(x, below, top)
            y = up[x]

    def _rotate(self, x: int, y: int, z: int) -> None:
        """Lifts x above its splay parent y, whose parent (of either kind) is z."""
        up, left, right = self.up, self.left, self.right
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b:
            up[b] = y
        up[y], up[x] = x, z
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def _clone(self, q: int, length: int) -> int:
        """A state of q's transitions right above q in the tree, on q's path and so of its colour."""
        self.states += 1
        c = self.states
        self.length[c], self.link[c], self.word[c], self.to[c] = length, self.link[q], self.word[q], self.to[q]
        if q in self.more:
            self.more[c] = dict(self.more[q])
        self._splay(q)
        above = self.left[c] = self.left[q]
        if above:
            self.up[above] = c
        self.left[q], self.up[c] = c, q
        return c

    def append(self, word: int) -> list[tuple[int, int]]:
        """Appends a word; gives (last end, length) of each segment on its path: where the longest suffix in it ended last."""
        length, link = self.length, self.link
        self.states += 1
        new, p = self.states, self.last
        length[new] = length[p] + 1
        while p and not self._step(p, word):
            self._set(p, word, new)
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = self._step(p, word)
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                c = self._clone(q, length[p] + 1)
                while p and self._step(p, word) == q:
                    self._set(p, word, c)
                    p = link[p]
                link[q] = link[new] = c
        self.last = new
        self.up[new] = link[new]
        out, below, v = [], new, link[new]
        while v:
            self._splay(v)
            out.append((self.colour[v], length[v]))
            cut = self.right[v]
            if cut:
                self.colour[cut] = self.colour[v]
            self.right[v], self.up[below] = below, v
            below, v = v, self.up[v]
        self.colour[below] = self.n
        self.n += 1
        return out


def stretch_runs(words: list[int], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of `words`, which must have at least three periods (the bound needs it)."""
    paths, n, out, most = SuffixPaths(len(words)), len(words), [], min_periods - 1
    for i, word in enumerate(words):
        for end, length in paths.append(word):
            q = i - end
            if length >= most * q and length + q >= min_length and (i + 1 == n or words[i + 1] != words[i + 1 - q]):
                out.append((i + 1 - q - length, length + q, q))
    return out


def _windows(one: np.ndarray, span: int) -> np.ndarray:
    """A hash of each `span` words on end, from hashes of single words."""
    out, have = None, 0
    part, wide = one, 1
    while True:
        if span & wide:
            out = part if out is None else (out[: len(one) - have - wide + 1] * _ODD) ^ (part[have:] * np.uint64(wide * 2 + 1))
            have += wide
        if have == span:
            return out
        part = (part[:-wide] * _ODD) ^ (part[wide:] >> np.uint64(7)) ^ part[wide:]
        wide *= 2


def stretches(one: np.ndarray, owner: np.ndarray, span: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of one owner that windows of `span` words cover which come twice in the stretch."""
    at, part = np.arange(len(one)), owner
    while len(at) > span:
        inside = part[: len(at) - span + 1] == part[span - 1 :]
        first = np.flatnonzero(inside)
        keys = (_windows(one[at], span)[first] ^ (part[first].astype(np.uint64) * _ODD)) * _ODD
        order = np.argsort(keys)
        same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
        twice = first[np.unique(np.concatenate([order[same], order[same + 1]]))]
        steps = np.zeros(len(at) + 1, np.int64)
        np.add.at(steps, twice, 1)
        np.add.at(steps, twice + span, -1)
        covered = np.cumsum(steps[:-1]) > 0
        left = np.flatnonzero(covered)
        if not len(left):
            return []
        new = np.concatenate([[True], (np.diff(left) > 1) | (part[left][1:] != part[left][:-1])])
        if len(left) == len(at):
            starts = np.flatnonzero(new)
            return [(int(at[a]), int(at[b - 1]) + 1) for a, b in pairwise([*starts.tolist(), len(at)])]
        at, part = at[left], np.cumsum(new)
    return []


def text_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text, given as words, by start and then period."""
    known, out = _hashes(42), [[] for _ in texts]
    sizes = [len(w) for w in texts]
    starts = np.cumsum([0, *sizes])
    one = np.fromiter((known[x] for w in texts for x in w), np.uint64, int(starts[-1]))
    owner = np.repeat(np.arange(len(texts)), sizes)
    span = -(-min_length * (min_periods - 1) // min_periods)
    for a, b in stretches(one, owner, span):
        t = int(owner[a])
        at, ids = a - int(starts[t]), {}
        words = [ids.setdefault(x, len(ids)) for x in texts[t][at : at + b - a]]
        out[t] += [(s + at, n, q) for s, n, q in stretch_runs(words, min_length, min_periods)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those of a run after its first period."""
    steps = [0] * (len(words) + 1)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    out, inside = [], 0
    for word, step in zip(words, steps):  # noqa: B905
        inside += step
        if not inside:
            out.append(word)
    return out


def highest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; then the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def with_planted_periods(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Words that repeat from some place on, for the tenth of ids whose hash asks for it. A null id has none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


FIELDS = (
    ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("n_dropped", pa.int64()),
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.list_(pa.int64()))), ("collapsed", pa.string()),
)
_SQL = {pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.list_(pa.int64())): "array<array<bigint>>"}


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS, planted: bool = False, whole: bool = False) -> DataFrame:
    """The id and what FIELDS names: the number of runs, the highest one, digests, and if `whole` all runs (start, length, period) and the collapsed text.

    A run is a longest stretch of words with smallest period q, of at least `min_length` words and
    `min_periods` (3 or more) periods. Collapsing keeps a run's first period. `planted` first makes
    the tails of a tenth of the texts periodic. Null and empty texts have no words and no run, whose
    columns are null then. Each row is judged alone, repeated rows alike; null ids stay null. Other
    columns aren't carried. There's no shuffle; a batch holds 2 MB of text or one text.
    """
    if min_periods < 3:
        raise ValueError("runs of fewer than three periods may have a smaller one")
    fields = FIELDS if whole else FIELDS[:-2]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            ids = b.column(1).to_pylist()
            texts = [utf8_words(t or b"") for t in utf8(b.column(0))]
            if planted:
                texts = [with_planted_periods(w, i) for w, i in zip(texts, ids, strict=True)]
            rows = []
            for words, runs in zip(texts, text_runs(texts, min_length, min_periods), strict=True):
                top, kept = highest(runs), collapsed(words, runs) if runs else words
                joined = b" ".join(kept)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
                rows.append((len(words), len(runs), *best, len(words) - len(kept), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(joined).hexdigest(), *([[list(r) for r in runs], joined.decode()] if whole else [])))
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True))], [id_col, *(n for n, _ in fields)])

    schema = ", ".join([f"`{id_col}` bigint", *(f"{n} {_SQL[k]}" for n, k in fields)])
    return docs.select(F.col(text).cast("string"), F.col(id_col).cast("bigint")).mapInArrow(found, schema)
