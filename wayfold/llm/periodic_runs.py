"""Periodic runs of words: stretches whose words repeat at a distance, three times or more.

A run has a smallest period q, a length of at least max(LEAST_WORDS, 3 q), and no neighbouring word that keeps the
period. Words are appended one by one to a suffix automaton; its suffix-link tree is kept as a link-cut tree whose
preferred paths carry the last place where their strings ended. Access to the state of the word just appended
recolours its path to the root: each segment of a former colour j, whose deepest string has length m, says that the
last m words also ended at j. A distance d of at most half of m makes a square, and more than one; it is extended to
both sides, and of equal stretches the smallest distance is the period. At a run's last word the string of all its
words but the first q ended q words before, and no later: so every run is met.

Only places that can lie in a run are appended. All but the first q words of a run, 16 at least, occur q words
before, so each word of a run lies in 16 words that occur in its document again: a run lies whole in one of the
stretches that such places make, and no run goes on beyond a stretch. Equal hashes of 16 words only make stretches
longer.

Null and empty texts have no words and no runs. Rows are judged each for itself: repeated rows and null ids give
rows. An empty table gives no rows. Keys may have any names but those of the result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.shared import arrow_rows, own_keys, ship_package, whole

#: Words of a run at least, and its periods at least.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Words that a run shares with itself one period on, at least: 24 - 8, or 2 q for longer periods.
SHARED = 16


class Automaton:
    """Suffix automaton of words, with its suffix links as a link-cut tree coloured by last occurrence.

    A state's number is its node. Splay trees hold the preferred paths by depth; a path's colour is kept lazily.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.left, self.right, self.up = [-1], [-1], [-1]
        self.colour, self.lazy = [-1], [-1]
        self.last = 0

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        for column in (self.link, self.left, self.right, self.up, self.colour, self.lazy):
            column.append(-1)
        return len(self.length) - 1

    def _pushed(self, x: int) -> None:
        c = self.lazy[x]
        if c >= 0:
            for y in (self.left[x], self.right[x]):
                if y >= 0:
                    self.colour[y] = self.lazy[y] = c
            self.lazy[x] = -1

    def splay(self, x: int) -> None:
        """Make x the root of its path's tree."""
        left, right, up, lazy, pushed = self.left, self.right, self.up, self.lazy, self._pushed
        path, y = [x], x
        while (p := up[y]) >= 0 and (left[p] == y or right[p] == y):
            path.append(p)
            y = p
        for y in reversed(path):
            if lazy[y] >= 0:
                pushed(y)

        def rotate(y: int) -> None:
            p = up[y]
            g = up[p]
            if left[p] == y:
                left[p] = b = right[y]
                right[y] = p
            else:
                right[p] = b = left[y]
                left[y] = p
            if b >= 0:
                up[b] = p
            if g >= 0:
                if left[g] == p:
                    left[g] = y
                elif right[g] == p:
                    right[g] = y
            up[y], up[p] = g, y

        while (p := up[x]) >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    def append(self, word: int) -> None:
        """The automaton of one more word; a cloned state is put between a node and its parent."""
        nexts, link, length = self.next, self.link, self.length
        p, new = self.last, self._state(length[self.last] + 1, {})
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        parent = 0
        if p >= 0:
            q = nexts[p][word]
            parent = q
            if length[q] != length[p] + 1:
                parent = self._state(length[p] + 1, dict(nexts[q]))
                self._between(parent, q)
                while p >= 0 and nexts[p].get(word) == q:
                    nexts[p][word] = parent
                    p = link[p]
        link[new] = parent
        self.up[new] = parent  # a new leaf is a path of its own
        self.last = new

    def _between(self, new: int, q: int) -> None:
        """Cut q from its parent and hang it below new, which takes its place and its last occurrence."""
        self.splay(q)
        self.link[new], self.link[q] = self.link[q], new
        above = self.left[q]
        self.colour[new] = self.colour[q]
        self.left[new], self.left[q], self.up[new] = above, new, q
        if above >= 0:
            self.up[above] = new

    def access(self, at: int) -> list[tuple[int, int]]:
        """Colour the path of the last state by at; (former colour, length of the deepest string) of each segment."""
        left, right, up, colour, length = self.left, self.right, self.up, self.colour, self.length
        found, x, below = [], self.last, -1
        while x >= 0:
            self.splay(x)
            if colour[x] >= 0:
                found.append((colour[x], length[x]))
            right[x] = below  # what was deeper on this path keeps its colour and becomes a path of its own
            below, x = x, up[x]
        self.splay(self.last)
        x = self.last
        colour[x] = self.lazy[x] = at
        return found


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """The stretches (start, end) of places in SHARED words that occur again; at least LEAST_WORDS long."""
    if len(ids) < LEAST_WORDS:
        return []
    h = mixed(ids.astype(np.uint64) + np.uint64(1))
    for step in (1, 2, 4, 8):
        h = mixed(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    if not again.any():
        return []
    marks = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + SHARED, -1)
    covered = np.cumsum(marks[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
    return [(s, e) for s, e in edges.reshape(-1, 2).tolist() if e - s >= LEAST_WORDS]


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of a document's word numbers, by start and period."""
    best: dict[tuple[int, int], int] = {}
    for s, e in stretches(ids):
        words = ids[s:e].tolist()
        n, automaton, until = e - s, Automaton(), {}
        for i, word in enumerate(words):
            automaton.append(word)
            for j, m in automaton.access(i):
                d = i - j
                if 2 * d > m or m < SHARED or until.get(d, 0) > i:
                    continue
                start, end = i - m - d + 1, i + 1
                while start > 0 and words[start - 1] == words[start - 1 + d]:
                    start -= 1
                while end < n and words[end] == words[end - d]:
                    end += 1
                until[d] = end
                if end - start >= max(LEAST_WORDS, LEAST_TIMES * d):
                    key = (s + start, s + end)
                    best[key] = min(d, best.get(key, d))
    return sorted((start, end - start, d) for (start, end), d in best.items())


RESULT = "n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, keys: list[str], text: str = "text", loop: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """A row for each row of docs: keys, n_words, n_runs, the run of the greatest length to period (start, length,
    period, exponent_milli; ties: the smallest start, then period), runs_sha256, collapsed_sha256 and all runs.

    A word is collapsed away if a run has it after the run's first period. loop: (hash, divisor, spread) columns that
    make words repeat, as a test of the method: rows with a hash get words[a + (i - a) % p] at each i >= a, where
    a = divisor % n and p = 1 + (n - a) / (3 + spread).
    """
    ship_package(docs.sparkSession)
    arrow_rows(docs.sparkSession)
    names = [c.split()[0] for c in RESULT.split(", ")[:8]] + ["runs"]
    own = own_keys(keys, *names)
    planted = loop or (F.lit(False), F.lit(0), F.lit(0))
    source = docs.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)], whole(F.col(f"`{text}`")).cast("binary").alias("_text"), planted[0].cast("boolean").alias("_on"), planted[1].cast("bigint").alias("_a"), planted[2].cast("bigint").alias("_s"))
    k = len(own)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            out = []
            for text_bytes, on, a, spread in zip(*(b.column(k + c).to_pylist() for c in range(4)), strict=True):
                # bytes.split takes \x20 and \x09-\x0D
                words = text_bytes.split()
                n, known = len(words), {}
                ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
                if on and n:
                    at = np.arange(n)
                    a = a % n
                    p = 1 + (n - a) // (3 + spread)
                    at[a:] = a + (at[a:] - a) % p
                    ids, words = ids[at], [words[i] for i in at.tolist()]
                found = runs(ids)
                said = "".join(f"{s},{m},{q}\n" for s, m, q in found)
                keep = words
                top = (None, None, None, None)
                if found:
                    left = np.ones(n, bool)
                    for s, m, q in found:
                        left[s + q : s + m] = False
                    keep = [words[i] for i in np.flatnonzero(left).tolist()]
                    s, m, q = found[0]
                    for x in found[1:]:
                        if x[1] * q > m * x[2]:
                            s, m, q = x
                    top = (s, m, q, 1000 * m // q)
                out.append((n, len(found), *top, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(keep)).hexdigest(), [dict(zip(("start", "length", "period"), x, strict=True)) for x in found]))
            types = [*[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))]
            columns = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*own, *names])

    types = dict(source.dtypes)
    done = source.mapInArrow(find, ", ".join([*(f"`{o}` {types[o]}" for o in own), RESULT]))
    return done.select(*[F.col(o).alias(c) for o, c in zip(own, keys, strict=True)], *names)
