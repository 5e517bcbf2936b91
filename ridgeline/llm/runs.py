"""Periodic runs of words, found with a recompression grammar.

The words of many documents, numbered and parted by separators that occur once, are compressed in turns: every maximal
block of one symbol becomes one symbol, then every pair of a left and a right symbol does, the symbols being dealt to
left and right by a hash. Equal names stand for equal contents (np.unique names them, no hash does), so the levels are a
run-length grammar of the words. Because a block or pair is cut by its symbols alone, two equal stretches are cut
alike but near their ends; how far two places agree is then found by going up the levels as long as both stand at cuts,
and down again from the first difference: a few steps a level, for all queries of a level at once.

A run of period q and length max(24, 3q) or more holds two places x and x + q for some x of the grid of step
max(24 - q, 2q): these are the candidates, about n log n of them. Extended both ways by the grammar, each gives the
maximal stretch of its period; of the periods of one stretch the least is the run's.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Least words of a run and least times that its period fits.
SHORTEST, TIMES = 24, 3
#: Words of documents that share a grammar (a longer document has one of its own); candidates that are looked at at once.
GROUP, AT_ONCE = 1 << 18, 1 << 21

_ROW = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Grammar:
    """Levels of block and pair compression over an array of numbers, whose first and last occur nowhere else."""

    def __init__(self, letters: np.ndarray):
        # Of each level: its symbols, the place of the first child of each symbol above (and the end), the place above of
        # each symbol, and whether the level above is made of blocks.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []
        s, fresh, turn = letters.astype(np.int64), int(letters.max()) + 1, 0
        while len(s) > 1:
            first = np.concatenate([[True], s[1:] != s[:-1]])
            if not first.all():
                s, fresh = self._blocks(s, first, fresh)
            if len(s) > 1:
                s, fresh = self._pairs(s, fresh, turn)
            turn += 1
        self.top = s

    def _push(self, s: np.ndarray, first: np.ndarray, blocks: bool) -> np.ndarray:
        places = np.flatnonzero(first)
        self.levels.append((s, np.append(places, len(s)), np.cumsum(first) - 1, blocks))
        return places

    def _blocks(self, s: np.ndarray, first: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
        places = self._push(s, first, True)
        length, up = np.diff(np.append(places, len(s))), s[places]
        long = length > 1
        names, named = np.unique(up[long] << 32 | length[long], return_inverse=True)
        up[long] = fresh + named
        return up, fresh + len(names)

    def _pairs(self, s: np.ndarray, fresh: int, turn: int) -> tuple[np.ndarray, int]:
        with np.errstate(over="ignore"):
            mixed = (s.astype(np.uint64) + np.uint64(turn * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        left = (mixed >> np.uint64(63)).astype(bool)
        one, other = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        at = np.flatnonzero(one if one.sum() >= other.sum() else other)
        if not len(at):
            return s, fresh
        names, named = np.unique(s[at] << 32 | s[at + 1], return_inverse=True)
        first = np.ones(len(s), bool)
        first[at + 1] = False
        places, up = self._push(s, first, False), s.copy()
        up[at] = fresh + named
        return up[places], fresh + len(names)

    def agree(self, i: np.ndarray, j: np.ndarray, forward: bool = True) -> np.ndarray:
        """How many symbols from i and from j on (or back) are equal; i != j everywhere."""

        def step(level, a, b, moved):
            """Past the equal symbols that a block of each has left; past one symbol of a pair."""
            s, starts, above, blocks = level
            if not blocks:
                n = 1
            elif forward:
                n = np.minimum(starts[above[a] + 1] - a, starts[above[b] + 1] - b)
            else:
                n = np.minimum(a - starts[above[a]], b - starts[above[b]]) + 1
            n = np.where(moved, n, 0)
            return (a + n, b + n) if forward else (a - n, b - n)

        ids, a, b, differ = np.arange(len(i)), np.asarray(i), np.asarray(j), []
        for level in self.levels:
            s, starts, above, _ = level
            equal = s[a] == s[b]
            differ.append((ids[~equal], a[~equal], b[~equal]))
            ids, a, b = ids[equal], a[equal], b[equal]
            edge = (lambda x: starts[above[x]] == x) if forward else (lambda x: starts[above[x] + 1] - 1 == x)  # noqa: B023
            a, b = step(level, a, b, ~(edge(a) & edge(b)))
            equal = s[a] == s[b]  # where two equal symbols are left after a step, both stand at a cut again
            differ[-1] = tuple(np.concatenate([x, y[~equal]]) for x, y in zip(differ[-1], (ids, a, b), strict=True))
            ids, a, b = ids[equal], above[a[equal]], above[b[equal]]
            if not len(ids):
                break
        ids, a, b = (np.zeros(0, np.int64) for _ in range(3))
        for k in range(len(differ) - 1, -1, -1):
            ids, a, b = (np.concatenate(x) for x in zip((ids, a, b), differ[k], strict=True))
            if k:
                starts = self.levels[k - 1][1]
                a, b = (starts[a], starts[b]) if forward else (starts[a + 1] - 1, starts[b + 1] - 1)
                below = self.levels[k - 1][0]
                a, b = step(self.levels[k - 1], a, b, below[a] == below[b])
        out = np.zeros(len(i), np.int64)
        out[ids] = np.abs(a - np.asarray(i)[ids])
        return out


def _candidates(starts: np.ndarray, sizes: np.ndarray):
    """Places x and x + q of the grids of all documents, in portions; starts are places of first words."""
    doc = np.repeat(np.arange(len(sizes)), sizes // TIMES)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(sizes // TIMES) - sizes // TIMES, sizes // TIMES) + 1
    grid = np.maximum(SHORTEST - q, (TIMES - 1) * q)
    count = (sizes[doc] - 1 - q) // grid + 1
    ends = np.cumsum(count)
    lo = 0
    while lo < len(doc):
        base = ends[lo] - count[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
        n = count[lo:hi]
        pair = np.repeat(np.arange(lo, hi), n)
        k = np.arange(len(pair)) - np.repeat(ends[lo:hi] - n - base, n)
        x = starts[doc[pair]] + k * grid[pair]
        yield x, x + q[pair]
        lo = hi


def find_runs(docs: list[np.ndarray]) -> list[np.ndarray]:
    """The runs of each sequence of numbers below 2^31, as rows of start, length and period in the order of starts."""
    none = np.zeros((0, 3), np.int64)
    long = [k for k, d in enumerate(docs) if len(d) >= SHORTEST]
    out = [none] * len(docs)
    if not long:
        return out
    sizes = np.array([len(docs[k]) for k in long])
    fresh = max(int(docs[k].max()) for k in long) + 1
    # A separator before each document and one after the last: no two equal.
    s = np.concatenate([part for n, k in enumerate(long) for part in ([fresh + n], docs[k])] + [[fresh + len(long)]])
    starts = np.cumsum(sizes + 1) - sizes
    grammar, found = Grammar(s), []
    for x, y in _candidates(starts, sizes):
        # A run has two places or more of which x is one, so a neighbour agrees too.
        near = (s[x] == s[y]) & ((s[x + 1] == s[y + 1]) | (s[x - 1] == s[y - 1]))
        x, y = x[near], y[near]
        begin, end = x - grammar.agree(x - 1, y - 1, forward=False), y + grammar.agree(x, y)
        enough = end - begin >= np.maximum(SHORTEST, TIMES * (y - x))
        found.append(np.stack([begin, end - begin, y - x], axis=1)[enough])
    rows = np.unique(np.concatenate(found), axis=0)
    least = np.ones(len(rows), bool)  # of the periods of one stretch
    least[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[least]
    where = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows[:, 0] -= starts[where]
    cut = np.searchsorted(where, np.arange(len(long) + 1))
    for n, k in enumerate(long):
        out[k] = rows[cut[n] : cut[n + 1]]
    return out


def _order(doc_id, n: int) -> np.ndarray | None:
    """The word that stands at each place of a document with planted runs."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def _report(words: list[bytes], runs: np.ndarray) -> tuple:
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    kept = words if not len(runs) else compress(words, (np.cumsum(drop[:-1]) == 0).tolist())
    text = "".join(f"{s},{length},{p}\n" for s, length, p in runs.tolist())
    best = min(((-Fraction(length, p), s, p, length) for s, length, p in runs.tolist()), default=None)
    row = (best[1], best[3], best[2], 1000 * best[3] // best[2]) if best else (None,) * 4
    return (len(runs), *row, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def collapse(docs: DataFrame, planted: bool = False) -> DataFrame:
    """One row per document: doc_id, n_runs, the run of greatest length / period (start, length, period,
    exponent_milli; nulls without a run), and digests of all runs and of the words without repeats.

    A word is dropped if a run contains it after that run's first period. planted=True first rewrites the documents
    whose id hashes to a multiple of ten (those without an id never), so that known runs exist. Null and empty texts
    have no words; equal rows get equal rows; other columns are not read. One task holds the words of one document, or
    of GROUP words of several: some 200 bytes a word, in texts of less than 2 GiB.
    """

    def each(batches):
        import pyarrow as pa

        schema = None
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            rows, group, size = [], [], 0

            def close(rows=rows):
                number: dict[bytes, int] = {}
                coded = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in group]
                rows += map(_report, group, find_runs(coded))
                group.clear()

            for k in range(len(batch)):
                # bytes.split() parts at exactly the white space that separates words here.
                words = (texts[k].as_py() or "").encode().split()
                order = _order(ids[k].as_py(), len(words)) if planted else None
                if group and size + len(words) > GROUP:
                    close()
                    size = 0
                group.append(words if order is None else [words[x] for x in order.tolist()])
                size += len(words)
            close()
            names = [f.split()[0] for f in _ROW.split(", ")]
            schema = schema or pa.schema([("doc_id", ids.type)] + [(n, pa.string() if n.endswith("256") else pa.int64()) for n in names])
            columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in names]
            yield pa.record_batch([ids, *(pa.array(c, schema.field(n).type) for n, c in zip(names, columns, strict=True))], schema=schema)

    out = StructType().add(docs.schema["doc_id"])
    for f in StructType.fromDDL(_ROW):
        out.add(f)
    return docs.select("doc_id", F.col("text")).mapInArrow(each, out)
