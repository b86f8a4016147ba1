"""Periodic runs of words by a suffix automaton and link-cut accesses.

A run is a stretch of consecutive words with smallest period q and length >= max(12, 2q)
that no neighbouring word extends.  The suffix automaton of a word sequence is built first.
Its suffix links form a tree; the words are then appended once more, and appending word i
*accesses* the path from the state of prefix i to the root: the preferred paths of a
link-cut tree are exactly the segments of states whose strings last ended at one place.  A
segment on that path that last ended at p holds the suffixes of lengths (upper, lower]; when
q = i - p lies in that interval, the last q words ended before at i - q and not later, so
words i - 2q + 1 .. i are a square whose root is primitive, that is, q is its smallest
period.  The path takes the colour i.  A run of period q shows such a square at each i from
its start + 2q - 1 to its end, so reports of one q at consecutive i are one run and nothing
is compared word by word.  O(n log^2 n) for n words, whatever they repeat.

Only stretches that can hold a run are given to the automaton: each run of length >= 12
lies wholly in words covered by six-word windows that occur twice in its text (its words
recur at distance q for at least six words on).  Windows are compared by a 64-bit hash; equal
hashes of different windows only make a stretch longer.

How it runs.  One pass over the texts without a shuffle; a text is one row of one task.  A
stretch of m words takes some 500 bytes a word while it is worked on.

Defined cases: a null text has no words; a null doc_id asks for no repetition (``h`` of the
query); rows that share an id are worked on by themselves; an empty table gives an empty result.
"""

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 12  # words of the shortest run
WINDOW = LEAST // 2

_BATCH_ROWS = 1024


class SuffixAutomaton:
    """States 0 (root) on with their longest length and suffix link; ``ends`` are the states of the prefixes."""

    def __init__(self, words: Sequence[int]):
        self.size, self.link, self.ends = [0], [-1], []
        size, link, ends = self.size, self.link, self.ends
        move: list[dict[int, int]] = [{}]
        last = 0
        for word in words:
            new = len(size)
            size.append(size[last] + 1)
            link.append(0)
            move.append({})
            at = last
            while at >= 0 and word not in move[at]:
                move[at][word] = new
                at = link[at]
            if at >= 0:
                target = move[at][word]
                if size[target] != size[at] + 1:
                    clone = len(size)
                    size.append(size[at] + 1)
                    link.append(link[target])
                    move.append(move[target].copy())
                    link[target] = clone
                    while at >= 0 and move[at].get(word) == target:
                        move[at][word] = clone
                        at = link[at]
                    target = clone
                link[new] = target
            ends.append(new)
            last = new


class PreferredPaths:
    """A link-cut tree over a fixed tree; each preferred path carries the time of its last access.

    ``up`` is the parent within the splay tree of a path or, at its root, the node the path
    hangs from; ``low`` and ``high`` are the children towards the root and away from it.  The
    time of a path is kept at its splay root.
    """

    def __init__(self, parent: list[int]):
        n = len(parent)
        self.up, self.low, self.high, self.time = list(parent), [-1] * n, [-1] * n, [-1] * n

    def _splay(self, x: int) -> None:
        up, low, high = self.up, self.low, self.high
        while (y := up[x]) >= 0 and (low[y] == x or high[y] == x):
            z = up[y]
            if z >= 0 and (low[z] == y or high[z] == y):
                self._rotate(*((y, z) if (low[z] == y) == (low[y] == x) else (x, y)))
            self._rotate(x, up[x])

    def _rotate(self, x: int, y: int) -> None:
        up, low, high = self.up, self.low, self.high
        z = up[y]
        if low[y] == x:
            inner = high[x]
            low[y], high[x] = inner, y
        else:
            inner = low[x]
            high[y], low[x] = inner, y
        if inner >= 0:
            up[inner] = y
        up[y], up[x] = x, z
        if z >= 0 and low[z] == y:
            low[z] = x
        elif z >= 0 and high[z] == y:
            high[z] = x
        else:
            self.time[x] = self.time[y]  # x is the splay root now

    def access(self, node: int, now: int):
        """Gives (deepest node, time) of each path segment from ``node`` up, then makes them one path of time ``now``."""
        up, high, time = self.up, self.high, self.time
        deeper, segments = -1, []
        while node >= 0:
            self._splay(node)
            segments.append((node, time[node]))
            cut = high[node]
            if cut >= 0:
                time[cut] = time[node]
            high[node] = deeper
            deeper, node = node, up[node]
        time[deeper] = now
        return segments


def squares(words: Sequence[int]):
    """(end, period) of every square with a primitive root, by end."""
    automaton = SuffixAutomaton(words)
    size, paths = automaton.size, PreferredPaths(automaton.link)
    for end, state in enumerate(automaton.ends):
        segments = paths.access(state, end)
        for k, (node, before) in enumerate(segments):
            if before >= 0:
                upper = size[segments[k + 1][0]] if k + 1 < len(segments) else 0
                if upper < end - before <= size[node]:
                    yield end, end - before


def runs(words: Sequence[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words, by start and period."""
    open_runs: dict[int, list[int]] = {}
    found = []

    def close(period, first, last):
        start = first - 2 * period + 1
        if last - start + 1 >= least:
            found.append((start, last - start + 1, period))

    for end, period in squares(words):
        run = open_runs.get(period)
        if run and run[1] == end - 1:
            run[1] = end
            continue
        if run:
            close(period, *run)
        open_runs[period] = [end, end]
    for period, run in open_runs.items():
        close(period, *run)
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of the stretches covered by windows that occur twice, long enough for a run."""
    n = len(ids) - WINDOW + 1
    if n < LEAST - WINDOW:
        return []
    code = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        code = (code ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    order = np.argsort(code, kind="stable")
    same = np.flatnonzero(code[order[1:]] == code[order[:-1]])
    if not len(same):
        return []
    step = np.zeros(len(ids) + 1, dtype=np.int32)
    twice = np.unique(np.concatenate([order[same], order[same + 1]]))
    step[twice] += 1
    np.subtract.at(step, twice + WINDOW, 1)
    covered = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= LEAST]


def text_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of a text of word numbers, by start and period."""
    return [(a + s, length, q) for a, b in stretches(ids) for s, length, q in runs(ids[a:b].tolist())]


def repeated(words: list[bytes], seed: int) -> list[bytes]:
    """The words with a repeating tail where the seed asks for one (one seed in ten)."""
    n, g = len(words), seed // 10
    if seed % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    out, at = [], 0
    drops = sorted((s + q, s + length) for s, length, q in found)
    for first, stop in drops:
        if first > at:
            out += words[at:first]
        at = max(at, stop)
    return out + words[at:]


_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)
_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _SCHEMA.split(", ")])
_EMPTY = hashlib.sha256(b"").hexdigest()


def _row(doc_id: int | None, text: str | None, repeat: bool) -> tuple:
    words = (text or "").encode().split()
    if repeat and doc_id is not None:
        words = repeated(words, zlib.crc32(str(doc_id).encode()))
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    found = text_runs(ids)
    if not found:
        return (doc_id, 0, None, None, None, None, _EMPTY, hashlib.sha256(b" ".join(words)).hexdigest())
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()
    return (doc_id, len(found), start, length, period, 1000 * length // period, hashlib.sha256(lines.encode()).hexdigest(), kept)


def report(documents: DataFrame, repeat: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the longest run, runs_sha256, collapsed_sha256.

    ``repeat`` gives one text in ten, chosen by its id, a repeating tail first.
    """

    def run(batches):
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text"))
            while part := [_row(doc_id, text.as_py(), repeat) for doc_id, text in itertools.islice(rows, _BATCH_ROWS)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), _ARROW.types)], schema=_ARROW)

    return documents.select("doc_id", "text").mapInArrow(run, _SCHEMA)
