"""Periodic runs of words, found on a Re-Pair grammar of the word ids.

Texts are taken some at a time. Their word ids are compressed by Re-Pair (in rounds: every pair at least half as
frequent as the most frequent one is replaced, more frequent pairs first where they overlap; pairs never span two
texts). Each nonterminal X -> Y Z is looked at once, at one place where it stands, for the runs inside X that cross
the boundary of Y and Z; what is left of a text is joined by a balanced tree whose boundaries are looked at likewise.
The runs of a nonterminal are then carried to every place of its derivations, and pieces of a run (cut by the ends of
a nonterminal) are merged into the maximal interval: the node that holds a run whole and crosses it has found it whole.

A run of 12 words or more with period q has 6 consecutive words or more that recur q words later. So a text without a
repeated window of 6 words has none, and a boundary's periods are distances between equal windows beside it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from textlab.llm.common import as_bytes

#: Words of a run at least; besides, it holds two periods.
MIN_WORDS = 12
#: Equal words in a row, q apart, that every run has: 12 - q for short periods q <= 6, q for longer ones.
WINDOW = 6
#: Words that are held as numbers at a time (a longer text is held alone).
SOME_WORDS = 400_000
#: Pairs of equal windows whose extensions are computed at a time.
SOME_PAIRS = 2_000_000

RUNS = "array<struct<start:long,length:long,period:long>>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Nodes(NamedTuple):
    """Places of grammar nodes: node k covers words lo[k] to hi[k], its two parts meet at mid[k]."""

    lo: np.ndarray
    mid: np.ndarray
    hi: np.ndarray

    @staticmethod
    def join(parts: list[Nodes]) -> Nodes:
        none = np.zeros(0, np.int64)
        return Nodes(*(np.concatenate([none, *c]) for c in zip(*parts))) if parts else Nodes(none, none, none)


class Grammar(NamedTuple):
    """Symbols below ``words`` are words; symbol ``words + k`` is rule k with parts left[k] and right[k]."""

    words: int
    left: np.ndarray
    right: np.ndarray
    at: Nodes                # one place of every rule
    rounds: list[tuple[int, int]]
    root: np.ndarray         # what is left: symbols, and where they begin
    begin: np.ndarray


def _mixed(v: np.ndarray) -> np.ndarray:
    """64-bit mix of whole numbers (uint64)."""
    with np.errstate(over="ignore"):
        v = (v.astype(np.uint64) + np.uint64(1)) * _BASE
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))


def _chosen(rank: np.ndarray) -> np.ndarray:
    """Places of pairs to replace: no two overlap, and a higher rank goes before its neighbours (0: not eligible).

    Neighbours of equal rank are one pair of equal symbols overlapping itself: every second place of the stretch.
    """
    n = len(rank)
    new = np.concatenate([[True], rank[1:] != rank[:-1]])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, n))
    value = rank[head]
    before = np.concatenate([[0], value[:-1]])
    after = np.concatenate([value[1:], [0]])
    top = (value > before) & (value > after)
    picked = np.repeat(top, size)
    offset = np.arange(n) - np.repeat(head, size)
    return np.flatnonzero(picked & (offset % 2 == 0))


def compress(ids: np.ndarray, text: np.ndarray) -> Grammar:
    """Re-Pair grammar of word ids, ``text`` being the text that each word belongs to."""
    n = len(ids)
    words = int(ids.max()) + 1 if n else 0
    sym, begin, symbols = ids.astype(np.int64), np.arange(n), words
    left, right, places, rounds = [], [], [], []
    while len(sym) > 1:
        inside = np.flatnonzero(text[begin[1:]] == text[begin[:-1]])
        key = sym[inside] * symbols + sym[inside + 1]
        pairs, which, count = np.unique(key, return_inverse=True, return_counts=True)
        most = int(count.max()) if len(count) else 0
        if most < 2:
            break
        order = np.argsort(count, kind="stable")
        place = np.empty(len(pairs), np.int64)
        place[order] = np.arange(1, len(pairs) + 1)
        place[count < max(2, (most + 1) // 2)] = 0
        rank = np.zeros(len(sym) - 1, np.int64)
        rank[inside] = place[which.ravel()]
        at = _chosen(rank)
        used, first, rule = np.unique(rank[at], return_index=True, return_inverse=True)
        ends = np.append(begin, n)
        one = at[first]
        left.append(sym[one])
        right.append(sym[one + 1])
        places.append(Nodes(begin[one], begin[one + 1], ends[one + 2]))
        rounds.append((symbols - words, symbols - words + len(used)))
        sym = sym.copy()
        sym[at] = symbols + rule.ravel()
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, begin = sym[keep], begin[keep]
        symbols += len(used)
    none = np.zeros(0, np.int64)
    return Grammar(words, np.concatenate([none, *left]), np.concatenate([none, *right]), Nodes.join(places), rounds, sym, begin)


def tree(begin: np.ndarray, text: np.ndarray) -> Nodes:
    """Nodes of a balanced binary tree over the symbols that are left of each text."""
    n, found = len(text), []
    while True:
        of = text[begin]
        first = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
        head = np.flatnonzero(first)
        nth = np.arange(len(begin)) - np.repeat(head, np.diff(np.append(head, len(begin))))
        at = np.flatnonzero((nth[:-1] % 2 == 0) & ~first[1:]) if len(begin) else head
        if not len(at):
            return Nodes.join(found)
        ends = np.append(begin, n)
        found.append(Nodes(begin[at], begin[at + 1], ends[at + 2]))
        keep = np.ones(len(begin), bool)
        keep[at + 1] = False
        begin = begin[keep]


class Words:
    """Word ids of some texts side by side, with what comparing stretches of them takes."""

    def __init__(self, ids: np.ndarray, text: np.ndarray):
        self.ids, self.text, n = ids, text, len(ids)
        self.n = n
        with np.errstate(over="ignore"):
            self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)])
            values = _mixed(ids)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * self.power[:n], dtype=np.uint64)])
            whole = np.flatnonzero(text[:n - WINDOW + 1] == text[WINDOW - 1:]) if n >= WINDOW else np.zeros(0, np.int64)
            window = _mixed(text[whole])
            for k in range(WINDOW):
                window = window * _BASE + values[whole + k]
        order = np.argsort(window, kind="stable")
        window = window[order]
        group = np.concatenate([[0], np.cumsum(window[1:] != window[:-1])]) if len(order) else order
        #: windows by (equal ones, place), as group * n + place; ``where`` is a place's rank in it, -1 without a window
        self.sorted = group * n + whole[order]
        self.where = np.full(n + 1, -1)
        self.where[whole[order]] = np.arange(len(order))
        self.next, self.last = np.full(n + 1, 2 * n + WINDOW), np.full(n + 1, -1)
        same = np.flatnonzero(group[1:] == group[:-1])
        self.next[whole[order[same]]] = whole[order[same + 1]]
        self.last[whole[order[same + 1]]] = whole[order[same]]

    def equal(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Whether the stretches of ``size`` words from a and from b > a have equal sums."""
        with np.errstate(over="ignore"):
            return ((self.sums[a + size] - self.sums[a]) * self.power[b - a]) == (self.sums[b + size] - self.sums[b])

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from a and from b on, ``most`` at most."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(int(most.max(initial=0)).bit_length())):
            can = np.flatnonzero(out + (1 << k) <= most)
            out[can[self.equal(a[can] + out[can], b[can] + out[can], 1 << k)]] += 1 << k
        return out

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words that end just before a and just before b, ``most`` at most."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(int(most.max(initial=0)).bit_length())):
            can = np.flatnonzero(out + (1 << k) <= most)
            step = out[can] + (1 << k)
            out[can[self.equal(a[can] - step, b[can] - step, 1 << k)]] += 1 << k
        return out


def _equal_windows(w: Words, nodes: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, cut, low, high): where in ``w.sorted`` a node's windows stand that equal one touching its boundary.

    ``cut`` is that window's place; the others lie after it (cut = place) or before it (cut = -1 - place), inside the
    node and no further away than two periods fit.
    """
    found, far = [], (nodes.hi - nodes.lo) // 2
    for k in range(WINDOW + 1):
        at = nodes.mid - k
        inside = (at >= nodes.lo) & (w.where[at] >= 0)
        some = np.flatnonzero(inside & (w.next[at] + WINDOW <= nodes.hi))
        place = w.where[at[some]]
        base = w.sorted[place] - at[some]
        high = np.searchsorted(w.sorted, base + np.minimum(nodes.hi[some] - WINDOW, at[some] + far[some]), "right")
        found.append((some, at[some], place + 1, high))
        some = np.flatnonzero(inside & (w.last[at] >= nodes.lo) & (at + WINDOW <= nodes.hi))
        place = w.where[at[some]]
        base = w.sorted[place] - at[some]
        low = np.searchsorted(w.sorted, base + np.maximum(nodes.lo[some], at[some] - far[some]), "left")
        found.append((some, -1 - at[some], low, place))
    node, at, low, high = (np.concatenate(c) for c in zip(*found))
    some = np.flatnonzero(high > low)
    some = some[np.argsort(node[some], kind="stable")]
    return node[some], at[some], low[some], high[some]


def _whole(ids: np.ndarray, lo: int, hi: int, cut: int, q: int) -> tuple[int, int]:
    """Longest stretch of period q around ``cut`` (equal to q words later) in words lo to hi, word by word."""
    differ = np.flatnonzero(ids[lo:hi - q] != ids[lo + q:hi]) + lo
    k = int(np.searchsorted(differ, cut))
    return (int(differ[k - 1]) + 1 if k else lo), (int(differ[k]) if k < len(differ) else hi - q) + q


def _extended(w: Words, nodes: Nodes, node: np.ndarray, q: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, start, end, q) of the runs among stretches of period q at the boundary, or (``back``) q words before it."""
    lo, hi, cut = nodes.lo[node], nodes.hi[node], nodes.mid[node] - back * q
    start = cut - w.behind(cut, cut + q, cut - lo)
    end = cut + q + w.ahead(cut, cut + q, hi - cut - q)
    least = np.maximum(MIN_WORDS, 2 * q)
    ok = np.flatnonzero(end - start >= least)
    order = ok[np.lexsort((q[ok], end[ok], start[ok], node[ok]))]
    first = np.ones(len(order), bool)                       # multiples of the smallest period give the same stretch
    first[1:] = ((node[order[1:]] != node[order[:-1]]) | (start[order[1:]] != start[order[:-1]])
                 | (end[order[1:]] != end[order[:-1]]))
    one = order[first]
    # equal sums are a sign, equal words the proof
    wrong = [i for i in one if not np.array_equal(w.ids[start[i]:end[i] - q[i]], w.ids[start[i] + q[i]:end[i]])]
    if not wrong:
        return node[one], start[one], end[one], q[one]
    again = ok[np.isin(node[ok], node[wrong])]
    for i in again:
        start[i], end[i] = _whole(w.ids, int(lo[i]), int(hi[i]), int(cut[i]), int(q[i]))
    ok = ok[end[ok] - start[ok] >= least[ok]]
    return node[ok], start[ok], end[ok], q[ok]


def crossing(w: Words, nodes: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, start, end, period): runs inside each node that cross its boundary, by smallest period."""
    node, at, low, high = _equal_windows(w, nodes)
    none = np.zeros(0, np.int64)
    found, size = [(none, none, none, none)], high - low
    upto, a = np.cumsum(size), 0
    while a < len(node):                                   # blocks of bounded size, one whole node at least
        b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SOME_PAIRS, "right"))
        b = int(np.searchsorted(node, node[min(b, len(node) - 1)], "left"))
        b = b if b > a else int(np.searchsorted(node, node[a], "right"))
        n = size[a:b]
        row = np.repeat(np.arange(a, b), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        back = at[row] < 0
        place = np.where(back, -1 - at[row], at[row])
        q = np.abs(w.sorted[low[row] + nth] % w.n - place)
        each = np.unique((node[row] * 2 + back) * (w.n + 1) + q)
        each, q = np.divmod(each, w.n + 1)
        found.append(_extended(w, nodes, each // 2, q, each % 2))
        a = b
    node, start, end, q = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((q, end, start, node))
    node, start, end, q = node[order], start[order], end[order], q[order]
    first = np.ones(len(node), bool)
    first[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[first], start[first], end[first], q[first]


def _derived(g: Grammar, rule: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> list[tuple]:
    """The runs of rules (``rule`` ascending) at every place where the rule is derived."""
    n = len(g.left)
    begin_of, end_of = np.searchsorted(rule, np.arange(n), "left"), np.searchsorted(rule, np.arange(n), "right")
    size = np.concatenate([np.ones(g.words, np.int64), g.at.hi - g.at.lo])
    bears = np.concatenate([np.zeros(g.words, bool), end_of > begin_of])
    for a, b in g.rounds:
        bears[g.words + a:g.words + b] |= bears[g.left[a:b]] | bears[g.right[a:b]]
    here = bears[g.root]
    sym, at, out = g.root[here], g.begin[here], []
    for a, b in reversed(g.rounds):
        now = (sym >= g.words + a) & (sym < g.words + b)
        r, place = sym[now] - g.words, at[now]
        times = end_of[r] - begin_of[r]
        which = np.repeat(begin_of[r], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        shift = np.repeat(place - g.at.lo[r], times)
        out.append((start[which] + shift, end[which] + shift, q[which]))
        left, right = g.left[r], g.right[r]
        child, child_at = np.concatenate([left, right]), np.concatenate([place, place + size[left]])
        more = bears[child]
        sym, at = np.concatenate([sym[~now], child[more]]), np.concatenate([at[~now], child_at[more]])
    return out


def runs_of(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run of texts side by side, by start and period; places count over all words."""
    none = np.zeros(0, np.int64)
    w = Words(ids, text)
    repeats = np.unique(text[:len(ids)][w.last[:len(ids)] >= 0])
    if not len(repeats):
        return none, none, none
    some = np.flatnonzero(np.isin(text, repeats))            # texts with a repeated window; the others have no run
    if len(some) < len(ids):
        start, end, q = runs_of(np.unique(ids[some], return_inverse=True)[1].ravel(), text[some])
        return some[start], some[end - 1] + 1, q
    g = compress(ids, text)
    rule, start, end, q = crossing(w, g.at)
    found = _derived(g, rule, start, end, q)
    _, *direct = crossing(w, tree(g.begin, text))
    start, end, q = (np.concatenate([none, *c]) for c in zip(*found, tuple(direct)))
    order = np.lexsort((-end, start, q))                     # pieces of a run lie inside it
    start, end, q = start[order], end[order], q[order]
    group = np.concatenate([[0], np.cumsum(q[1:] != q[:-1])]) if len(q) else none
    reach = np.maximum.accumulate(end + group * (len(ids) + 1)) if len(q) else none
    keep = np.ones(len(q), bool)
    keep[1:] = end[1:] + group[1:] * (len(ids) + 1) > reach[:-1]
    start, end, q = start[keep], end[keep], q[keep]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _texts(words: list[list[bytes]]) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Runs (start, length, period) and collapsed text of each list of words."""
    known = _Ids()
    sizes = np.array([len(x) for x in words], np.int64)
    ids = np.fromiter((known[x] for one in words for x in one), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(words)), sizes)
    start, end, q = runs_of(ids, text)
    first = np.cumsum(sizes) - sizes
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if len(start):
        of = text[start]
        for t, a, n, p in zip(of.tolist(), (start - first[of]).tolist(), (end - start).tolist(), q.tolist()):
            runs[t].append((a, n, p))
    return runs, [b" ".join(_collapsed(x, r) if r else x) for x, r in zip(words, runs)]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    drop = np.zeros(len(words) + 1, np.int64)
    for start, n, q in runs:
        drop[start + q] += 1
        drop[start + n] -= 1
    gone = np.cumsum(drop[:-1]) > 0
    return [x for x, g in zip(words, gone.tolist()) if not g]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def done(rows: pa.RecordBatch, words: list[list[bytes]]) -> pa.RecordBatch:
        runs, collapsed = _texts(words)
        each = [[dict(zip(("start", "length", "period"), r)) for r in one] for one in runs]
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array([len(x) for x in words], pa.int64()), pa.array(each, kind),
             pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    for batch in batches:
        a, held, n = 0, [], 0
        for b in range(batch.num_rows):
            words = as_bytes(batch.column(1).slice(b, 1))[0].split()
            if held and n + len(words) > SOME_WORDS:
                yield done(batch.slice(a, b - a), held)
                a, held, n = b, [], 0
            held.append(words)
            n += len(words)
        yield done(batch.slice(a), held)


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length and period in words, by start, then period),
    collapsed (the words that no run repeats, joined by one space).

    A run is a longest stretch with its smallest period q, of 12 words and two periods at least; collapsing drops what
    follows a run's first q words. Null or empty text has no words, no run and an empty collapsed text; a very long
    text is worked on alone, whole; ids may repeat or be null (they are only carried), repeated rows each get their
    row; an empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _rows, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def _planted(ids: pa.Array, texts: pa.Array) -> pa.Array:
    out: list[bytes] = []
    for doc, data in zip(ids.to_pylist(), as_bytes(texts)):
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and (words := data.split()):
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            data = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])
        out.append(data)
    return pa.array(out, pa.binary()).cast(pa.string())


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, with a periodic tail in one document of ten by crc32 of the id (null ids: none); null text is empty."""
    return arrow_udf(_planted, "string")(doc_id, text)


def digests(found: DataFrame) -> DataFrame:
    """:func:`find_runs` as doc_id, n_runs, the longest run (ties: smallest start, then period), and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("tight"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("_best.before")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.tight")).alias("period"),
        F.floor(F.lit(1000) * F.col("_best.length") / -F.col("_best.tight")).cast("long").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
