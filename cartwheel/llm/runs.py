"""Periodic runs of words by descending LCP.

A run (start, length, period) is a stretch of words in which words ``period`` apart are
equal, ``period`` being the least such number, and that no neighbouring word extends.

Suffixes of a text are sorted by prefix doubling and those with a common prefix (LCP) of
neighbours long enough are united in order of decreasing LCP, Kruskal's way: a union-find
over places in the suffix order, each class with its text positions in order. When two
classes meet at LCP l, positions i < j that become neighbours have a common prefix of
exactly l words; at a distance q = j - i within l they hold a stretch of period q and
length q + l. Every run of two periods or more is found at its first position: the
positions i and i + q are neighbours then, since one between them would give a smaller
period. A pair is kept if the word before i breaks the period, so each run is found once.

Texts go through Spark in Arrow batches; those of a batch are sorted together in NumPy, in
groups of about ``WORDS_AT_ONCE`` words, and only positions whose short prefixes occur twice
in their text stay in play. Memory is bounded by that group or the longest text.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_LENGTH = 6
MIN_PERIODS = 4
WORDS_AT_ONCE = 100_000
_word = re.compile(WORD)


def suffix_order(codes: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of all positions by their first 1, 2, 4, ... words, until all differ: the last
    are the suffix order. Equal ranks occur only within a text, as words of two texts have
    different codes. ``end`` is where a position's text ends."""
    order = np.argsort(codes, kind="stable")
    rank, tied = _refined(np.zeros(len(codes), np.int64), order, codes[order])
    levels, width = [rank], 1
    while len(tied):
        after = np.full(len(tied), -1, np.int64)
        inside = tied + width < end[tied]
        after[inside] = rank[tied[inside] + width]
        key = rank[tied] * (len(codes) + 1) + after + 1
        by = np.argsort(key, kind="stable")
        rank, tied = _refined(rank, tied[by], key[by])
        levels.append(rank)
        width *= 2
    return levels


def _refined(rank: np.ndarray, order: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New ranks of the positions ``order``, sorted by ``keys``, within their old groups, and
    those that share one. A rank is the number of positions in smaller groups."""
    if not len(order):
        return rank, order
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    old = rank[order]
    group = np.concatenate(([True], old[1:] != old[:-1]))
    at = np.arange(len(order))
    new = rank.copy()
    new[order] = old + at[first][np.cumsum(first) - 1] - at[group][np.cumsum(group) - 1]
    alone = first & np.concatenate((first[1:], [True]))
    return new, order[~alone]


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` share, from the highest level down."""
    n, got = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + got, b + got
        inside = (x < n) & (y < n)
        same = inside.copy()
        same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        got[same] += 1 << k
    return got


def meet(one: list[int], other: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """Two sorted position lists united, and the pairs (i, j), i < j, one from each, that
    became neighbours. The longer list may be changed in place."""
    if len(one) < len(other):
        one, other = other, one
    if len(other) * 8 > len(one):
        mark, both = set(other), sorted(one + other)
        return both, [(i, j) for i, j in zip(both, both[1:]) if (i in mark) != (j in mark)]
    pairs, at, last = [], [], len(other) - 1
    for x, i in enumerate(other):
        p = bisect_left(one, i)
        at.append(p)
        if p and (x == 0 or other[x - 1] < one[p - 1]):
            pairs.append((one[p - 1], i))
        if p < len(one) and (x == last or other[x + 1] > one[p]):
            pairs.append((i, one[p]))
    for x in range(last, -1, -1):
        one.insert(at[x], other[x])
    return one, pairs


def runs_of(codes: np.ndarray, end: np.ndarray, min_length: int = MIN_LENGTH,
            min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``min_length`` words and ``min_periods``
    (2 or more) periods, unordered, starts counted through all texts. ``codes``: a number for
    each word and text, texts one behind the other."""
    least = min(max(min_length - q, (min_periods - 1) * q) for q in range(1, min_length + 1))
    levels = suffix_order(codes, end)
    deep = least.bit_length() - 1                      # prefixes of 2**deep words fit into the least LCP
    if len(levels) <= deep:
        return []
    place = np.argsort(levels[deep], kind="stable")
    group = levels[deep][place]
    shared = np.concatenate(([False], group[1:] == group[:-1]))
    shared |= np.concatenate((shared[1:], [False]))
    place = place[shared]
    place = place[np.argsort(levels[-1][place], kind="stable")]
    if len(place) < 2:
        return []
    lcp = common_prefix(levels, place[:-1], place[1:])
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    start_of = np.concatenate(([True], end[1:] != end[:-1]))
    root, sets = list(range(len(place))), [[p] for p in place.tolist()]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for e, same in zip(edges.tolist(), lcp[edges].tolist()):
        a, b = find(e), find(e + 1)
        united, pairs = meet(sets[a], sets[b])
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        root[b], sets[a], sets[b] = a, united, None
        for i, j in pairs:
            q = j - i
            if (same >= (min_periods - 1) * q and same + q >= min_length
                    and (start_of[i] or codes[i - 1] != codes[j - 1])):
                found.append((i, same + q, q))
    return found


def _texts(texts: list[list[str]], min_length: int, min_periods: int) -> tuple[list, list]:
    """The runs of every text, ordered, and the words that are left of it."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    flat = np.array([w for t in texts for w in t], dtype=object)
    runs: list[list] = [[] for _ in texts]
    if len(flat):
        word = pd.factorize(flat)[0].astype(np.int64)
        text = np.repeat(np.arange(len(texts)), size)
        for i, length, q in runs_of(text * (word.max() + 1) + word, np.repeat(begin + size, size), min_length, min_periods):
            runs[text[i]].append((i - int(begin[text[i]]), length, q))
    left = []
    for words, found in zip(texts, runs):
        found.sort(key=lambda r: (r[0], r[2]))
        if found:
            change = np.zeros(len(words) + 1, np.int64)
            for i, length, q in found:
                change[i + q] += 1
                change[i + length] -= 1
            words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        left.append(" ".join(words))
    return runs, left


RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def find_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
              min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """``(id_column, n_words, runs, collapsed)`` for every row of ``docs``: the runs of its
    whole text, ordered by start and then period, and its words without the repetitions (the
    first period of every run stays), joined by one space.

    Null, empty and blank texts have no words, no run and an empty collapsed text. Repeated
    rows are answered each, null ids too; an empty table gives no rows; other columns are
    not read. A very long text is a group of its own."""
    kind = docs.select(F.col(f"`{id_column}`")).schema[0]
    out = T.StructType([kind, T.StructField("n_words", T.LongType(), False),
                        T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("collapsed", T.StringType(), False)])
    arrow_run = pa.list_(pa.field("element", pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]), False))

    def batches(rows):
        for batch in rows:
            at = 0
            while at < batch.num_rows:
                first, texts, words = at, [], 0
                while at < batch.num_rows and (not texts or words < WORDS_AT_ONCE):
                    texts.append(_word.findall(batch.column(1)[at].as_py() or ""))
                    words += len(texts[-1])
                    at += 1
                runs, left = _texts(texts, min_length, min_periods)
                rows_of = [[{"start": i, "length": n, "period": q} for i, n, q in found] for found in runs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, at - first), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array(rows_of, arrow_run), pa.array(left, pa.string())], names=[f.name for f in out])

    return docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")).mapInArrow(batches, out)
