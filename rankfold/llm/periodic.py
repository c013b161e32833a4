"""Runs of words with a short period, found over suffix classes of each document, and texts without the repeats.

Suffixes of a text (as words) are sorted; suffixes that share their first L words form a class. Neighbours in the order are
united by decreasing common length, Kruskal's way, with union-find; each class keeps its positions in order. When two classes
meet at L, positions that become neighbours are the candidates: if they lie d <= L apart, the text has period d from the
first one on, L + d words long, and nothing longer to the right. A run's start and the place one period later share
(length - period) words, and no place between them does, or the period would not be the smallest. So they become neighbours
at exactly that length, and every run is seeded once, at its start, with its smallest period. A neighbouring pair that is
preceded by equal words is the inside of a run and is left out.

Runs of at least EXPONENT periods and LEAST words need classes of five words or more. Only suffixes whose first five words
stand elsewhere in their text are sorted, the others are alone in their class. Sorting doubles the compared length, over the texts
of a piece at once.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import scan

#: Runs have at least EXPONENT periods and LEAST words.
EXPONENT, LEAST = 4, 6
_WIDE = 1024


class Positions:
    """An ordered set of positions, in sorted blocks, so that an insertion moves at most 2 * _WIDE of them."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, one: int):
        self.blocks, self.heads, self.size = [[one]], [one], 1

    def around(self, x: int) -> tuple[int, int]:
        """The largest position below x and the smallest above, -1 where there is none."""
        i = max(bisect_left(self.heads, x) - 1, 0)
        block = self.blocks[i]
        k = bisect_left(block, x)
        below = block[k - 1] if k else -1
        if k < len(block):
            return below, block[k]
        return below, self.heads[i + 1] if i + 1 < len(self.heads) else -1

    def add(self, x: int) -> None:
        i = max(bisect_left(self.heads, x) - 1, 0)
        block = self.blocks[i]
        insort(block, x)
        self.heads[i] = block[0]
        self.size += 1
        if len(block) > 2 * _WIDE:
            self.blocks.insert(i + 1, block[_WIDE:])
            self.heads.insert(i + 1, block[_WIDE])
            del block[_WIDE:]

    def __iter__(self):
        for block in self.blocks:
            yield from block


def sorted_suffixes(words: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes whose first `least` words stand elsewhere in their text, in order, and common lengths of neighbours.

    words are 64-bit names of the words of texts laid end to end, text i being words[bounds[i]:bounds[i + 1]]. The k-th length
    belongs to the k-th and the next suffix and is 0 where they share less than `least` words or are of different texts.
    """
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    own = scan.mix(words ^ scan.mix(owner.astype(np.uint64) + np.uint64(1)))  # equal words of different texts differ
    ends = bounds[owner + 1]
    heads = scan.run_hashes(own, least)
    whole = np.arange(len(heads)) + least <= ends[: len(heads)]
    _, at, times = np.unique(heads[whole], return_inverse=True, return_counts=True)
    shared = np.flatnonzero(whole)[times[at] > 1]
    none = np.empty(0, np.int64)
    if not len(shared):
        return none, none

    # order of the first words, also of what follows them, since the next doubling looks there
    place = np.unique(np.concatenate((shared, (shared + least)[shared + least < ends[shared]])))
    name = np.zeros(len(own) + least, np.int64)
    name[place] = 1  # marks; below the names of the words that are looked at
    looked = np.unique((place[:, None] + np.arange(least)).ravel())
    looked = looked[looked < len(own)]
    name[looked] = np.unique(own[looked], return_inverse=True)[1] + 1
    columns = [np.where(place + k < ends[place], name[np.minimum(place + k, len(own) - 1)], 0) for k in range(least)]
    order = place[np.lexsort(columns[::-1])]
    key = np.stack([np.where(order + k < ends[order], name[np.minimum(order + k, len(own) - 1)], 0) for k in range(least)])
    fresh = np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))
    rank = np.zeros(len(own), np.int64)  # place in the order of the first suffix of the class, from 1; 0: not looked at

    first = np.flatnonzero(fresh)
    rank[order] = np.repeat(first, np.diff(np.append(first, len(order)))) + 1
    length = least
    while True:
        size = np.diff(np.append(first, len(order)))
        crowded = np.repeat(size > 1, size)
        slots = np.flatnonzero(crowded)
        if not len(slots):
            break
        suffix = order[slots]
        after = suffix + length
        second = np.where(after < ends[suffix], rank[np.minimum(after, len(own) - 1)], 0)
        packed = (rank[suffix] << 32) | second
        by = np.argsort(packed, kind="stable")
        order[slots] = suffix[by]
        packed = packed[by]
        starts = np.ones(len(order), bool)
        starts[slots[1:]] = packed[1:] != packed[:-1]
        starts[slots[0]] = True
        first = np.flatnonzero(starts)
        rank[order] = np.repeat(first, np.diff(np.append(first, len(order)))) + 1
        length *= 2

    order = order[np.isin(order, shared, assume_unique=True)]
    a, b = order[:-1], order[1:]
    prefix = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(own * scan.powers(len(own))[0], out=prefix[1:])
    low, high = np.zeros(len(a), np.int64), np.minimum(ends[a] - a, ends[b] - b)
    high[owner[a] != owner[b]] = 0
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = scan.span_hashes(prefix, a, a + middle) == scan.span_hashes(prefix, b, b + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return order, np.where(low >= least, low, 0)


def seeds(order: np.ndarray, common: np.ndarray, exponent: int) -> list[tuple[int, int, int]]:
    """(position, distance, common length) of positions that become neighbours at most length / (exponent - 1) apart."""
    suffix = order.tolist()
    classes = {k: Positions(p) for k, p in enumerate(suffix)}
    parent = list(range(len(suffix)))
    found = []

    def root(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    by = np.argsort(-common, kind="stable")
    by = by[common[by] > 0]
    for k, length in zip(by.tolist(), common[by].tolist()):
        big, small = root(k), root(k + 1)
        if classes[big].size < classes[small].size:
            big, small = small, big
        into, moved = classes[big], list(classes.pop(small))
        parent[small] = big
        reach = length // (exponent - 1)
        before = -1
        for n, x in enumerate(moved):
            below, above = into.around(x)
            if below >= 0 and below > before and x - below <= reach:
                found.append((below, x - below, length))
            if above >= 0 and above - x <= reach and (n + 1 == len(moved) or moved[n + 1] > above):
                found.append((x, above - x, length))
            before = x
        for x in moved:
            into.add(x)
    return found


def runs_of(words: np.ndarray, bounds: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; starts count through all texts."""
    shortest = min(max(least - p, (exponent - 1) * p) for p in range(1, least + 1))
    order, common = sorted_suffixes(words, bounds, shortest)
    found = np.array(seeds(order, common, exponent), np.int64).reshape(-1, 3)
    start, period, length = found[:, 0], found[:, 1], found[:, 2] + found[:, 1]
    first = np.isin(start, bounds)
    inside = words[np.maximum(start - 1, 0)] == words[np.maximum(start - 1, 0) + period] if len(start) else first
    keep = (first | ~inside) & (length >= np.maximum(least, exponent * period))
    rows = np.stack((start, length, period), axis=1)[keep]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _collapsed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the kept words of each text, joined by one space."""
    counts = np.concatenate(([0], np.cumsum(keep)))[bounds]
    starts, ends = starts[keep], ends[keep]
    size = ends - starts + 1
    offsets = np.concatenate(([0], np.cumsum(size)))
    source = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    out = np.concatenate((buf, [np.uint8(32)]))[np.minimum(source, len(buf))]
    out[offsets[1:] - 1] = 32
    last = np.zeros(len(out), bool)
    ended = counts[1:][np.diff(counts) > 0]
    last[offsets[ended] - 1] = True
    cut = offsets[counts] - np.searchsorted(ended, counts, "right")
    return out[~last], cut


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """[id_col, runs, collapsed], one row per row of docs.

    Words are maximal runs of non-space characters. A run [start, length, period] is a stretch of at least
    max(least, exponent * period) words in which words `period` apart are equal, for no smaller number, and which no
    neighbouring word extends; runs are in order of start, then period. `collapsed` is the text without the words that any
    run contains after its first period, the others joined by one space.

    * A null, empty or blank text has no runs and an empty `collapsed`. A null id stays null; repeated rows stay repeated.
    * A text is handled whole, in one task, with about a hundred bytes of arrays per word; texts never mix.
    * Words are compared by 64-bit hashes. An empty table gives an empty table; other columns are ignored.
    """
    if exponent < 2 or least < 2:
        raise ValueError("runs have at least two periods and two words")

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offsets in scan.pieces(batch.column("text")):
                starts, ends, bounds = scan.word_spans(buf, offsets)
                rows = runs_of(scan.word_hashes(buf, starts, ends), bounds, exponent, least)
                doc = np.searchsorted(bounds, rows[:, 0], "right") - 1
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
                np.add.at(edge, rows[:, 0] + rows[:, 1], -1)
                out, cut = _collapsed(buf, starts, ends, np.cumsum(edge[:-1]) == 0, bounds)
                fields = [pa.array(rows[:, 0] - bounds[doc]), pa.array(rows[:, 1]), pa.array(rows[:, 2])]
                values = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32()), values)
                texts = pa.Array.from_buffers(pa.large_utf8(), hi - lo, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), lists, texts.cast(pa.utf8())], ["id", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
