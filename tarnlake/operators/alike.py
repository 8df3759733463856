"""Pairs of word sets that may be alike, found block by block without sending pairs between tasks.

A set's words are put in one order for all sets, the table's common words last. A pair of the wanted
similarity shares SIGNS words (or all it needs) among the first n - threshold * n + SIGNS of both, so these
prefixes, as 32-bit words, and a bitmap of the whole set are all that moves. Sets are cut into blocks by
size; each pair of blocks whose sizes allow an alike pair is a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shared words that a pair must show among the prefixes of both sets before more of it is compared.
SIGNS = 4
#: Common words whose place in the order is known: 16 bytes each on the driver and in each worker.
RANKED = 1 << 17
#: Blocks that a table is cut into, and the least and most sets of one.
BLOCKS, LEAST_SETS, MOST_SETS = 16, 2048, 65_536
#: Counters and meetings of a task at a time.
CELLS, MEETINGS = 1 << 22, 1 << 22
#: Pairs that a driver may settle by itself; pairs for a set that are few enough to take them all at once.
SETTLED, FEW = 1 << 18, 16
#: So much less than a product, so that rounding leaves no pair out.
EPS = 1e-6

_U = np.uint64
SIGNATURE = "id long, key string, n int, prefix binary, bits binary"
DEALT = "task int, side int, id long, n int, prefix binary, bits binary"


def _needed(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Words that sets of such sizes share at least if they are alike."""
    return np.ceil(threshold / (1 + threshold) * (na + nb) - EPS).astype(np.int64)


def common_words(hashes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the table's most common words, ascending, and their places by count from 1 on.

    hashes: hash, often, for words of several sets. Words of the last count that fits are all known.
    """
    of = sorted((r.often, r.words) for r in hashes.groupBy("often").agg(F.count("*").alias("words")).collect())
    words, least = 0, None
    while of and words + of[-1][1] <= RANKED:
        least, more = of.pop()
        words += more
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = hashes.where(F.col("often") >= least).select("hash", "often").toArrow()
    word, often = (known.column(c).to_numpy() for c in ("hash", "often"))
    place = np.empty(len(word), np.int64)
    place[np.lexsort((word, often))] = np.arange(1, len(word) + 1)
    order = np.argsort(word)
    return word[order], place[order]


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def signatures(batches: Iterator[pa.RecordBatch], known: np.ndarray, place: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """id, key, hashes (of a set's words, at least one) to SIGNATURE: the prefix, and for each bit whether an
    odd number of the words falls on it."""
    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column("hashes")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        u = lists.values.to_numpy()[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        n = np.diff(offsets)
        row = np.repeat(np.arange(len(n)), n)
        rank = np.zeros(len(u), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, u), len(known) - 1)
            rank = np.where(known[at] == u, place[at], 0)
        u = u.view(_U)
        # words that tie in the order have the same 32 bits
        key = rank.view(_U) << _U(44) | u >> _U(20)
        key = key[np.lexsort((key, row))]
        size = np.minimum(n, n - np.ceil(threshold * n - EPS).astype(np.int64) + SIGNS)
        own = np.arange(len(u)) - np.repeat(offsets[:-1], n) < np.repeat(size, n)
        prefix = (key[own] & _U(0xFFFFFFFF)).astype(np.uint32)
        width = np.maximum(64, 1 << np.ceil(np.log2(2 * n)).astype(np.int64))
        start = np.concatenate([[0], np.cumsum(width)])
        odd = np.bincount(start[row] + (u & (width[row] - 1).view(_U)).astype(np.int64), minlength=start[-1]) & 1
        bits = np.packbits(odd.astype(np.uint8), bitorder="little")
        columns = [b.column("id"), b.column("key"), pa.array(n.astype(np.int32)), _binary(np.concatenate([[0], np.cumsum(size)]) * 4, prefix.view(np.uint8)), _binary(start // 8, bits)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "key", "n", "prefix", "bits"])


def settle(pairs: pa.Table) -> np.ndarray:
    """What goes when sets are taken in order of id: b of the pairs a < b whose a hasn't gone."""
    pairs = pairs.sort_by([("a", "ascending"), ("b", "ascending")])
    gone: set[int] = set()
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        if a not in gone:
            gone.add(b)
    return np.array(sorted(gone), np.int64)


class Blocks:
    """Which sets are a block, and which blocks meet in which task."""

    def __init__(self, bins: list[tuple[int, int, int]], threshold: float):
        """bins: smallest and largest size, and sets, of each bin of sizes, ascending."""
        most = min(MOST_SETS, max(LEAST_SETS, sum(b[2] for b in bins) // BLOCKS))
        self.least = np.array([b[0] for b in bins], np.int64)
        first, parts, spans, room = [], [], [], 0
        for lo, hi, count in bins:
            if count <= room:
                spans[-1][1] = hi
                first.append(len(spans) - 1)
                parts.append(1)
                room -= count
                continue
            first.append(len(spans))
            parts.append(-(-count // most))
            spans += [[lo, hi] for _ in range(parts[-1])]
            room = most - count if parts[-1] == 1 else 0
        self.first, self.parts = np.array(first, np.int64), np.array(parts, np.int64)
        pairs = [(i, j) for i in range(len(spans)) for j in range(i, len(spans)) if spans[i][1] >= threshold * spans[j][0] - EPS]
        self.pairs = len(pairs)
        tasks: list[list[tuple[int, int]]] = [[] for _ in spans]
        for task, (i, j) in enumerate(pairs):
            tasks[i].append((task, 2 * (i == j)))
            if i != j:
                tasks[j].append((task, 1))
        self.count = np.array([len(t) for t in tasks], np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.tasks = np.array([t for own in tasks for t in own], np.int32).reshape(-1, 2)

    def deal(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each signature for each task of its block: task, side (2: both), id, n, prefix, bits."""
        for b in batches:
            n, ids = b.column("n").to_numpy(), b.column("id").to_numpy()
            bin_ = np.searchsorted(self.least, n, "right") - 1
            by = (ids.astype(_U) * _U(0x9E3779B97F4A7C15) >> _U(32)).astype(np.int64)
            block = self.first[bin_] + by % self.parts[bin_]
            row = np.repeat(np.arange(len(n)), self.count[block])
            shift = np.arange(len(row)) - np.repeat(np.cumsum(self.count[block]) - self.count[block], self.count[block])
            task = self.tasks[self.start[block][row] + shift]
            for at in range(0, len(row), 1000):
                part = b.take(pa.array(row[at : at + 1000]))
                columns = [pa.array(np.ascontiguousarray(task[at : at + 1000, k])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, *(part.column(c) for c in ("id", "n", "prefix", "bits"))], ["task", "side", "id", "n", "prefix", "bits"])


class Side:
    """The sets of one block in a task, in order of id."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("id").combine_chunks()
        self.id, self.n = table.column("id").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        self.starts, self.prefix = self._bytes(table, "prefix", np.uint32)
        self.bit_starts, self.bits = self._bytes(table, "bits", _U)
        self.width = np.diff(self.bit_starts)
        self.folds: dict[int, np.ndarray] = {}

    @staticmethod
    def _bytes(table: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in table.column(name).chunks])
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        size = np.dtype(kind).itemsize
        return (offsets - offsets[0]) // size, np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)

    def fold(self, width: int) -> np.ndarray:
        """Bitmaps of `width` words; wider ones laid over each other. Rows of narrower ones mean nothing."""
        if width not in self.folds:
            out = np.zeros((len(self.id), width), _U)
            for own in np.unique(self.width[self.width >= width]).tolist():
                rows = np.flatnonzero(self.width == own)
                x = self.bits[self.bit_starts[rows][:, None] + np.arange(own)]
                out[rows] = np.bitwise_xor.reduce(x.reshape(len(rows), own // width, width), axis=1)
            self.folds[width] = out
        return self.folds[width]

    def words(self, other: Side, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The prefixes as far as sets of the other side's sizes call for: set, word."""
        least = np.maximum(other.n.min(), np.ceil(threshold * self.n - EPS).astype(np.int64))
        size = np.diff(self.starts)
        row = np.repeat(np.arange(len(self.id)), size)
        place = np.arange(len(row)) - self.starts[:-1][row]
        own = place < (self.n - _needed(self.n, least, threshold) + SIGNS)[row]
        return row[own], self.prefix[own]


def candidates(one: Side, two: Side, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in both sides of pairs of different ids that can be alike, row by row of the first side."""
    row, word = one.words(two, threshold)
    other, index = two.words(one, threshold)
    order = np.argsort(index, kind="stable")
    index, other = index[order], other[order]
    left = np.searchsorted(index, word)
    count = np.searchsorted(index, word, "right") - left
    live = count > 0
    row, left, count = row[live], left[live], count[live]
    many, least = len(two.id), min(SIGNS, int(_needed(one.n.min(), two.n.min(), threshold)))
    met = np.concatenate([[0], np.cumsum(count)])
    first = np.searchsorted(row, np.arange(len(one.id) + 1))
    at, rows = 0, max(1, CELLS // many)
    while at < len(one.id):
        end = int(np.searchsorted(met[first], met[first[at]] + MEETINGS, "right")) - 1
        end = min(max(end, at + 1), at + rows, len(one.id))
        lo, hi = first[at], first[end]
        c = count[lo:hi]
        if met[hi] > met[lo]:
            place = np.arange(met[hi] - met[lo]) + np.repeat(left[lo:hi] - (met[lo:hi] - met[lo]), c)
            signs = np.bincount(np.repeat((row[lo:hi] - at) * many, c) + other[place], minlength=(end - at) * many)
            found = np.flatnonzero(signs >= least)
            a, b = found // many + at, found % many
            needed = _needed(one.n[a], two.n[b], threshold)
            good = (signs[found] >= np.minimum(SIGNS, needed)) & (one.id[a] != two.id[b])
            good &= (one.n[a] >= threshold * two.n[b] - EPS) & (two.n[b] >= threshold * one.n[a] - EPS)
            a, b, apart = a[good], b[good], (one.n[a] + two.n[b] - 2 * needed)[good]
            yield _near(one, two, a, b, apart)
        at = end


def _near(one: Side, two: Side, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose bitmaps don't differ in more bits than the sets may differ in words."""
    width = np.minimum(one.width[a], two.width[b])
    keep = np.zeros(len(a), bool)
    for w in np.unique(width).tolist():
        of = np.flatnonzero(width == w)
        x, y, step = one.fold(w), two.fold(w), max(1, (1 << 20) // w)
        for at in range(0, len(of), step):
            own = of[at : at + step]
            keep[own] = np.bitwise_count(x[a[own]] ^ y[b[own]]).sum(axis=1, dtype=np.int64) <= apart[own]
    return a[keep], b[keep]


def meet(batches: Iterator[pa.RecordBatch], threshold: float, every: bool) -> Iterator[pa.RecordBatch]:
    """Stream in order of task to a, b: pairs a < b of which a is the later one of no pair in its task, or
    every pair; null and b for every b that is the later one; the number of pairs kept back and null. So a
    group of g alike sets gives g rows, not g * g."""
    held: list[pa.RecordBatch] = []

    def out(a: np.ndarray | None, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.int64()) if a is None else pa.array(a), pa.array(b)], ["a", "b"])

    def run() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        held.clear()
        side = table.column("side").to_numpy()
        if (side == 2).any():
            one = two = Side(table)
        elif (side == 0).any() and (side == 1).any():
            one, two = (Side(table.filter(pa.array(side == k))) for k in (0, 1))
        else:
            return
        # rows of the first side come in order of id: when a set of it is the later one of a pair, whether the
        # earlier one, of the other side, comes after some set is known
        later, back = np.zeros(len(two.id), bool), 0
        for a, b in candidates(one, two, threshold):
            ida, idb = one.id[a], two.id[b]
            up = ida < idb
            under = np.zeros(len(one.id), bool)
            under[a[~up]] = True
            later[b[up]] = True
            sure = up & (every | ~under[a])
            back += int((up & ~sure).sum())
            yield out(ida[sure], idb[sure])
            yield out(None, np.unique(ida[~up]))
            if two is not one:
                sure = ~up & (every | ~later[b])
                back += int((~up & ~sure).sum())
                yield out(idb[sure], ida[sure])
        yield out(None, two.id[later])
        yield pa.RecordBatch.from_arrays([pa.array([back], pa.int64()), pa.nulls(1, pa.int64())], ["a", "b"])

    task = None
    for b in batches:
        own = b.column("task").to_numpy()
        cut = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if lo == hi:
                continue
            if held and own[lo] != task:
                yield from run()
            task = own[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield from run()

