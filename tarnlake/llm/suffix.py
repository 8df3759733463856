"""Suffix-array dedup: remove every byte of a passage of 100 bytes that also starts earlier.

Only passages that can repeat are brought together. In every string of 100 bytes one anchor is chosen by
its content alone: the leftmost of its 24-byte substrings with the smallest hash. Equal strings have equal
anchors, so windows (places where a string starts) are dealt out by anchor, a run of windows with one
anchor as one row. Rows with the same bytes, by two polynomials modulo a prime, are settled at once: all but
the earliest repeat. Where an anchor stands in different bytes, those bytes go to a shard by anchor; a
shard's suffix array is built by Larsson-Sadakane refinement, common prefixes by Kasai's sweep, and windows
whose suffixes share 100 bytes repeat the earliest of them. Shards of one anchor are merged by binary
search. Windows of an anchor with more different bytes than a task should hold are dealt out one by one, by
the two polynomials of their own bytes, and equal ones meet there; their bytes stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bytes of a repeated string, of an anchor; bytes of a shard; rows of one anchor that a task may hold.
LENGTH, ANCHOR, SHARD_BYTES, MOST_ROWS = 100, 24, 1 << 20, 2_000
#: Rows of anchors that a task combines before it sends them.
COMBINE = 1 << 19

_U = np.uint64


# ---- anchors ----


def anchors(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: text, first window, last window, anchor, hash of the
    anchor's bytes, hash of the run's bytes. Places count from the text's start."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none.view(_U), none
    s = shared.prefix_hash(data)
    h = ((s[ANCHOR:] - s[:-ANCHOR]) * shared.powers(n - ANCHOR + 1, inverse=True)) * _U(0xD6E8FEB86659FD93)
    key = h & ~_U((1 << 30) - 1) | np.arange(len(h), dtype=_U)
    anchor = (shared.sliding_min(key, LENGTH - ANCHOR + 1) & _U((1 << 30) - 1)).astype(np.int64)
    length = np.diff(offsets)
    good = np.zeros(len(anchor), bool)
    for a, b in zip(offsets[:-1][length >= LENGTH].tolist(), offsets[1:][length >= LENGTH].tolist(), strict=True):
        good[a : b - LENGTH + 1] = True
    window = np.flatnonzero(good)
    anchor = anchor[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1 if len(first) else first
    lo, hi, at = window[first], window[last], anchor[first]
    # a run that goes on into the next text ends with its own text
    text = np.searchsorted(offsets, lo, "right") - 1
    over = hi + LENGTH > offsets[text + 1]
    if over.any():
        raise AssertionError("a run crosses texts")
    own = shared.span_hash(s, at, at + ANCHOR)
    whole = shared.twin_hash(data, lo, hi + LENGTH)
    base = offsets[text]
    return text, lo - base, hi - base, at - base, own, whole


_ROW = "kind int, anchor long, bytes long, doc long, lo long, hi long, at long"
_NAMES = ["kind", "anchor", "bytes", "doc", "lo", "hi", "at"]


def _batch(kind: int, cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *(pa.array(c) for c in cols)], _NAMES)


def _settle(cols: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows sorted by anchor, bytes, doc and lo: the earliest of each bytes (and its equals), and those that repeat it."""
    anchor, bytes_, doc, lo = cols[:4]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (bytes_[1:] != bytes_[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    repeat = (doc != doc[head]) | (lo != lo[head])
    return [c[~repeat] for c in cols], [c[repeat] for c in cols]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a run of windows. Kind 1: one that repeats a run of this task; it travels by its text."""
    held: list[list[np.ndarray]] = []

    def combined() -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
        keep, repeat = _settle([c[order] for c in cols])
        yield _batch(0, keep)
        if len(repeat[0]):
            repeat[0] = shared.mix(repeat[2].view(_U)).view(np.int64)
            yield _batch(1, repeat)

    for b in shared.pieces(batches):
        text, lo, hi, at, own, whole = anchors(*shared.bytes_of(b.column("text")))
        if len(text):
            doc = b.column("doc").to_numpy()[text]
            held.append([own.view(np.int64), whole, doc, lo, hi, at])
            if sum(len(c[0]) for c in held) >= COMBINE:
                yield from combined()
    if held:
        yield from combined()


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream sorted by (kind, anchor, bytes, doc, lo). Kind 1: repeats. Kind 2: the earliest run of its
    bytes, where the anchor has other bytes too. What stands alone goes. Between batches only the earliest
    run of the last bytes is held, and whether its anchor had others before."""
    held: list[np.ndarray] | None = None
    before = False
    for b in batches:
        kind = b.column("kind").to_numpy()
        cols = [b.column(k).to_numpy() for k in _NAMES[1:]]
        if (kind == 1).any():
            yield _batch(1, [c[kind == 1] for c in cols])
            cols = [c[kind == 0] for c in cols]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
        cols, repeat = _settle(cols)
        if len(repeat[0]):
            yield _batch(1, repeat)
        anchor, bytes_ = cols[:2]
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        group = np.cumsum(new) - 1
        several = np.zeros(group[-1] + 1, bool)
        several[group[1:][~new[1:] & (bytes_[1:] != bytes_[:-1])]] = True
        several[0] |= held is not None and before
        tail = (anchor == anchor[-1]) & (bytes_ == bytes_[-1])
        ready = several[group] & ~tail
        if ready.any():
            yield _batch(2, [c[ready] for c in cols])
        held, before = [c[tail] for c in cols], bool(several[-1])
    if held is not None and before:
        yield _batch(2, held)


# ---- suffix arrays ----


def suffix_array(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of strings laid end to end, each closed by a separator that is smaller than
    all bytes and smaller than later separators. text: int64 symbols, 0 for separators, bytes from 1.
    ends: places of the separators.

    Larsson-Sadakane: suffixes are sorted by a first few symbols, then groups that still tie are sorted by
    the rank of the suffix that starts where the sorted part ends, which doubles the sorted part.
    """
    n = len(text)
    depth = 7
    padded = np.concatenate([text, np.zeros(depth, np.int64)])
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the separator
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = key << 9 | np.where(left > k, padded[k : k + n], 0)
    # a suffix whose separator is in the key is told from its equals by that separator
    closed = left < depth
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    done = closed[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | done[1:] | done[:-1]
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank = np.empty(n, np.int64)
    rank[order] = group
    while True:
        size = np.diff(np.append(np.flatnonzero(new), n))
        tied = np.repeat(size > 1, size)
        at = np.flatnonzero(tied)
        if not len(at):
            return order, rank
        own = order[at]
        # a tied suffix has at least `depth` symbols before its separator
        key = rank[own] << 32 | rank[own + depth]
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[at] = own
        step = np.ones(len(at), bool)
        step[1:] = key[1:] != key[:-1]
        new[at] = step
        rank[own] = at[np.flatnonzero(step)[np.cumsum(step) - 1]]
        depth *= 2


def kasai(text: np.ndarray, order: np.ndarray, rank: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in the array with the one before it (0 for the first).

    Kasai's sweep goes through the places of the text and loses at most one symbol of the prefix at each
    step. Here many short stretches of the text are swept side by side, one numpy lane each.
    """
    n = len(text)
    lcp = np.zeros(n, np.int64)
    width = 16
    lanes = -(-n // width)
    sentinel = text.copy()
    sentinel[ends] = -1 - np.arange(len(ends))  # separators differ from each other
    sentinel = np.concatenate([sentinel, [-(2**40), -(2**40) - 1]])
    start = np.arange(lanes) * width
    h = np.zeros(lanes, np.int64)
    for k in range(width):
        i = start + k
        live = np.flatnonzero(i < n)
        if not len(live):
            break
        i = i[live]
        r = rank[i]
        j = order[np.maximum(r - 1, 0)]
        size = np.maximum(h[live] - 1, 0)
        size[r == 0] = 0
        going = np.flatnonzero(r > 0)
        while len(going):
            same = sentinel[np.minimum(i[going] + size[going], n)] == sentinel[np.minimum(j[going] + size[going], n + 1)]
            going = going[same]
            size[going] += 1
        h[live] = size
        lcp[r] = size
    return lcp


class Shards:
    """Runs of bytes in, repeated stretches (doc, lo, hi) out; runs of one anchor may span shards."""

    def __init__(self):
        self.clear()
        #: Distinct strings of the anchor that goes on into the next shard, sorted, each with its earliest place.
        self.strings = np.zeros(0, f"S{LENGTH + 1}")
        self.docs, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.anchor: int | None = None

    def clear(self) -> None:
        self.runs: list[tuple[int, int, int, bytes]] = []
        self.size = 0

    def add(self, anchor: int, doc: int, lo: int, raw: bytes) -> None:
        self.runs.append((anchor, doc, lo, raw))
        self.size += len(raw) + 1

    def close(self, going_on: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Settle the shard; going_on: the last run's anchor may have more runs to come."""
        if not self.runs:
            return (np.zeros(0, np.int64),) * 3
        length = np.array([len(r[3]) for r in self.runs])
        ends = np.cumsum(length + 1) - 1
        raw = np.frombuffer(b"\0".join([r[3] for r in self.runs]) + b"\0", np.uint8)
        text = raw.astype(np.int64) + 1
        text[ends] = 0
        order, rank = suffix_array(text, ends)
        lcp = kasai(text, order, rank, ends)
        # windows in the array's order, and where a new string of LENGTH bytes begins among them
        run = np.searchsorted(ends, order)
        window = ends[run] - order >= LENGTH
        string = np.cumsum(lcp < LENGTH)[window]
        at, run = order[window], run[window]
        docs = np.array([r[1] for r in self.runs], np.int64)
        los = np.array([r[2] for r in self.runs], np.int64)
        place = los[run] + at - (ends[run] - length[run])
        doc = docs[run]
        best = np.lexsort((place, doc, string))
        string, at, run, place, doc = (x[best] for x in (string, at, run, place, doc))
        new = np.ones(len(string), bool)
        new[1:] = string[1:] != string[:-1]
        head = np.flatnonzero(new)
        first = head[np.cumsum(new) - 1]
        first_doc, first_place = doc[first], place[first]
        anchors_ = [r[0] for r in self.runs]
        if self.anchor is not None:
            # merge with the shards before: binary search for this shard's strings of the same anchor
            mine = head[np.array([anchors_[r] == self.anchor for r in run[head]], bool)] if len(head) else head
            if len(mine) and len(self.strings):
                strings = self._strings(raw, at[mine])
                found = np.minimum(np.searchsorted(self.strings, strings), len(self.strings) - 1)
                hit = self.strings[found] == strings
                d, p = self.docs[found], self.starts[found]
                earlier = hit & ((d < doc[mine]) | (d == doc[mine]) & (p < place[mine]))
                group = np.cumsum(new) - 1
                which = np.searchsorted(head, mine[earlier])
                low_doc, low_place = first_doc[head].copy(), first_place[head].copy()
                low_doc[which], low_place[which] = d[earlier], p[earlier]
                first_doc, first_place = low_doc[group], low_place[group]
        repeat = (doc != first_doc) | (place != first_place)
        out = _stretches(doc[repeat], place[repeat])
        if going_on:
            last = anchors_[-1]
            mine = head[np.array([anchors_[r] == last for r in run[head]], bool)] if len(head) else head
            strings = self._strings(raw, at[mine])
            d, p = first_doc[mine], first_place[mine]
            if self.anchor == last:
                strings, d, p = np.concatenate([self.strings, strings]), np.concatenate([self.docs, d]), np.concatenate([self.starts, p])
            by = np.lexsort((p, d, strings))
            strings, d, p = strings[by], d[by], p[by]
            one = np.ones(len(strings), bool)
            one[1:] = strings[1:] != strings[:-1]
            self.strings, self.docs, self.starts, self.anchor = strings[one], d[one], p[one], last
        else:
            self.anchor, self.strings = None, self.strings[:0]
            self.docs, self.starts = self.docs[:0], self.starts[:0]
        self.clear()
        return out

    @staticmethod
    def _strings(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The LENGTH bytes at each place, closed by a byte so that numpy keeps zeros at the end."""
        out = np.full((len(at), LENGTH + 1), 1, np.uint8)
        for k in range(LENGTH):
            out[:, k] = raw[at + k]
        return out.view(f"S{LENGTH + 1}").ravel()


def _stretches(doc: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as unbroken stretches: doc, first window, last window."""
    order = np.lexsort((window, doc))
    doc, window = doc[order], window[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (window[1:] > window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    return doc[first], window[first], window[last]


# ---- the operator ----


_CUT = "kind int, anchor long, doc long, lo long, more long, raw binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a window of a crowded run, its hash for an anchor. Kind 1: a stretch of those that repeat
    windows of this task; it travels by its text. Kind 2: the bytes of a run of another anchor."""
    held: list[list[np.ndarray]] = []

    def batch(kind: int, anchor: np.ndarray, doc: np.ndarray, lo: np.ndarray, more: np.ndarray, raw: pa.Array) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(doc), kind, np.int32)), *(pa.array(c, pa.int64()) for c in (anchor, doc, lo, more)), raw]
        return pa.RecordBatch.from_arrays(columns, ["kind", "anchor", "doc", "lo", "more", "raw"])

    def combined() -> Iterator[pa.RecordBatch]:
        window, doc, at = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((at, doc, window))
        keep, repeat = _settle([c[order] for c in (window, window, doc, at)])
        yield batch(0, *keep[1:], np.zeros(len(keep[0]), np.int64), pa.nulls(len(keep[0]), pa.binary()))
        doc, lo, hi = _stretches(repeat[2], repeat[3])
        if len(doc):
            yield batch(1, shared.mix(doc.view(_U)).view(np.int64), doc, lo, hi - lo, pa.nulls(len(doc), pa.binary()))

    for b in shared.pieces(batches):
        offsets, data = shared.bytes_of(b.column("text"))
        out: tuple[list, list] = [], []
        for doc, a, e, own in zip(b.column("doc").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), b.column("runs").to_pylist(), strict=True):
            raw = data[a:e].tobytes()
            for r in own:
                out[r["crowded"]].append((r["anchor"], doc, r["lo"], raw[r["lo"] : r["hi"] + LENGTH]))
        if out[0]:
            anchor, doc, lo = (np.array([r[i] for r in out[0]], np.int64) for i in range(3))
            yield batch(2, anchor, doc, lo, np.zeros(len(doc), np.int64), pa.array([r[3] for r in out[0]], pa.binary()))
        if out[1]:
            size = np.array([len(r[3]) for r in out[1]], np.int64)
            n = size - LENGTH + 1
            run = np.repeat(np.arange(len(n)), n)
            shift = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            at = (np.cumsum(size) - size)[run] + shift
            doc, lo = (np.array([r[i] for r in out[1]], np.int64)[run] for i in (1, 2))
            held.append([shared.twin_hash(np.frombuffer(b"".join(r[3] for r in out[1]), np.uint8), at, at + LENGTH), doc, lo + shift])
            if sum(len(c[0]) for c in held) >= COMBINE:
                yield from combined()
    if held:
        yield from combined()


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream of _cut sorted by (kind, anchor, doc, lo): stretches that repeat. Between batches only the
    earliest window of the last hash is held, and a shard."""
    shards, last = Shards(), None
    head: list[np.ndarray] | None = None

    def batch(out: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["doc", "lo", "hi"])

    for b in batches:
        kind = b.column("kind").to_numpy()
        if (kind == 1).any():
            doc, lo, more = (b.column(c).to_numpy()[kind == 1] for c in ("doc", "lo", "more"))
            yield batch((doc, lo, lo + more))
        if (kind == 0).any():
            cols = [b.column(c).to_numpy()[kind == 0] for c in ("anchor", "anchor", "doc", "lo")]
            if head is not None:
                cols = [np.concatenate(c) for c in zip(head, cols, strict=True)]
            first, repeat = _settle(cols)
            yield batch(_stretches(repeat[2], repeat[3]))
            head = [c[first[0] == first[0][-1]][:1] for c in first]
        b = b.filter(pa.array(kind == 2))
        for anchor, doc, lo, raw in zip(*(b.column(c).to_pylist() for c in ("anchor", "doc", "lo", "raw")), strict=True):
            if shards.size >= SHARD_BYTES:
                yield batch(shards.close(anchor == last))
            shards.add(anchor, doc, lo, raw)
            last = anchor
    yield batch(shards.close(False))


def _remove(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for b in shared.pieces(batches):
        offsets, data = shared.bytes_of(b.column("text"))
        out = []
        for doc_id, a, e, spans in zip(b.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), b.column("spans").to_pylist(), strict=True):
            raw = data[a:e].tobytes()
            kept, at, removed, runs, end = [], 0, 0, 0, -1
            for s in sorted((s["lo"], min(s["hi"] + LENGTH, len(raw))) for s in spans or ()):
                if s[1] <= end or s[0] >= len(raw):
                    continue
                if s[0] > end:
                    runs += 1
                    kept.append(raw[at : s[0]])
                removed += s[1] - max(s[0], end, 0)
                at = end = s[1]
            kept.append(raw[at:])
            text = b"".join(kept)
            out.append((doc_id, len(raw), removed, runs, hashlib.sha256(text).hexdigest(), text))
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns[: 5 + keep], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep])


def substring_dedup(docs: DataFrame, keep: bool = True) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep also kept,
    the remaining bytes (removal may cut a character, so they are binary).

    Texts are UTF-8 bytes, null counts as empty. A byte goes if a string of LENGTH bytes that covers it also
    starts earlier: in a smaller doc_id, or earlier in the same text. Strings are judged on the input and
    never cross texts. A row with a null doc_id has no place in the order: it stays whole and nothing repeats
    it. Rows alike in doc_id and text are one document, none of which repeats another; different texts of one
    doc_id are documents of their own, in the order of their SHA-256. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = shared.shared_dir(spark)
    text = shared.text_of(docs).withColumn("doc", F.col("doc_id"))
    if not text.where("doc IS NOT NULL").groupBy("doc").count().where(F.col("count") > 1).isEmpty():
        # numbers that keep the order stand for doc_ids
        text = text.drop("doc").withColumn("sha", F.sha2("text", 256))
        order = text.where("doc_id IS NOT NULL").select("doc_id", "sha").distinct().orderBy("doc_id", "sha").withColumn("doc", F.monotonically_increasing_id())
        order = shared.staged(order, folder, "order")
        text = shared.staged(text.join(order, ["doc_id", "sha"], "left").drop("sha"), folder, "texts")
    rows = text.where("doc IS NOT NULL").select("doc", "text").mapInArrow(_find, _ROW)
    met = rows.repartition(shared.parts(spark), "anchor").sortWithinPartitions("kind", "anchor", "bytes", "doc", "lo")
    sorted_out = shared.staged(met.mapInArrow(_sort_out, _ROW), folder, "anchors")
    repeats = sorted_out.where("kind = 1").select("doc", "lo", "hi")

    wanted = sorted_out.where("kind = 2").select("anchor", "doc", "lo", "hi")
    crowded = wanted.groupBy("anchor").count().where(F.col("count") > MOST_ROWS).select("anchor", F.lit(1).alias("crowded"))
    # one anchor of MOST_ROWS runs at least: a small table
    crowded = F.broadcast(shared.staged(crowded, folder, "crowded"))
    wanted = wanted.join(crowded, "anchor", "left").groupBy("doc").agg(F.collect_list(F.struct("anchor", "lo", "hi", F.coalesce("crowded", F.lit(0)).alias("crowded"))).alias("runs"))
    cut = text.select("doc", "text").join(wanted, "doc").mapInArrow(_cut, _CUT)
    met = cut.repartition(shared.parts(spark), "anchor").sortWithinPartitions("kind", "anchor", "doc", "lo")
    repeats = repeats.union(met.mapInArrow(_repeats, "doc long, lo long, hi long"))
    spans = repeats.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep
    return text.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(lambda it: _remove(it, keep), schema)
