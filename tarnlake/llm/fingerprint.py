"""Document fingerprints: digests of statistically improbable features.

Every window of 64 bytes has a Shannon entropy. How often an entropy occurs in the whole corpus makes its
rank, the rarest first. Among neighbouring windows the one of smallest rank wins; windows that win often
are the features of a text. They go into a chain of Bloom filters, a new one after every 160 features.
Two fingerprints are compared by the bits that their filters share beyond what chance gives.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bytes of a window; neighbours that compete; wins that make a feature; entropy levels.
WINDOW, NEIGHBOURS, WINS, LEVELS = 64, 64, 16, 1000
#: Ranges of doc_id into which texts are dealt for their neighbours, at most.
MOST_RANGES = 1 << 16
#: Bits of a filter, features in one, bits set for each.
BITS, FULL, HASHES = 2048, 160, 5

_SCALE = 1 << 16
#: c * log2(c) in fixed point, so that sums are exact.
_F = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], np.int64)
_U = np.uint64


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy level (0 to LEVELS) of the window that starts at each byte but the last WINDOW - 1.

    Moving a window by one byte changes the counts of two byte values, those of the byte that leaves and
    of the byte that comes; how often each stands in the window is counted over pairs of equal bytes.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    order = np.argsort(data, kind="stable")
    value, place = data[order], order.astype(np.int32)
    back, ahead = np.zeros(n, np.int8), np.zeros(n, np.int8)
    active = np.arange(1, n, dtype=np.int32)
    for k in range(1, WINDOW):
        near = (value[active - k] == value[active]) & (place[active] - place[active - k] < WINDOW)
        active = active[near]
        if not len(active):
            break
        back[active] += 1
        ahead[active - k] += 1
        active = active[active > k]
    came, left = np.empty(n, np.int8), np.empty(n, np.int8)
    came[order], left[order] = back, ahead
    step = np.diff(_F)
    gain = np.concatenate([[0], np.cumsum(step[came])])
    loss = np.concatenate([[0], np.cumsum(step[left])])
    total = gain[WINDOW:] - loss[: n - WINDOW + 1]
    bits = np.log2(WINDOW) - total / (WINDOW * _SCALE)
    return np.rint(bits * (LEVELS / np.log2(WINDOW))).astype(np.int64)


def _inside(offsets: np.ndarray, n: int, reach: int) -> np.ndarray:
    """Whether [i, i + reach) lies within one text, for each i up to n - reach."""
    out = np.zeros(max(0, n - reach + 1), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out[a : max(a, b - reach + 1)] = True
    return out


def histogram(docs: DataFrame) -> np.ndarray:
    """How many windows of each entropy level all texts have: LEVELS + 1 counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(LEVELS + 1, np.int64)
        for b in shared.pieces(batches):
            offsets, data = shared.bytes_of(b.column("text"))
            if len(data) >= WINDOW:
                seen += np.bincount(levels(data)[_inside(offsets, len(data), WINDOW)], minlength=LEVELS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS + 1)), pa.array(seen)], ["level", "n"])

    out = np.zeros(LEVELS + 1, np.int64)
    counts = shared.text_of(docs).select("text").mapInArrow(run, "level long, n long").where("n > 0").groupBy("level").agg(F.sum("n").alias("n"))
    for r in counts.collect():
        out[r.level] = r.n
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, the rarest 0; levels that never occurred come before all."""
    out = np.empty(len(counts), np.int64)
    out[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    return out


def winners(offsets: np.ndarray, data: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each text that win often enough: their places in data, sorted, and hashes."""
    n = len(data)
    if n < WINDOW + NEIGHBOURS - 1:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    inside = _inside(offsets, n, WINDOW)
    key = np.where(inside, rank[levels(data)] << 40 | np.arange(len(inside)), np.iinfo(np.int64).max)
    best = shared.sliding_min(key, NEIGHBOURS)
    best = best[_inside(offsets, n, WINDOW + NEIGHBOURS - 1)[: len(best)]] & ((1 << 40) - 1)
    at = np.flatnonzero(np.bincount(best, minlength=len(key)) >= WINS)
    return at, shared.span_hash(shared.prefix_hash(data), at, at + WINDOW)


def lone(data: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The feature of a text in which no window wins often enough: its first window of smallest rank, or the
    whole text where that is shorter; none of an empty text."""
    n = len(data)
    at = int(rank[levels(data)].argmin()) if n >= WINDOW else 0
    return shared.span_hash(shared.prefix_hash(data), np.array([at]), np.array([min(n, at + WINDOW)])) if n else np.zeros(0, _U)


def _first(hashes: np.ndarray) -> np.ndarray:
    """Each hash once, in the order in which they come."""
    return hashes[np.sort(np.unique(hashes, return_index=True)[1])]


def features(offsets: np.ndarray, data: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """The distinct feature hashes of each text, in the order in which they come."""
    at, h = winners(offsets, data, rank)
    cut = np.searchsorted(at, offsets).tolist()
    bounds = offsets.tolist()
    return [_first(h[i:j]) if j > i else lone(data[a:b], rank) for i, j, a, b in zip(cut[:-1], cut[1:], bounds[:-1], bounds[1:], strict=True)]


def chain(hashes: np.ndarray) -> np.ndarray:
    """Bloom filters (k x BITS, bool) of a text's features."""
    out = np.zeros((-(-len(hashes) // FULL), BITS), bool)
    which = np.arange(len(hashes)) // FULL
    for k in range(HASHES):
        out[which, (hashes >> _U(11 * k) & _U(BITS - 1)).astype(np.int64)] = True
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1. Each filter of the shorter chain takes its best match in the other; a match is the bits
    shared beyond chance over the most that could be. Two empty chains are alike, an empty one and another aren't."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    x, y = a.astype(np.float32), b.astype(np.float32)
    both = x @ y.T
    nx, ny = x.sum(1), y.sum(1)
    chance = np.outer(nx, ny) / BITS
    most = np.minimum(nx[:, None], ny[None, :])
    score = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    return float(score.max(1) @ nx / nx.sum())


def written(filters: np.ndarray) -> str:
    """Base64 of the chain's bits; empty for an empty text."""
    return base64.b64encode(np.packbits(filters, axis=1).tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    """The chain that written() gave."""
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8)
    return np.unpackbits(raw.reshape(-1, BITS // 8), axis=1).astype(bool)


def _joined(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of the list with a bounded number of bytes: first, last + 1, offsets, bytes."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= shared.CHUNK_BYTES):
            size += len(texts[end])
            end += 1
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[at:end]])]).astype(np.int64)
        yield at, end, offsets, np.frombuffer(b"".join(texts[at:end]), np.uint8)
        at = end


def winners_of(texts: list[bytes], rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places within the text, and hashes, of each text's winners."""
    out = []
    for _, _, offsets, data in _joined(texts):
        at, h = winners(offsets, data, rank)
        cut = np.searchsorted(at, offsets).tolist()
        out += [(at[i:j] - a, h[i:j]) for i, j, a in zip(cut[:-1], cut[1:], offsets[:-1].tolist(), strict=True)]
    return out


def _chain_of(text: bytes, hashes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return chain(_first(hashes) if len(hashes) else lone(np.frombuffer(text, np.uint8), rank))


def edited_winners(texts: list[tuple[bytes, int, tuple[np.ndarray, np.ndarray]]], rank: np.ndarray) -> list[np.ndarray]:
    """Hashes of the winners of texts that begin as another text does. texts: the bytes, how many of them are
    the other's, and the other's winners. Winners that the change can't reach are taken over."""
    reach = WINDOW + NEIGHBOURS - 1
    tails = [t[max(0, same - reach - NEIGHBOURS + 1) :] for t, same, _ in texts]
    out = []
    for (t, same, (at, h)), (own, mine) in zip(texts, winners_of(tails, rank), strict=True):
        kept, shift = same - reach, len(t) - len(t[max(0, same - reach - NEIGHBOURS + 1) :])
        out.append(np.concatenate([h[at <= kept], mine[own + shift > kept]]))
    return out


def fingerprint(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, fingerprint. rank: that of another corpus, to compare with it;
    else from all texts of docs. Null texts count as empty. Nothing is shuffled."""
    rank = ranks(histogram(docs)) if rank is None else rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.pieces(batches):
            found = features(*shared.bytes_of(b.column("text")), rank)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([written(chain(h)) for h in found])], ["doc_id", "fingerprint"])

    return shared.text_of(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _edited(text: str, after: str) -> str:
    """The last quarter replaced by as many first code points of the next text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def _stream(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, guest, key): each part's own rows in order, then a copy of the row after them."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    part, held = None, None
    for b in shared.pieces(batches):
        rows = list(zip(b.column("part").to_pylist(), b.column("guest").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True))
        met: list[tuple] = []  # a row with the one after it
        for (p, guest, doc_id, text), own in zip(rows, winners_of([t.encode() for _, _, _, t in rows], rank), strict=True):
            now = (doc_id, text, own, _chain_of(text.encode(), own[1], rank))
            if held is not None and p == part:
                met.append((held, now))
            part, held = p, None if guest else now
        edits = []
        for (_, text, own, _), (_, after, _, _) in met:
            whole = _edited(text, after)
            edits.append((whole.encode(), len(text[: len(text) - len(text) // 4].encode()), own))
        out = []
        for ((doc_id, text, _, own), (_, _, _, after)), (raw, _, _), h in zip(met, edits, edited_winners(edits, rank), strict=True):
            edit = _chain_of(raw, h, rank)
            out.append((doc_id, len(text), hashlib.sha256(raw).hexdigest(), written(own), written(edit), likeness(own, edit), likeness(own, after)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names)


def compare_with_next(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, where the next document is that of the next doc_id, and the first after the last.

    Null texts count as empty. Rows with a null doc_id come first, rows that share a doc_id by their text;
    a table of one row is its own next. Texts move once, to ranges of doc_id; only the ranges' bounds and
    first ids, one for each range, come to the driver. Other columns are not read.
    """
    spark = docs.sparkSession
    rank = ranks(histogram(docs)) if rank is None else rank
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    text = shared.text_of(docs).withColumn("key", key)
    ids = text.select("key")
    n = min(4 * shared.parts(spark), MOST_RANGES)
    cuts = sorted({int(x) for x in ids.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n)})
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy()), dtype="int32")

    # only ids go to Python for this, texts stay in the JVM
    part = part_of("key")
    firsts = sorted((r.part, r.key) for r in ids.withColumn("part", part).groupBy("part").agg(F.min("key").alias("key")).collect())
    # a range's first rows are guests at the end of the range before it
    before = spark.createDataFrame([(p, k, firsts[i - 1][0]) for i, (p, k) in enumerate(firsts)], "part int, key long, host int")
    text = text.withColumn("part", part).join(F.broadcast(before), ["part", "key"], "left")
    seats = F.array(F.struct("part", F.lit(False).alias("guest")), F.when(F.col("host").isNotNull(), F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))))
    text = text.select("doc_id", "text", "key", F.explode(F.filter(seats, lambda s: s.isNotNull())).alias("seat"))
    text = text.select("doc_id", "text", "key", "seat.part", "seat.guest").repartition(shared.parts(spark), "part").sortWithinPartitions("part", "guest", "key", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return text.select("part", "guest", "doc_id", "text").mapInArrow(lambda it: _stream(it, rank), schema)
