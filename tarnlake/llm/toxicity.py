"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is an n-gram of characters of the lower-cased text, hashed, that occurs at least once, twice or
three times. Its value is the log of the ratio in which toxic and clean training texts have it; a logistic
regression on those values gives the weights. Training reads a sample of labelled rows whose size is a
parameter; scoring reads whole texts where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Lengths of the n-grams in characters, bits of the feature hash, and features kept.
GRAMS, BITS, FEATURES = (3, 4, 5, 6), 19, 10_000
#: An n-gram gives a feature for each number of occurrences up to this that its text reaches.
TIMES = 3
_SPACE = TIMES << BITS
#: Blocks in which the features' counts move.
_BLOCKS = 64
#: Bytes of text at a time: each gives a feature for every length of n-gram.
_CHUNK = 1 << 18
#: The bounds of the training sample: rows of each class, and features of all rows (four bytes each on the driver).
ROWS_PER_CLASS, MOST_ENTRIES = 4_000, 40_000_000

_chars: list[np.ndarray] = []


def char_values() -> np.ndarray:
    """A random 64-bit value for each code point; one table a process."""
    if not _chars:
        _chars.append(shared.mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)))
    return _chars[0]


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and code points of the texts in lower case, with white space as spaces; nulls count as empty."""
    low = [(t or "").lower() for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))])
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[(codes >= 9) & (codes <= 13)] = 32
    return offsets, codes


def features(offsets: np.ndarray, data: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of texts in code points, each once, ordered by text. wanted: only features for which it is true."""
    s = shared.prefix_hash(data, char_values())
    inverse = shared.powers(len(s), inverse=True)
    length = np.diff(offsets)
    text = np.repeat(np.arange(len(length), dtype=np.int64), length)
    left = offsets[1:][text] - np.arange(len(data)) if len(data) else text
    some = None if wanted is None else wanted.reshape(TIMES, -1).any(axis=0)
    found = []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = ((s[n:] - s[:-n]) * inverse[: len(s) - n]) * np.uint64(0xD6E8FEB86659FD93 + 2 * n) >> np.uint64(64 - BITS)
        h = h.view(np.int64)
        good = left[: len(h)] >= n
        if some is not None:
            good &= some[h]
        at = np.flatnonzero(good)
        found.append(text[at] << BITS | h[at])
    pairs, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
    text, gram = pairs >> BITS, pairs & ((1 << BITS) - 1)
    out_text, out = [], []
    for k in range(TIMES):
        own = count > k
        if wanted is not None:
            own &= wanted[(k << BITS) + gram]
        out_text.append(text[own])
        out.append((k << BITS) + gram[own])
    text, out = np.concatenate(out_text), np.concatenate(out)
    order = np.argsort(text, kind="stable")
    return text[order], out[order]


class Model:
    """Weights of the kept features, and a bias."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float):
        self.index, self.weight, self.bias = index, weight, bias
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return self.index, self.weight, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(_SPACE, np.float32)
            self._table[self.index] = self.weight
            self._wanted = self._table != 0
        text, feature = features(*characters(texts), self._wanted)
        z = np.bincount(text, self._table[feature], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def constant(toxic: int, clean: int) -> Model:
    """With one class only, every text scores as that class; without labels, as clean."""
    return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 30.0 if toxic > clean else -30.0)


def log_ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes log-count ratio of each feature, and its size in standard errors."""
    ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))
    return ratio, np.abs(ratio) / np.sqrt(1 / (toxic + 1) + 1 / (clean + 1))


def fit(rows: list[tuple[int, np.ndarray]], index: np.ndarray, ratio: np.ndarray, rounds: int = 150, l2: float = 1e-3) -> Model:
    """rows: (label, its distinct features among index, which is sorted). Both classes must occur."""
    y = np.array([x for x, _ in rows], np.float64)
    row = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
    at = np.searchsorted(index, np.concatenate([f for _, f in rows]).astype(np.int64))
    value = ratio[at]
    # both classes weigh alike, whatever the sample's balance
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, bias = np.zeros(len(index)), 0.0
    v, vb, step = np.zeros(len(index)), 0.0, 4.0 / max(1.0, np.bincount(row, value**2, len(y)).mean())
    for _ in range(rounds):  # gradient steps with momentum
        z = np.bincount(row, w[at] * value, len(y)) + bias
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        v = 0.9 * v - step * (np.bincount(at, g[row] * value, len(index)) + l2 * w)
        vb = 0.9 * vb - step * g.sum()
        w, bias = w + v, bias + vb
    return Model(index, (w * ratio).astype(np.float32), float(bias))


def held_out() -> F.Column:
    """Rows that never train: crc32 of the doc_id as text divides by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Fit on at most rows_per_class labelled rows of each class, those of smallest hash of doc_id, so the
    sample is the same on every run. A doc_id with several labels counts as toxic if one says so. Features
    are counted where the sample's texts lie; the driver gets the FEATURES best of them, and those of each row,
    of MOST_ENTRIES in all: rows beyond that, in the order of the hash, don't train.
    """
    if rows_per_class >= 1 << 16:
        raise ValueError("rows_per_class must be below 65536")
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out()).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    by_hash = (F.xxhash64("doc_id"), "doc_id")
    sample = known.where("toxic = 1").orderBy(*by_hash).limit(rows_per_class).unionAll(known.where("toxic = 0").orderBy(*by_hash).limit(rows_per_class))
    # at most 2 * rows_per_class ids and labels are broadcast
    texts = shared.text_of(docs).join(F.broadcast(sample), "doc_id").withColumn("same", F.sha2("text", 256)).dropDuplicates(["same", "toxic"]).drop("same")
    folder = shared.shared_dir(spark)
    texts = shared.staged(texts, folder, "sample")
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return constant(n_toxic, n_clean)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, _SPACE), np.uint16)  # a sample of a class has fewer rows than that holds
        for b in shared.pieces(batches, most=_CHUNK):
            text, feature = features(*characters(b.column("text")))
            toxic = b.column("toxic").to_numpy()[text]
            for k in (0, 1):
                seen[k] += np.bincount(feature[toxic == k], minlength=_SPACE).astype(np.uint16)
        if seen.any():
            some = seen.reshape(2, _BLOCKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.array([some[:, k].tobytes() for k in range(_BLOCKS)], pa.binary())], ["block", "counts"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _SPACE // _BLOCKS
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                total[block] = total.get(block, 0) + np.frombuffer(counts, np.uint16).reshape(2, -1).astype(np.int64)
        for block, (clean, toxic) in total.items():
            ratio, sure = log_ratio(toxic, clean, n_toxic, n_clean)
            at = np.flatnonzero((sure >= 2) & (toxic + clean > 1))
            yield pa.RecordBatch.from_arrays([pa.array(at + block * width), pa.array(ratio[at]), pa.array(sure[at])], ["feature", "ratio", "sure"])

    ranked = texts.mapInArrow(count, "block int, counts binary").repartition(shared.parts(spark), "block").mapInArrow(rank, "feature long, ratio double, sure double")
    best = sorted((r.feature, r.ratio) for r in ranked.orderBy(F.desc("sure"), "feature").limit(FEATURES).collect())
    if not best:
        return constant(n_toxic, n_clean)
    index, ratio = np.array([x for x, _ in best]), np.array([x for _, x in best])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(_SPACE, bool)
        wanted[index] = True
        for b in shared.pieces(batches, most=_CHUNK):
            text, feature = features(*characters(b.column("text")), wanted)
            cut = np.searchsorted(text, np.arange(1, b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([x.astype(np.int32).tobytes() for x in np.split(feature, cut)], pa.binary())], ["doc_id", "toxic", "features"])

    found = texts.mapInArrow(own, "doc_id long, toxic int, features binary").withColumn("hash", F.xxhash64("doc_id"))
    found = shared.staged(found, folder, "features")
    # rows in the order in which the sample was taken, as long as their features keep the bound
    sizes = sorted((r.hash, r.doc_id, r.n) for r in found.select("hash", "doc_id", (F.length("features") / 4).cast("long").alias("n")).collect())
    room = np.searchsorted(np.cumsum([n for _, _, n in sizes]), MOST_ENTRIES, "right")
    if room < len(sizes):
        found = found.where(F.col("hash") < sizes[room][0])
    got = found.collect()
    if len({r.toxic for r in got}) < 2:
        raise ValueError("MOST_ENTRIES leaves rows of one class alone")
    return fit([(r.toxic, np.frombuffer(r.features, np.int32)) for r in sorted(got, key=lambda r: (r.doc_id, r.toxic))], index, ratio)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, score (0 to 1), predicted (1 where score >= 0.5).

    A null text counts as empty and gets the model's bias alone. Only the text makes the score: doc_id,
    lang, source and labels don't. Repeated rows and null doc_ids give a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.pieces(batches, most=_CHUNK):
            s = model.score(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return shared.text_of(docs).withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that score below 0.5. Nothing is shuffled."""
    shared.short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.pieces(batches, most=_CHUNK):
            yield b.filter(pa.array(model.score(b.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)
