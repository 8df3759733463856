"""Exact dedup: tree-merge of sorted digest runs.

Each input partition becomes runs of (digest, smallest or largest identifier, count), one for each
range of digests. Runs of a range meet in rounds: in each round FAN neighbouring runs are brought
together, sorted by Spark's external merge sort and combined in one streaming pass, so a level holds
every digest once a run and the last level once at all. An entry is verified at every level by a
second, independent 64-bit hash and the byte length. A text that a third of all rows share costs one
entry a run, never a large group. The way back down joins (run, digest) before it joins rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Runs merged into one in a round.
FAN = 16

_KEY = ("band", "run", "digest", "check", "bytes")
_ENTRY = "band int, run int, digest binary, check long, bytes long, keep long, n long"


def _digests(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    run = TaskContext.get().partitionId()
    for b in shared.pieces(batches):
        offsets, data = shared.bytes_of(pc.ascii_lower(b.column("text")))
        data = memoryview(data)
        texts = [data[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        digests = [hashlib.sha256(t).digest() for t in texts]
        first = np.frombuffer(b"".join(digests), ">u4")[::8].astype(np.int64)
        checks = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(first * bands >> 32, pa.int32()), pa.array(np.full(len(texts), run, np.int32)), pa.array(digests, pa.binary()), pa.array(checks), pa.array(np.diff(offsets))],
            ["doc_id", "band", "run", "digest", "check", "bytes"],
        )


def _combine(cols: dict[str, np.ndarray], largest: bool) -> dict[str, np.ndarray]:
    """Neighbours with one key become one entry."""
    words = cols["digest"]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]).any(axis=1)
    for k in ("band", "run", "check", "bytes"):
        new[1:] |= cols[k][1:] != cols[k][:-1]
    at = np.flatnonzero(new)
    out = {k: cols[k][at] for k in _KEY}
    out["keep"] = (np.maximum if largest else np.minimum).reduceat(cols["keep"], at)
    out["n"] = np.add.reduceat(cols["n"], at)
    return out


def _merge(batches: Iterator[pa.RecordBatch], largest: bool) -> Iterator[pa.RecordBatch]:
    """Combine a sorted stream of entries; the last entry of a batch waits for the next batch."""
    held: dict[str, np.ndarray] | None = None

    def batch(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        raw = c["digest"].tobytes()
        digest = pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c["band"]), pa.array(c["run"]), digest, *(pa.array(c[k]) for k in ("check", "bytes", "keep", "n"))], [*_KEY, "keep", "n"])

    for b in batches:
        if not b.num_rows:
            continue
        c = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("band", "run", "check", "bytes", "keep", "n")}
        c["digest"] = shared.bytes_of(b.column("digest"))[1].reshape(-1, 32).view(np.uint64)
        if held is not None:
            c = {k: np.concatenate([held[k], c[k]]) for k in c}
        c = _combine(c, largest)
        held = {k: v[-1:] for k, v in c.items()}
        if len(c["n"]) > 1:
            yield batch({k: v[:-1] for k, v in c.items()})
    if held is not None:
        yield batch(held)


def exact_dedup(docs: DataFrame, keep: str = "smallest", fan: int = FAN) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. keep says which
    doc_id of a group stays, "smallest" or "largest". Rows that repeat a doc_id count as rows of their
    group and share its kept. A null doc_id never stands for a group that has another row; a group of
    null doc_ids alone has a null keep_id and its rows are kept. Columns beside doc_id and text are
    not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    largest = {"smallest": False, "largest": True}[keep]
    none = -(2**63) if largest else 2**63 - 1
    folder, bands = shared.shared_dir(spark), shared.parts(spark)
    rows = shared.text_of(docs).mapInArrow(lambda it: _digests(it, bands), "doc_id long, band int, run int, digest binary, check long, bytes long")
    rows = shared.staged(rows, folder, "rows")
    entries = rows.select(*_KEY, F.coalesce("doc_id", F.lit(none)).alias("keep"), F.lit(1).cast("long").alias("n"))
    runs = rows.agg(F.max("run")).first()[0]
    level = own = shared.staged(_round(entries, largest), folder, "level0")
    depth, width = 0, 1 if runs is None else runs + 1
    while width > 1:
        depth, width = depth + 1, -(-width // fan)
        level = shared.staged(_round(level.withColumn("run", F.floor(F.col("run") / fan).cast("int")), largest), folder, f"level{depth}")
        if depth > 1:
            shared.unstage(spark, folder, f"level{depth - 1}")
    whole = level.select("digest", "check", F.col("bytes"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"))
    down = own.select("run", "digest", "check", "bytes").join(whole, ["digest", "check", "bytes"])
    out = rows.join(down, ["run", "digest", "check", "bytes"])
    keep_id = F.when(F.col("keep_id") != none, F.col("keep_id"))
    return out.select("doc_id", keep_id.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _round(entries: DataFrame, largest: bool) -> DataFrame:
    spark = entries.sparkSession
    met = entries.repartition(shared.parts(spark), "band", "run").sortWithinPartitions(*_KEY)
    return met.mapInArrow(lambda it: _merge(it, largest), _ENTRY)
