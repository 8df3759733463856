"""What the operators share: the shared folder, table reading, and vectorised byte work."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised kernels take at a time. One longer document is taken alone.
CHUNK_BYTES = 1 << 20

_U = np.uint64
#: Odd multiplier of the byte polynomial, and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that is unset and everything runs on
    this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tarnlake-")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, folder: str, name: str) -> None:
    """Delete a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def empty_if_null(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of 1000 rows where the session says nothing else: texts are long, and batches stand in
    memory whole on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id long and text (null: empty), with further columns as they are; other columns go."""
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_if_null("text").cast("string").alias("text"), *more)


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, from 0) and bytes of a string or binary array; nulls count as empty."""
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    n = len(array)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about `most` bytes of the column, whole rows each."""
    for batch in batches:
        offsets, _ = bytes_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte strings of spans that are in order, not empty and don't overlap, and which each span is."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] = 1
    inside[end] -= 1
    own = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    spans = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(own)]).dictionary_encode()
    return spans.dictionary.to_pylist(), spans.indices.to_numpy()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with good avalanche over uint64 (wraps)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random 64-bit value for each byte; LOWERED gives A-Z those of a-z.
BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
LOWERED = BYTE.copy()
LOWERED[65:91] = BYTE[97:123]

_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """1, P, P**2 ... modulo 2**64, or those of P's inverse."""
    base = _PINV if inverse else _P
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        have = np.full(size, _U(base), _U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[data[k]] * P**k over i <= k < j; len(data) + 1 long."""
    s = np.zeros(len(data) + 1, _U)
    np.cumsum(values[data] * powers(len(data)), out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), equal for equal bytes wherever they stand. Spans of other bytes
    may share one, and some long ones (of 1024 bytes) do: not for what tells texts apart."""
    inv = powers(len(s), inverse=True)
    return mix((s[end] - s[start]) * inv[start] + (end - start).astype(_U))


#: A prime, and two bases with random values for the bytes, for hashes whose equality is taken for that of bytes.
PRIME = (1 << 31) - 1
_BASES = (1_204_837_943, 1_919_450_611)
_PRIME_VALUES = [1 + (mix(np.arange(1, 257, dtype=_U) * _U(0x8CB92BA72F3D8DD7 + 2 * k)) % _U(PRIME - 1)).astype(np.int64) for k in (0, 1)]


def _prime_powers(n: int, base: int) -> np.ndarray:
    """1, base, base**2 ... modulo PRIME."""
    have = _powers.get(-base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        have = np.empty(size, np.int64)
        have[0], done = 1, 1
        while done < size:
            more = min(done, size - done)
            have[done : done + more] = have[:more] * pow(base, done, PRIME) % PRIME
            done += more
        if size <= 4 * CHUNK_BYTES:
            _powers[-base] = have
    return have[:n]


def twin_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two polynomials of the byte spans [start, end) modulo a prime with bases of their own, 31 bits each.
    Two strings of n bytes, whatever they are, share both for (n / PRIME)**2 of all pairs of bases."""
    out = np.zeros(len(start), np.int64)
    for base, values in zip(_BASES, _PRIME_VALUES, strict=True):
        x = values[data] * _prime_powers(len(data), base)
        s = np.zeros(len(data) + 1, np.int64)
        np.cumsum((x & PRIME) + (x >> 31), out=s[1:])
        back = _prime_powers(len(data) + 1, pow(base, -1, PRIME))[start]
        out = out << 31 | (s[end] - s[start]) % PRIME * back % PRIME
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i up to len(x) - w, by doubling."""
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        rest = w - have
        out = np.minimum(out[:-rest], out[rest:])
    return out
