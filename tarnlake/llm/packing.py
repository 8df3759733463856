"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Documents are tokenised where they lie. A full-length piece is a sequence of its own at once; only the
lengths of the last pieces move. Each packing task takes a bounded share of those, longest first, and
puts a piece where the sum over gaps of the squared counts of open bins with that gap becomes
smallest: into a bin of some gap, or into a new one.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Pieces in one packing task: the share is bounded, whatever the table.
SHARE = 1 << 16
#: Words that a worker remembers, about 150 bytes each.
MEMORY = 300_000


class Packer:
    """Sum-of-squares placement of lengths into bins of one capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        #: Open bins by gap, and how many there are.
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.count = np.zeros(capacity + 1, np.int64)
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """The bin for a piece of the size, and its offset there. Ties go to the smallest gap, a new bin last."""
        n, most = self.count, self.capacity
        gaps = np.arange(size, most)
        # a bin of gap g goes over to gap g - size: the sum changes by 2 (n[g - size] - n[g]) + 2, or, closed, by 1 - 2 n[g]
        change = 2 * (n[: most - size] - n[size:most]) + 2
        if size < most:
            change[0] = 1 - 2 * n[size]
        new = 2 * n[most - size] + 1 if size < most else 0
        change = np.where(n[size:most] > 0, change, np.iinfo(np.int64).max)
        if len(change) and change[k := int(change.argmin())] <= new:
            gap = int(gaps[k])
            at = self.bins[gap].pop()
            n[gap] -= 1
        else:
            gap, at = most, self.made
            self.made += 1
        if gap > size:
            self.bins[gap - size].append(at)
            n[gap - size] += 1
        return at, most - gap


#: Kinds of bytes: white space, letters, digits, marks. What isn't of a kind, an apostrophe (it starts
#: contractions) among them, leaves its text to the tokenizer itself.
_SPACE, _LETTER, _DIGIT, _MARK = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _MARK
_KIND[ord("'")] = 0
_KIND[[32, *range(9, 14)]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
# letters of two bytes from 0xC3 on, all but the signs of multiplication and division
_KIND[[0xC3, *range(0x80, 0xC0)]] = _LETTER
_KIND[[0x97, 0xB7]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[0x80:0x9F] += 32


class Words:
    """Token ids of texts by a tokenizer that lower-cases, drops white space, takes runs of letters, single
    digits and runs of marks for words, and ends every word with a token of its own kind.

    Texts of plain bytes are cut into words by array operations; distinct words are looked up, and those
    not met before are encoded many at a time, in one text, and told apart by their end-of-word tokens.
    Other texts are left to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) == len(some) and cut[-1] == 4 * len(ids):
                raw = ids.tobytes()
                self.words.update(zip(some, [raw[i:j] for i, j in zip([0, *cut], cut, strict=False)], strict=True))
            else:
                self.words.update(zip(some, self._alone([w.decode() for w in some]), strict=True))

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) > MEMORY:
            self.words.clear()
        offsets, data = shared.bytes_of(texts)
        n, count = len(data), len(offsets) - 1
        kind = _KIND[data]
        low = _LOWER[data]
        odd = kind == 0
        if n:
            # two bytes make a letter: neither may stand without the other, nor the marks that special tokens begin with
            lead, rest = data == 0xC3, (data >= 0x80) & (data < 0xC0)
            odd[1:] |= lead[:-1] != rest[1:]
            odd[0] |= rest[0]
            odd[-1] |= lead[-1]
            odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        plain = np.diff(np.concatenate([[0], np.cumsum(odd)])[offsets]) == 0
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        starts = np.flatnonzero((change | first[:-1] | (kind == _DIGIT)) & (kind != _SPACE))
        after = np.ones(n, bool)
        after[:-1] = change[1:]
        ends = np.flatnonzero((after | first[1:] | (kind == _DIGIT)) & (kind != _SPACE)) + 1
        text = np.searchsorted(offsets, starts, "right") - 1
        good = plain[text]
        starts, ends, text = starts[good], ends[good], text[good]
        words, which = shared.distinct(low, starts, ends)
        self._learn([w for w in words if w not in self.words])
        ids = [self.words[w] for w in words]
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(size) - size
        sizes = size[which]
        total = np.cumsum(sizes)
        out = flat[np.repeat(begin[which] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)]
        cut = np.concatenate([[0], total])[np.searchsorted(text, np.arange(count + 1))].tolist()
        others = np.flatnonzero(~plain)
        alone = dict(zip(others.tolist(), self._alone(texts.take(pa.array(others)).to_pylist()), strict=True)) if len(others) else {}
        for d in range(count):
            yield alone[d] if d in alone else out[cut[d] : cut[d + 1]].tobytes()


_words: dict[str, Words] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, most: int, end: int, keep: bool) -> Iterator[pa.RecordBatch]:
    run, row = TaskContext.get().partitionId(), 0
    words = _words.setdefault(path, Words(path)) if path not in _words else _words[path]
    tail = np.array([end], "<u4").tobytes()
    for b in shared.pieces(batches):
        out: list[tuple] = []
        for doc_id, ids in zip(b.column("doc_id").to_pylist(), words.texts(b.column("text")), strict=True):
            ids += tail
            for k in range(0, len(ids), 4 * most):
                part = ids[k : k + 4 * most]
                out.append((doc_id, k // (4 * most), k // 4, len(part) // 4, zlib.crc32(part), run, row, np.frombuffer(part, "<u4").astype(np.int32) if keep else None))
                row += 1
        doc_id, piece, start, length, crc, runs, rows, ids = zip(*out, strict=True)
        columns = [pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(runs, pa.int32()), pa.array(rows, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * keep, _PIECE + ["ids"] * keep)


_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, run int, row long"
_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "run", "row"]


def pack(docs: DataFrame, path: str, most: int = 2048, end: int = 0, keep: bool = True, share: int = SHARE) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with keep also ids.

    A document is its ids by the tokenizer file at path (readable on every executor) and the id `end`.
    Only documents of over `most` ids are cut; every piece but the last then fills a sequence. A null or
    empty text is the id `end` alone. Repeated rows are packed as often as they come; null doc_ids are
    packed like others; other columns are not read. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    folder = shared.shared_dir(spark)
    pieces = shared.staged(shared.text_of(docs).mapInArrow(lambda it: _pieces(it, path, most, end, keep), _SCHEMA + ", ids array<int>" * keep), folder, "pieces")
    last = pieces.where(F.col("length") < most)
    tasks = max(1, -(-last.count() // share))
    met = last.select(*_PIECE).repartition(tasks, F.xxhash64("run", "row")).sortWithinPartitions(F.desc("length"), "run", "row")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = Packer(most), TaskContext.get().partitionId() << 32
        for b in batches:
            where = [packer.place(n) for n in b.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([first + x for x, _ in where], pa.int64()), pa.array([x for _, x in where], pa.int64())], [*_PIECE, "sequence_id", "offset"])

    placed = met.mapInArrow(place, _SCHEMA + ", sequence_id long, offset long")
    if keep:
        placed = placed.join(pieces.select("run", "row", "ids"), ["run", "row"])
    # a full piece's sequence is numbered apart from the packed ones, by where it lies
    own = F.lit(1 << 62) + F.col("run").cast("long") * (1 << 36) + F.col("row")
    whole = pieces.where(F.col("length") == most).withColumns({"sequence_id": own, "offset": F.lit(0).cast("long")})
    return placed.unionByName(whole).drop("run", "row")
