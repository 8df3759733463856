"""Byte-level BPE by recursive DuckDB queries, one in-memory database for each Python worker.

A text is cut by the split pattern; the distinct words that a worker hasn't met become token-position
rows. A recursive query joins neighbouring positions with the merge table and contracts, in each word,
the leftmost pair of smallest rank, until no pair of any word is in the table. In the same step it
contracts every other pair that this rule is sure to come to as it stands: one that nothing beside it can
break up before. So a word of any length takes few steps, and there is no other way for long ones. Ordered
aggregation then gives each word's ids, and through the vocabulary the bytes that they decode to. Texts
never leave their partition: nothing is shuffled, and a task lost is a task run again.

When a pair (t, c) of rank r stands in a, t, c, d, what can break it up is a merge across its left edge, of
a or something longer that ends with a, and t; or across its right edge, of c, and d or something longer
that begins with d. `pairs` has, for two tokens, the rank of their merge, and the least rank of any merge
of what ends with the first and the second (lb), and of the first and what begins with the second (rb).
The pair is sure if a, t merges later than r, and either nothing that ends with a merges with t before r
(lb of a, t), or a can't grow before r (lb of x, a with x before a); alike on the right; and if the merged
token could not go on with its neighbours at a rank below r, which would then come too early. Of pairs of
one rank side by side (aaaa) the first, third and so on are merged, as from the left.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

#: Bytes of words in one recursive query (one longer word is taken alone), and words in a worker's memory
#: (about 300 bytes each).
BATCH, MEMORY = 1 << 18, 600_000

_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Kinds of bytes where words can be cut by array operations: white space, letters, digits, marks. A text
#: with any other byte (an apostrophe, which starts contractions, among them) is cut by the pattern itself.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 4
_KIND[ord("'")] = 0
_KIND[[32, *range(9, 14)]] = 1
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 2
_KIND[[0x97, 0xB7]] = 0
_KIND[48:58] = 3

_PAIRS = """
CREATE TABLE pairs AS
WITH x AS (
    SELECT l::BIGINT * 65536 + r AS k, rank, rank AS lb, rank AS rb FROM merges
    UNION ALL SELECT tail::BIGINT * 65536 + r, NULL, rank, NULL FROM merges JOIN tails ON t = l
    UNION ALL SELECT l::BIGINT * 65536 + head, NULL, NULL, rank FROM merges JOIN heads ON t = r)
SELECT k, (coalesce(min(rank), 65536)::BIGINT << 34) + (coalesce(min(lb), 65536)::BIGINT << 17) + coalesce(min(rb), 65536) AS v FROM x GROUP BY k
"""

# 65536 stands for no merge. The rank, lb and rb of a pair are 17 bits each of its v, 65536 three times where it has
# none (1125908496842752): a position looks its own pair up, and a window gives it what those beside it found. x, a, t,
# c, d, e are the tokens from two before a pair (t, c) to two after it, ab, xa, cd, de the v of those pairs, q its right
# half's place. Words stand one after the other with a null token after each, which no pair reaches across.
_ENCODE = """
WITH RECURSIVE state(step, w, p, t) AS (
    SELECT 0, w, p, t FROM fresh
    UNION ALL
    (WITH beside AS (
        SELECT step, w, p, t, lead(p) OVER o AS q, lead(t) OVER o AS c FROM state WINDOW o AS (ORDER BY p)),
     known AS (
        SELECT w, p, q, t, c, coalesce(v, 1125908496842752) AS v FROM beside LEFT JOIN pairs ON k = t::BIGINT * 65536 + c),
     around AS (
        SELECT w, p, q, (v >> 34)::INT AS rank, lag(t) OVER o AS a, lead(c) OVER o AS d,
               coalesce(lag(v) OVER o, 1125908496842752) AS ab, coalesce(lag(v, 2) OVER o, 1125908496842752) AS xa,
               coalesce(lead(v) OVER o, 1125908496842752) AS cd, coalesce(lead(v, 2) OVER o, 1125908496842752) AS de
        FROM known WINDOW o AS (ORDER BY p)),
     found AS (SELECT * FROM around WHERE rank < 65536),
     held AS (
        SELECT w, p, q, rank, a, d, least(ab >> 34, greatest(ab >> 17 & 131071, xa >> 17 & 131071)) AS on_left,
               least(cd >> 34, greatest(cd & 131071, de & 131071)) AS on_right
        FROM found),
     sure AS (
        SELECT w, p, q, h.rank, h.rank < on_left AS first
        FROM held h LEFT JOIN pairs l ON l.k = a::BIGINT * 65536 + h.rank LEFT JOIN pairs r ON r.k = h.rank::BIGINT * 65536 + d
        WHERE h.rank <= on_left AND h.rank <= on_right AND coalesce((l.v >> 17 & 131071) > h.rank, true) AND coalesce((r.v & 131071) > h.rank, true)),
     placed AS (
        SELECT *, row_number() OVER o AS i, coalesce(lag(q) OVER o <> p, true) AS opens FROM sure WINDOW o AS (ORDER BY p)),
     runs AS (
        SELECT *, max(CASE WHEN opens THEN 2 * i + (NOT first)::INT END) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM placed),
     sound AS (SELECT w, p, q, rank FROM runs WHERE run % 2 = 0 AND (i - run // 2) % 2 = 0),
     least AS (SELECT w, min(rank::BIGINT << 32 | p) AS k FROM (SELECT * FROM found ANTI JOIN sound USING (w)) GROUP BY w),
     merging AS (SELECT * FROM sound UNION ALL SELECT f.w, f.p, f.q, f.rank FROM found f JOIN least ON f.w = least.w AND f.p = k & 4294967295)
     SELECT step + 1, s.w, s.p, coalesce(m.rank, s.t)
     FROM (SELECT * FROM state SEMI JOIN (SELECT DISTINCT w FROM merging) USING (w)) s LEFT JOIN merging m ON s.p = m.p ANTI JOIN (SELECT q FROM merging) gone ON s.p = gone.q)
),
final AS (SELECT w, max(step) AS step FROM state GROUP BY w),
each AS (SELECT w, list({'t': t, 'hex': hex} ORDER BY p) AS o FROM state JOIN final USING (w, step) JOIN vocabulary USING (t) GROUP BY w)
SELECT w, array_to_string(list_transform(o, lambda z: z.t), ',') || ',' AS ids, array_to_string(list_transform(o, lambda z: z.hex), '') AS hex FROM each
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _parts(words: list[bytes]) -> Iterator[list[bytes]]:
    """The words in parts of at most BATCH bytes, or one longer word."""
    at = size = 0
    for i, w in enumerate(words):
        if i > at and size + len(w) > BATCH:
            yield words[at:i]
            at, size = i, 0
        size += len(w)
    if words:
        yield words[at:]


class Encoder:
    """Words to ids and back, with a bounded memory of what it has encoded."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = load_ranks(path)
        # \s as Unicode's White_Space, which the pattern's own library takes it for
        pattern = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        self.find = regex.compile(pattern).findall
        left, right, rank, heads, tails = [], [], [], [], []
        for token, r in self.ranks.items():
            for i in range(1, len(token) + 1):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
                if a is not None:
                    heads.append((r, a))
                if (b := self.ranks.get(token[-i:])) is not None:
                    tails.append((r, b))
        # what a very long word doesn't fit into memory with goes to the worker's own scratch folder
        scratch = os.path.join(tempfile.gettempdir(), f"bpe-{os.getpid()}")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": scratch, "max_temp_directory_size": "4GB"})
        self._table("merges", {"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32())})
        for name, found in (("head", heads), ("tail", tails)):
            self._table(f"{name}s", {"t": pa.array([x for x, _ in found], pa.int32()), name: pa.array([y for _, y in found], pa.int32())})
        self.db.execute(_PAIRS).fetchall()
        self._table("vocabulary", {"t": pa.array(self.ranks.values(), pa.int32()), "hex": [x.hex() for x in self.ranks]})
        single = [self.ranks[bytes([x])] for x in range(256)]
        self.byte = np.array(single, np.int32)
        #: By word: its ids as text, each with a comma after it, and the bytes that they decode to.
        self.words: dict[bytes, tuple[str, bytes]] = {}

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given").fetchall()
        self.db.unregister("given")

    def learn(self, words: list[bytes]) -> None:
        """Encode words, none twice."""
        words.sort(key=len)
        for part in _parts(words):
            length = np.fromiter(map(len, part), np.int64, len(part))
            end = np.zeros(length.sum() + len(part), bool)
            end[np.cumsum(length + 1) - 1] = True
            t = np.zeros(len(end), np.int32)
            t[~end] = self.byte[np.frombuffer(b"".join(part), np.uint8)]
            self._table("fresh", {"w": np.repeat(np.arange(len(part), dtype=np.int32), length + 1), "p": np.arange(len(end), dtype=np.int32), "t": pa.array(t, mask=end)})
            for i, ids, text in self.db.execute(_ENCODE).fetchall():
                self.words[part[i]] = ids, bytes.fromhex(text)

    def cut(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which texts are plain, and the words of those: text, start, end.

        A word is a run of one kind, with a space before it if there is one. Of other white space before a
        word all but its last byte is one word and the last another; at the end of a text it is one word.
        """
        n = len(data)
        kind = _KIND[data]
        odd = kind == 0
        lead, rest = data == 0xC3, (data >= 0x80) & (data < 0xC0)
        odd[1:] |= lead[:-1] != rest[1:]
        odd[:1] |= rest[:1]
        odd[-1:] |= lead[-1:]
        plain = np.diff(np.concatenate([[0], np.cumsum(odd)])[offsets]) == 0
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begin = first[:-1].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        after = np.flatnonzero((kind[1:] != 1) & (kind[:-1] == 1) & ~first[1:-1]) + 1
        begin[after - 1] = True
        begin[after[data[after - 1] == 32]] = False
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        text = np.searchsorted(offsets, starts, "right") - 1
        good = plain[text]
        return plain, text[good], starts[good], ends[good]

    def texts(self, texts: pa.Array) -> Iterator[tuple[str, bytes]]:
        """For each text its ids, joined by commas, and the bytes that they decode to."""
        if len(self.words) > MEMORY:
            self.words.clear()
        offsets, data = shared.bytes_of(texts)
        plain, text, starts, ends = self.cut(offsets, data)
        words, which = shared.distinct(data, starts, ends)
        others = np.flatnonzero(~plain)
        own = {d: [w.encode() for w in self.find(t)] for d, t in zip(others.tolist(), texts.take(pa.array(others)).to_pylist(), strict=True)}
        self.learn(list(set(words).union(*own.values()) - self.words.keys()))
        found = [self.words[w] for w in words]
        ids, back = [x for x, _ in found].__getitem__, [x for _, x in found].__getitem__
        bounds = np.searchsorted(text, np.arange(len(plain) + 1)).tolist()
        for d, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if d in own:
                each = [self.words[w] for w in own[d]]
                yield "".join([x for x, _ in each])[:-1], b"".join([x for _, x in each])
            else:
                k = which[i:j].tolist()
                yield "".join(map(ids, k))[:-1], b"".join(map(back, k))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process, kept between its tasks."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, keep: bool = True) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; with keep also ids
    (comma-joined) and decoded (the text that the ids give back).

    path: a file of base64 tokens and their ranks, readable on every executor. pattern: the split
    pattern. A null or empty text has no ids: n_tokens 0 and the hashes of nothing. Repeated rows and
    null doc_ids give a row each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in shared.pieces(batches):
            n, ids, decoded, ids_sha, decoded_sha = [], [], [], [], []
            for some, back in e.texts(b.column("text")):
                n.append(some.count(",") + 1 if some else 0)
                ids_sha.append(hashlib.sha256(some.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(back).hexdigest())
                if keep:
                    ids.append(some)
                    decoded.append(back.decode())
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.string()), pa.array(decoded, pa.string())] * keep, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep)

    return shared.text_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * keep)
