"""MinHash near-dedup by min-max hashing, with links confirmed on the full sets of shingles.

Under each permutation both the smallest and the largest hash are kept, so 128 hash evaluations give a
signature of 256 values, cut into bands of eight. Documents with one set of shingles become a class and
only its representative goes on. Representatives that share a band hash with others are joined to the
smallest of them; what hangs together that way is a family. A family's full sets meet in chunks of bounded
size, each with the family's smallest document, where links are confirmed exactly: no pairs are emitted,
only components. Where a family's chunks leave several components, a prefix filter brings those together
that may still be linked across chunks.
At a similarity of 0.85 a pair shares no band with a probability below 0.0001, at 0.9 below 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, shared

PERMUTATIONS, BANDS = 128, 32
WORDS = 5
#: A chunk of a family: so many shingles or sets. A block of what its chunks leave open: so many shingles at most; a
#: task compares two. What could fill a chunk is spread over at least so many blocks.
CHUNK_SHINGLES, CHUNK_SETS, BLOCK_SHINGLES, SPREAD = 1 << 17, 128, 1 << 20, 6

_U = np.uint64
_seed = shared.mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=_U) * _U(0x9E6C63D0876A9A47))
_XOR, _MUL = (_seed[:PERMUTATIONS] >> _U(32)).astype(np.uint32), (_seed[PERMUTATIONS:] >> _U(32)).astype(np.uint32) | np.uint32(1)
_STEP = [_U(pow(0xA24BAED4963EE407, k, 1 << 64)) for k in range(WORDS)]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, and the distinct shingles of each text as 128-bit hashes in two halves, sorted within it.

    A word's hash is of all its bytes; a shingle adds up its words' hashes, each times its own odd factor."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    words, which = shared.distinct(_LOWER[data], starts, ends)
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2).astype(_U)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    # texts of fewer words have one shingle of those
    short = np.flatnonzero((count > 0) & (count < WORDS))
    halves = []
    for half in (0, 1):
        word = digests[:, half][which]
        whole = np.zeros(max(0, len(word) - WORDS + 1), _U)
        for k in range(WORDS if len(whole) else 0):
            whole += word[k : k + len(whole)] * _STEP[k]
        few = np.zeros(len(short), _U)
        for k in range(WORDS - 1):
            more = count[short] > k
            few[more] += word[first[:-1][short][more] + k] * _STEP[k]
        halves.append((shared.mix(whole), shared.mix(few + count[short].astype(_U))))
    (low, few_low), (high, few_high) = halves
    out, at = [], np.zeros(len(count) + 1, np.int64)
    few = dict(zip(short.tolist(), range(len(short)), strict=True))
    for d, (f, c) in enumerate(zip(first[:-1].tolist(), count.tolist(), strict=True)):
        if c >= WORDS:
            own = _distinct(low[f : f + c - WORDS + 1], high[f : f + c - WORDS + 1])
        elif c:
            own = few_low[few[d] : few[d] + 1], few_high[few[d] : few[d] + 1]
        else:
            own = low[:0], high[:0]
        out.append(own)
        at[d + 1] = at[d] + len(own[0])
    if not out:
        return at, low[:0], high[:0]
    return at, np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _distinct(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs once each, sorted."""
    order = np.argsort(low)
    low, high = low[order], high[order]
    same = low[1:] == low[:-1]
    if (same & (high[1:] != high[:-1])).any():
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        same = (low[1:] == low[:-1]) & (high[1:] == high[:-1])
    new = np.ones(len(low), bool)
    new[1:] = ~same
    return low[new], high[new]


def bands_of(at: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Band hashes (texts x BANDS, uint64) of the texts' sets, none of which may be empty."""
    low = (sets >> _U(32)).astype(np.uint32)
    n, starts = len(at) - 1, at[:-1]
    small, large = np.empty((PERMUTATIONS, n), _U), np.empty((PERMUTATIONS, n), _U)
    for i in range(PERMUTATIONS):
        y = (low ^ _XOR[i]) * _MUL[i]
        small[i] = np.minimum.reduceat(y, starts)
        large[i] = np.maximum.reduceat(y, starts)
    out = np.empty((n, BANDS), _U)
    for b in range(BANDS):
        # the smallest of some permutations and the largest of others
        h = np.full(n, _U(b + 1), _U)
        for k in range(PERMUTATIONS // BANDS):
            h = shared.mix(h + small[b + k * BANDS])
            h = shared.mix(h + large[(b + 1) % BANDS + k * BANDS])
        out[:, b] = h
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in shared.pieces(batches):
        at, low, high = shingle_sets(*shared.bytes_of(b.column("text")))
        n = np.diff(at)
        full = np.flatnonzero(n)
        keys, bands = np.zeros((2, len(n)), _U), np.zeros((0, BANDS), _U)
        if len(full):
            tight = np.append(at[:-1][full], at[-1])
            keys[0, full] = np.add.reduceat(shared.mix(low), tight[:-1])
            keys[1, full] = np.add.reduceat(shared.mix(high ^ shared.mix(low)), tight[:-1])
            bands = bands_of(tight, low)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n > 0) * BANDS]), pa.int32()), pa.array(bands.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), lists], ["doc_id", "n_shingles", "key1", "key2", "bands"])


def confirm(low: np.ndarray, high: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """For each set the index of its component's first, where sets of at least percent similarity are linked.

    The sets lie end to end, each of its size. Overlaps of a few sets with all come at once: shingles that
    many sets have as a product of matrices, the others by an inverted index. First comes the set that
    shares most; what stays outside the largest component after that is compared with all.
    """
    g = len(size)
    owner = np.repeat(np.arange(g), size)
    order = np.argsort(low, kind="stable")
    same = low[order[1:]] == low[order[:-1]]
    if (same & (high[order[1:]] != high[order[:-1]])).any():
        order = np.lexsort((high, low))
        same = (low[order[1:]] == low[order[:-1]]) & (high[order[1:]] == high[order[:-1]])
    owner = owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = ~same
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(owner)))
    column = np.cumsum(new) - 1
    n = counts[column]
    base = int((counts == g).sum())
    many = (n > max(16, g // 16)) & (n < g)
    dense = np.zeros((g, len(np.unique(column[many]))), np.float32)
    dense[owner[many], np.unique(column[many], return_inverse=True)[1]] = 1
    few = np.flatnonzero((n > 1) & ~many & (n < g))
    few = few[np.argsort(owner[few], kind="stable")]
    at = np.searchsorted(owner[few], np.arange(g + 1))
    columns = column[few]
    shared_by = np.bincount(owner[n > 1], minlength=g)
    able = 100 * shared_by >= percent * size
    comp, open_ = np.arange(g), able.copy()
    step = max(1, min(256, (1 << 21) // g))

    def compare(rows: np.ndarray) -> None:
        others = np.flatnonzero(open_)
        overlap = base + (dense[rows] @ dense[others].T).astype(np.int64)
        if len(few):
            own = np.concatenate([columns[at[r] : at[r + 1]] for r in rows.tolist()])
            mine = np.repeat(np.arange(len(rows)), at[rows + 1] - at[rows])
            k = counts[own]
            where = np.repeat(starts[own] - np.cumsum(k) + k, k) + np.arange(k.sum())
            met = np.bincount(np.repeat(mine, k) * g + owner[where], minlength=len(rows) * g)
            overlap += met.reshape(len(rows), g)[:, others]
        linked = 100 * overlap >= percent * (size[rows][:, None] + size[others][None, :] - overlap)
        for r, ok in zip(rows.tolist(), linked, strict=True):
            met = np.unique(np.append(comp[others[ok]], comp[r]))
            if len(met) > 1:
                comp[np.isin(comp, met)] = met[0]
        open_[rows] = False

    if able.any():
        compare(np.array([np.where(able, shared_by, -1).argmax()]))
    while True:
        # what lies in the largest component meets the rest when the rest is compared
        outside = np.flatnonzero(open_ & (comp != np.bincount(comp[able], minlength=1).argmax())) if open_.any() else ()
        if not len(outside):
            return comp
        compare(outside[:step])


def _grouped(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Stream of rows sorted by task (family, i, j); each task's sets are confirmed together."""
    key, nodes, sets = None, [], []

    def done() -> pa.RecordBatch:
        halves = [np.frombuffer(s, _U).reshape(2, -1) for s in sets]
        comp = confirm(np.concatenate([x[0] for x in halves]), np.concatenate([x[1] for x in halves]), np.array([x.shape[1] for x in halves]), percent)
        ids = np.array(nodes, np.int64)
        for i in np.flatnonzero(ids[1:] == ids[:-1]).tolist():  # several sets of one doc_id
            comp[comp == comp[i + 1]] = comp[i]
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, comp, ids)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key[0])), pa.array(ids), pa.array(low[comp])], ["family", "node", "comp"])

    for b in batches:
        for k, node, s in zip(zip(*(b.column(c).to_pylist() for c in ("family", "i", "j")), strict=True), b.column("node").to_pylist(), b.column("shingles"), strict=True):
            if k != key:
                if nodes:
                    yield done()
                key, nodes, sets = k, [], []
            nodes.append(node)
            sets.append(s.as_py())
    if nodes:
        yield done()


def _confirmed(tasks: DataFrame, percent: int) -> DataFrame:
    """family, node, comp of tasks (family, i, j, node, shingles): comp is the smallest node that links reach in the task."""
    tasks = tasks.select("family", "i", "j", "node", "shingles").repartition(shared.parts(tasks.sparkSession), "family", "i", "j").sortWithinPartitions("family", "i", "j", "node")
    return tasks.mapInArrow(lambda it: _grouped(it, percent), "family long, node long, comp long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in shared.pieces(batches):
        at, low, high = shingle_sets(*shared.bytes_of(b.column("text")))
        at = at.tolist()
        found = pa.array([low[i:j].tobytes() + high[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("family", "chunks", "chunk", "node")), found], ["family", "chunks", "chunk", "node", "shingles"])


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The smallest shingles of a set, so many that every set linked with it has one of them among its own.

    x and y can only be linked if they share percent of the larger one's shingles, and 2 percent / (100 + percent)
    of the smaller one's: short marks those that do for a partner of the same size or a larger one."""
    for b in shared.pieces(batches, "shingles"):
        sets = [np.frombuffer(s.as_py(), np.int64).reshape(2, -1) for s in b.column("shingles")]
        size = np.array([x.shape[1] for x in sets])
        n = size + (-percent * size // 100) + 1
        short = size + (-2 * percent * size // (100 + percent)) + 1
        kept = [pa.array(np.repeat(b.column(c).to_numpy(), n)) for c in ("family", "node", "comp")]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        halves = [pa.array(np.concatenate([x[h, :k] for x, k in zip(sets, n.tolist(), strict=True)])) for h in (0, 1)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(place < np.repeat(short, n)), *halves], ["family", "node", "comp", "short", "low", "high"])


def _across(sets: DataFrame, found: DataFrame, percent: int, folder: str) -> DataFrame:
    """Links (a, b) between sets of one family that met in no chunk and aren't known to hang together.

    By the prefix filter, sets of two components that share a shingle of their prefixes, and what hangs
    together that way, are compared in full, block by block where they fill several.
    """
    key = ["family", "low", "high"]
    rest = shared.staged(sets.join(found.select("node", "comp"), "node").select("family", "node", "comp", "shingles"), folder, "rest")
    prefix = rest.mapInArrow(lambda it: _prefixes(it, percent), "family long, node long, comp long, short boolean, low long, high long")
    prefix = shared.staged(prefix, folder, "prefix")
    met = prefix.groupBy(*key).agg(F.min("node").alias("first"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.max("short").alias("short"))
    met = shared.staged(met.where("least < most AND short").select(*key, "first"), folder, "met")
    kin = graph.components(prefix.join(met, key).select(F.col("node").alias("a"), F.col("first").alias("b")), folder, "kin")
    rest = rest.select("node", "shingles").join(kin.withColumnRenamed("comp", "family"), "node")
    size = F.sum(F.length("shingles")) / 16
    blocks = F.greatest(F.ceil(size / BLOCK_SHINGLES), F.least(F.ceil(size / CHUNK_SHINGLES * 2), F.lit(SPREAD)))
    total = shared.staged(rest.groupBy("family").agg(blocks.cast("int").alias("blocks")), folder, "kin-sizes")
    rest = rest.join(total, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j != F.col("block")) | (F.col("blocks") == 1))
    tasks = rest.withColumn("other", F.explode(others)).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    out = shared.staged(_confirmed(tasks, percent).select(F.col("node").alias("a"), F.col("comp").alias("b")), folder, "across")
    for name in ("rest", "prefix", "met", "kin-sizes"):
        shared.unstage(sets.sparkSession, folder, name)
    return out


def near_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased; a set holds the
    distinct shingles of five words, or of fewer words all as one. Without words, or with a null text, the
    set is empty and links with nothing. Sets are linked where 100 * intersection >= percent * union;
    component_id is the smallest doc_id that links reach. Rows that share a doc_id share a component. A row
    with a null doc_id belongs to the class of rows with its set, and to no wider group where there is none.
    Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = shared.shared_dir(spark)
    text = shared.text_of(docs)
    keys = ["n_shingles", "key1", "key2"]
    marked = shared.staged(text.mapInArrow(_signatures, "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"), folder, "signatures")
    # small sides are staged, so that a join reads both sides from shuffles that skew handling can split
    classes = shared.staged(marked.where("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep")), folder, "classes")
    member = marked.join(classes, keys, "left").select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands"))
    member = shared.staged(member, folder, "members")
    shared.unstage(spark, folder, "signatures")
    shared.unstage(spark, folder, "classes")

    rows = member.where("bands IS NOT NULL").select("rep", F.explode("bands").alias("band"))
    pivots = rows.groupBy("band").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").select("band", "pivot")
    pivots = shared.staged(pivots, folder, "pivots")
    pairs = rows.join(pivots, "band").where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    families = graph.components(pairs, folder, "families")

    sized = families.join(member.where("bands IS NOT NULL").groupBy(F.col("rep").alias("node")).agg(F.max("n_shingles").alias("n")), "node")
    most = F.greatest(F.ceil(F.sum("n") / CHUNK_SHINGLES), F.ceil(F.count("*") / CHUNK_SETS))
    totals = shared.staged(sized.groupBy("comp").agg(most.cast("int").alias("chunks")), folder, "sizes")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    placed = shared.staged(families.join(totals, "comp").select("node", F.col("comp").alias("family"), "chunks", chunk.alias("chunk")), folder, "placed")
    sets = text.join(placed, F.col("doc_id") == F.col("node")).select("family", "chunks", "chunk", "node", "text")
    sets = shared.staged(sets.mapInArrow(_sets, "family long, chunks int, chunk int, node long, shingles binary"), folder, "sets")
    # a family's smallest node, which the others share bands with, is in every chunk
    chunks = F.when(F.col("node") == F.col("family"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    tasks = sets.withColumn("i", F.explode(chunks)).withColumn("j", F.col("i"))
    found = shared.staged(_confirmed(tasks, percent).groupBy("family", "node").agg(F.min("comp").alias("comp")), folder, "found")

    several = found.groupBy("family").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most")
    several = shared.staged(several.join(totals.where("chunks > 1"), F.col("family") == F.col("comp")).select("family"), folder, "several")
    done = found.select("node", "comp")
    if not several.isEmpty():
        across = _across(sets.join(several, "family", "left_semi"), found, percent, folder)
        links = found.join(several, "family", "left_semi").select(F.col("node").alias("a"), F.col("comp").alias("b")).union(across)
        done = done.union(graph.components(links, folder, "chunks"))
    done = shared.staged(done.groupBy("node").agg(F.min("comp").alias("comp")), folder, "components")
    for name in ("sizes", "placed", "sets", "found", "several"):
        shared.unstage(spark, folder, name)
    out = member.join(done, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("comp", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
