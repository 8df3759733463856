"""Vector, keyword and fused retrieval for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, scope, text, vector

#: Queries that one pass over the rows may carry; more take further passes.
QUERY_BLOCK = 2048


def knn(queries: DataFrame, rows: DataFrame, k: int, least: float | None = None, other: bool = False, older: bool = False) -> DataFrame:
    """For each query the k rows of largest cosine: query_id, id, similarity (rounded to 6), rank.

    queries: query_id, query_embedding, a stated set, taken in blocks of QUERY_BLOCK. rows: id, embedding,
    any number: each partition multiplies its vectors with the block's matrix and sends on its own k best
    of each query, so that the shuffle holds at most k rows for each query and partition. Ties go to the
    smaller id. least: similarities below it don't count. other: a row is no answer to a query of its id; older: nor is one of a larger id.
    Where the queries have columns of a scope, rows need theirs, and a query finds only what it may see.
    """
    asks = scope.asks(queries)
    given = queries.where("query_embedding IS NOT NULL").select(F.col("query_id").cast("long"), "query_embedding", *asks).orderBy("query_id").collect()
    spark, found = rows.sparkSession, None
    for at in range(0, len(given), QUERY_BLOCK):
        block = given[at : at + QUERY_BLOCK]
        ids = np.array([r.query_id for r in block], np.int64)
        matrix = _unit(np.array([r.query_embedding for r in block], np.float64))
        who = _who(block, asks)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix, who=who) -> Iterator[pa.RecordBatch]:
            best: tuple[np.ndarray, ...] | None = None
            for b in _short(batches, len(ids)):
                v = b.column("embedding")
                flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                own = b.column("id").to_numpy()
                if not len(own):
                    continue
                sims = np.round(_unit(flat.reshape(len(own), -1)) @ matrix.T, 6)
                if other:
                    sims[own[:, None] == ids[None, :]] = -np.inf
                if older:
                    sims[own[:, None] >= ids[None, :]] = -np.inf
                if least is not None:
                    sims[sims < least] = -np.inf
                if asks:
                    sims[~scope.mask(who, _whose(b))] = -np.inf
                sims[np.isnan(sims)] = -np.inf
                if len(own) > k:  # what is below a query's k-th best here can't be among its k best
                    sims[sims < np.partition(sims, len(own) - k, axis=0)[len(own) - k]] = -np.inf
                r, q = np.nonzero(np.isfinite(sims))
                cols = (ids[q], own[r], sims[r, q])
                best = _best(cols if best is None else tuple(map(np.concatenate, zip(best, cols, strict=True))), k)
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["query_id", "id", "similarity"])

        size = matrix.shape[1]
        near = rows.where(F.size("embedding") == size).select(F.col("id").cast("long").alias("id"), "embedding", *(scope.ROW if asks else ())).mapInArrow(run, "query_id long, id long, similarity double")
        found = near if found is None else found.unionAll(near)
    if found is None:
        found = spark.createDataFrame([], "query_id long, id long, similarity double")
    return top(found, k, F.desc("similarity"))


#: Similarities that a worker holds at a time.
MOST_CELLS = 1 << 21


def _short(batches: Iterator[pa.RecordBatch], queries: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of so many rows that MOST_CELLS holds their similarities to the queries."""
    step = max(1, MOST_CELLS // max(1, queries))
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _who(block: list, asks: list[str]) -> dict[str, np.ndarray]:
    return {c: np.array([r[c] if c in asks else None for r in block], object) for c in scope.QUERY}


def _whose(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: np.array(b.column(c).to_pylist(), object) for c in scope.ROW}


def seeing(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id of the queries that may see some row; without a scope all or none. Rows stay where they are."""
    asks = scope.asks(queries)
    if not asks:
        return queries.select("query_id").where(F.lit(not rows.isEmpty()))
    given = queries.select(F.col("query_id").cast("long"), *asks).orderBy("query_id").collect()
    ids, who = np.array([r.query_id for r in given], np.int64), _who(given, asks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(ids), bool)
        for b in _short(batches, len(ids)):
            seen |= scope.mask(who, _whose(b)).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[seen])], ["query_id"])

    return rows.select(*scope.ROW).distinct().mapInArrow(run, "query_id long").distinct()


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.full_like(m, np.nan), where=n > 0)


def _best(cols: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((cols[1], -cols[2], cols[0]))
    query = cols[0][order]
    start = np.searchsorted(query, query)
    order = order[np.arange(len(order)) - start < k]
    return tuple(c[order] for c in cols)


def top(df: DataFrame, k: int | None, *by: Column, partition: str = "query_id", key: str = "id") -> DataFrame:
    """Rank rows of each partition by the order, then key; keep k (all where None)."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(*by, key)))
    return out if k is None else out.where(F.col("rank") <= k)


def similarity(pairs: DataFrame, a: str = "embedding", b: str = "query_embedding") -> DataFrame:
    """Add similarity to pairs that a join has made; stays in the JVM."""
    return pairs.withColumn("similarity", F.round(vector.cosine(F.col(a), F.col(b)), 6))


def keyword_search(queries: DataFrame, rows: DataFrame, k: int, column: str = "content") -> DataFrame:
    """Rows that hold every lexeme of a query: query_id, id, score, rank. A query without lexemes has none.

    The queries' lexemes meet the rows' postings in an equi-join; only lexemes that some query asks for
    leave the rows. The score is the mean over the query's lexemes of 1 + ln(count), over 1 + ln(words).
    Where the queries have columns of a scope, rows need theirs, and a query finds only what it may see.
    """
    asks = scope.asks(queries)
    asked = queries.select("query_id", text.lexemes(F.col("query")).alias("_q"), *asks).select("query_id", F.size("_q").alias("_n"), F.explode("_q").alias("lexeme"), *asks)
    return top(_matched(asked, postings(rows, column, asked, scope.ROW if asks else ()), asks).where(F.col("_hit") == F.col("_n")).select("query_id", "id", "score"), k, F.desc("score"))


def postings(rows: DataFrame, column: str = "content", asked: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """id, words (how many lexemes with repeats), lexeme, n, and the columns of more; of the lexemes in asked
    alone, if given, before anything is counted or moved."""
    all_ = text.tokens(F.col(column), 2, fixed.ENTITY_STOPWORDS)
    each = rows.select("id", all_.alias("_all"), *more).select("id", F.size("_all").alias("words"), F.explode("_all").alias("lexeme"), *more)
    if asked is not None:
        each = each.join(asked.select("lexeme").distinct(), "lexeme", "left_semi")
    return each.groupBy("id", "words", "lexeme", *more).agg(F.count("*").alias("n"))


def _matched(asked: DataFrame, post: DataFrame, asks: list[str]) -> DataFrame:
    weight = (F.lit(1.0) + F.log("n")) / (F.lit(1.0) + F.log("words"))
    met = post.join(asked, "lexeme")
    return (met.where(scope.in_scope(asks)) if asks else met).groupBy("query_id", "id", "_n").agg(F.count("*").alias("_hit"), F.round(F.sum(F.round(weight, 9)) / F.col("_n"), 6).alias("score"))


def bm25(queries: DataFrame, rows: DataFrame, k: int, column: str = "content", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows that hold any lexeme of a query by BM25 with corpus statistics over all rows: query_id, id, score, rank."""
    asked = queries.select("query_id", F.explode(text.lexemes(F.col("query"))).alias("lexeme"))
    post = postings(rows, column, asked)
    words = F.size(text.tokens(F.col(column), 2, fixed.ENTITY_STOPWORDS))
    sizes = rows.select(words.alias("words")).where("words > 0").agg(F.count("*").alias("rows"), F.avg("words").alias("mean"))
    seen = post.groupBy("lexeme").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("_corpus.rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("words") / F.col("_corpus.mean")))
    hit = post.join(asked, "lexeme").join(seen, "lexeme").withColumn("_corpus", sizes.select(F.struct("rows", "mean")).scalar())
    return top(hit.groupBy("query_id", "id").agg(F.round(F.sum(F.round(idf * tf, 9)), 6).alias("score")), k, F.desc("score"))


def fuse(by_vector: DataFrame, by_keyword: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: query_id, id, vector_rank, keyword_rank, rrf_score, sources, similarity, rank.

    A row in both lists has a bonus; similarity is the score over the query's largest, at least 0.001. Ties
    keep the order of the vector list, then that of rows found by keyword alone.
    """
    v = by_vector.select("query_id", "id", F.col("rank").alias("vector_rank"))
    w = by_keyword.select("query_id", "id", F.col("rank").alias("keyword_rank"))

    def part(c: str) -> Column:
        return F.coalesce(F.lit(1.0) / (fixed.RRF_K + F.col(c)), F.lit(0.0))

    both = F.col("vector_rank").isNotNull() & F.col("keyword_rank").isNotNull()
    score = part("vector_rank") + part("keyword_rank") + F.when(both, F.lit(fixed.RRF_BONUS)).otherwise(F.lit(0.0))
    sources = F.filter(F.array(F.when(F.col("vector_rank").isNotNull(), F.lit("vector")), F.when(F.col("keyword_rank").isNotNull(), F.lit("keyword"))), lambda s: s.isNotNull())
    out = v.join(w, ["query_id", "id"], "full_outer").withColumns({"rrf_score": F.round(score, 9), "sources": F.array_join(sources, "+")})
    most = F.greatest(F.max("rrf_score").over(Window.partitionBy("query_id")), F.lit(0.001))
    out = out.withColumn("similarity", F.round(F.col("rrf_score") / most, 6))
    return top(out, None, F.desc("rrf_score"), F.col("vector_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last())


def first_by_source(*candidates: DataFrame, key: str = "id") -> DataFrame:
    """Union of candidate lists (query_id, key, ...) in which a key keeps its row of the earliest list."""
    out = None
    for i, c in enumerate(candidates):
        c = c.withColumn("_source", F.lit(i))
        out = c if out is None else out.unionByName(c)
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", key).orderBy("_source"))).where("_n = 1").drop("_n", "_source")


def without(candidates: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Candidates whose key is not among ids."""
    return candidates.join(ids.select(key).distinct(), key, "left_anti")


def among(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among ids."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")
