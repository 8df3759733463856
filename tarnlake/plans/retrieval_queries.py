"""Registered queries: scans, scopes, vector and keyword search, fusion, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, scope, text
from ..functions.scope import alive, visible, visible_fact
from ..operators import ranking, retrieval, state
from ..sources import views
from . import sql
from .registry import query

# The data's vectors are far apart: thresholds that select something are set here, defaults stay in fixed.
NEAR, LIKE, FLOOR = 0.40, 0.30, 0.05


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query("scan_point", f"WITH {views.MEMORIES} SELECT id, memory_type, importance, access_count FROM memories WHERE id = 42")
def scan_point(spark: SparkSession, d: str) -> DataFrame:
    return views.memories(spark, d, vectors=False, text=False).where("id = 42").select("id", "memory_type", "importance", "access_count")


@query("fact_point", f"WITH {views.MEMORIES}, {views.FACTS} SELECT f.id, f.memory_id, m.memory_type FROM facts f JOIN memories m ON m.id = f.memory_id WHERE f.id = 301 AND active_until IS NULL")
def fact_point(spark: SparkSession, d: str) -> DataFrame:
    f = views.facts(spark, d).where("id = 301 AND active_until IS NULL").select("id", "memory_id")
    return f.join(views.memories(spark, d, vectors=False, text=False).select(F.col("id").alias("memory_id"), "memory_type"), "memory_id").select("id", "memory_id", "memory_type")


@query("facts_by_ids", f"WITH {views.FACTS} SELECT id, fact FROM facts WHERE memory_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def facts_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = views.table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("memory_id"))
    return retrieval.among(views.facts(spark, d), ids, "memory_id").select("id", "fact")


@query("facts_active", f"WITH {views.FACTS} SELECT id, memory_id FROM facts WHERE active_until IS NULL")
def facts_active(spark: SparkSession, d: str) -> DataFrame:
    return views.facts(spark, d).where("active_until IS NULL").select("id", "memory_id")


@query("facts_of_memory", f"WITH {views.FACTS} SELECT id FROM facts WHERE memory_id = 3")
def facts_of_memory(spark: SparkSession, d: str) -> DataFrame:
    return views.facts(spark, d).where("memory_id = 3").select("id")


_Q = views.queries_sql(20)
_KNN = "row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank"
_ALL = f"""pairs AS (SELECT query_id, vec_id AS id, {sql.cosine('e.embedding::DOUBLE[]', 'query_embedding')} AS similarity FROM queries, embeddings e)"""


@query("knn_topk", f"WITH {views.queries_sql(1)}, {_ALL} SELECT query_id, id, similarity, rank FROM (SELECT *, {_KNN} FROM pairs) WHERE rank <= 30")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.knn(views.query_batch(spark, d, 1), _vectors(spark, d), 30)


@query("knn_batch_topk", f"WITH {_Q}, {_ALL} SELECT query_id, id, similarity, rank FROM (SELECT *, {_KNN} FROM pairs WHERE id <> query_id) WHERE rank <= 10")
def knn_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.knn(views.query_batch(spark, d), _vectors(spark, d), 10, other=True)


@query("knn_threshold_pairs", f"WITH {_Q}, {_ALL} SELECT query_id, id, similarity, rank FROM (SELECT *, {_KNN} FROM pairs WHERE id <> query_id AND similarity >= {LIKE}) WHERE rank <= 5")
def knn_threshold_pairs(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.knn(views.query_batch(spark, d), _vectors(spark, d), 5, least=LIKE, other=True)


def _scope(name: str, condition: str, **scope) -> None:
    @query(name, f"WITH {views.MEMORIES} SELECT id FROM memories WHERE {sql.alive()} AND {condition}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return views.memories(spark, d, vectors=False, text=False).where(visible(views.now(), **scope)).select("id")


_scope("scope_private", "agent_id = 1 AND user_id = 6", agent=1, user=6)
_scope("scope_agent", "agent_id = 2", agent=2)
_scope("scope_user_shared", "(agent_id = 1 AND user_id = 6 OR user_id = 6 AND shared)", agent=1, user=6, shared=True)
_scope("scope_task_shared", "(user_id = 6 OR task_id = 4 AND shared)", user=6, task=4)
_scope("scope_global", "(agent_id = 1 OR shared)", agent=1, shared=True)

_SCOPED = f"""scoped AS (
    SELECT query_id, query, id, memory_type, content, importance, access_count, created_at, {sql.cosine('m.embedding', 'query_embedding')} AS similarity
    FROM queries JOIN memories m ON m.user_id = query_user AND (m.agent_id = query_agent OR m.shared)
    WHERE m.embedding IS NOT NULL AND {sql.alive()})"""


def scoped(spark: SparkSession, d: str, n: int = 20) -> DataFrame:
    """Each query with the rows of its user that it may see. The stated queries meet rows by user."""
    q = views.query_batch(spark, d, n, asker=True)
    m = views.memories(spark, d).where("embedding IS NOT NULL")
    rows = m.join(q, (F.col("user_id") == F.col("query_user")) & visible(views.now(), agent=F.col("query_agent"), user=F.col("query_user"), shared=True))
    return retrieval.similarity(rows)


@query("scoped_knn", f"WITH {views.MEMORIES}, {_Q}, {_SCOPED} SELECT query_id, id, similarity, rank FROM (SELECT *, {_KNN} FROM scoped) WHERE rank <= 25")
def scoped_knn(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top(scoped(spark, d), 25, F.desc("similarity")).select("query_id", "id", "similarity", "rank")


@query(
    "access_counts_after_search",
    f"""WITH {views.MEMORIES}, {_Q}, {_SCOPED}, hit AS (SELECT id, count(*) AS n FROM (SELECT *, {_KNN} FROM scoped) WHERE rank <= 25 GROUP BY id)
    SELECT id, m.access_count + coalesce(n, 0) AS access_count, n IS NOT NULL AS touched FROM memories m LEFT JOIN hit USING (id)""",
)
def access_counts_after_search(spark: SparkSession, d: str) -> DataFrame:
    hits = scoped_knn(spark, d)
    rows = views.memories(spark, d, vectors=False, text=False).withColumn("last_accessed", F.lit(None).cast("timestamp_ntz"))
    out = state.apply_touches(rows, state.touch(hits, views.now()))
    return out.select("id", "access_count", F.col("last_accessed").isNotNull().alias("touched"))


@query(
    "fact_knn_joined",
    f"""WITH {views.MEMORIES}, {views.FACTS}, {_Q}, pairs AS (
        SELECT query_id, f.id, {sql.cosine('f.embedding', 'query_embedding')} AS similarity
        FROM queries JOIN memories m ON m.user_id = query_user JOIN facts f ON f.memory_id = m.id
        WHERE active_until IS NULL AND f.embedding IS NOT NULL AND {sql.alive('m.')})
    SELECT query_id, id, similarity, rank FROM (SELECT *, {_KNN} FROM pairs) WHERE rank <= 20""",
)
def fact_knn_joined(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.top(scoped_facts(spark, d), 20, F.desc("similarity")).select("query_id", "id", "similarity", "rank")


def scoped_facts(spark: SparkSession, d: str, n: int = 20) -> DataFrame:
    """Each query with the active facts of its user's memories."""
    m = views.memories(spark, d, vectors=False, text=False)
    m = m.select(F.col("id").alias("memory_id"), *(F.col(c).alias(f"m_{c}") for c in ("agent_id", "user_id", "task_id", "shared", "expires_at", "invalid_at")))
    q = views.query_batch(spark, d, n, asker=True)
    f = views.facts(spark, d).where("embedding IS NOT NULL").join(m, "memory_id")
    rows = f.join(q, (F.col("m_user_id") == F.col("query_user")) & visible_fact(views.now(), user=F.col("query_user")))
    return retrieval.similarity(rows)


@query(
    "facts_exist",
    f"""WITH {views.MEMORIES}, {views.FACTS} SELECT a.agent_id, EXISTS (SELECT 1 FROM facts f JOIN memories m ON m.id = f.memory_id WHERE m.agent_id = a.agent_id AND active_until IS NULL AND {sql.alive('m.')}) AS has_facts
    FROM (SELECT DISTINCT agent_id FROM memories) a""",
)
def facts_exist(spark: SparkSession, d: str) -> DataFrame:
    m = views.memories(spark, d, vectors=False, text=False)
    own = m.where(alive(views.now())).select(F.col("id").alias("memory_id"), "agent_id").join(views.facts(spark, d).where("active_until IS NULL"), "memory_id", "left_semi")
    return m.select("agent_id").distinct().join(own.select("agent_id", F.lit(True).alias("_has")).distinct(), "agent_id", "left").select("agent_id", F.coalesce("_has", F.lit(False)).alias("has_facts"))


_SHORT = f"array_to_string(({sql.tokens('query', 2, fixed.ENTITY_STOPWORDS)})[1:2], ' ')"
_POSTINGS = f"""postings AS (
    SELECT id, words, lexeme, count(*) AS n FROM (SELECT id, len(all_) AS words, unnest(all_) AS lexeme FROM (SELECT id, {sql.tokens('content', 2, fixed.ENTITY_STOPWORDS)} AS all_ FROM memories)) GROUP BY ALL),
asked AS (SELECT query_id, unnest(lex) AS lexeme, len(lex) AS k FROM (SELECT query_id, {sql.lexemes(_SHORT)} AS lex FROM queries))"""
_MATCHED = """matched AS (
    SELECT query_id, id, round(sum(round((1 + ln(n)) / (1 + ln(words)), 9)) / k, 6) AS score FROM postings JOIN asked USING (lexeme) GROUP BY query_id, id, k HAVING count(*) = k)"""
_BY_SCORE = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank"


def short_queries(spark: SparkSession, d: str) -> DataFrame:
    """The batch's questions, shortened to their first two words that count; whole ones as they are."""
    q = views.query_batch(spark, d)
    if views.is_whole():
        return q
    return q.withColumn("query", F.array_join(F.slice(text.tokens(F.col("query"), 2, fixed.ENTITY_STOPWORDS), 1, 2), " "))


@query("keyword_match_topk", f"WITH {views.MEMORIES}, {_Q}, {_POSTINGS}, {_MATCHED} SELECT query_id, id, score, rank FROM (SELECT *, {_BY_SCORE} FROM matched) WHERE rank <= 20")
def keyword_match_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_search(short_queries(spark, d), views.memories(spark, d, vectors=False), 20)


_MAY = "(agent_id = query_agent AND user_id = query_user OR user_id = query_user AND shared)"


def asking(spark: SparkSession, d: str) -> DataFrame:
    """Every question whose id is divisible by 50, of its first counted word, with its user and agent."""
    with views.whole():
        q = views.query_batch(spark, d, asker=True)
    return q.withColumns({"query": F.get(text.tokens(F.col("query"), 2, fixed.ENTITY_STOPWORDS), F.lit(0)), "query_shared": F.lit(True)})


_ASKING = views.queries_sql().replace("vec_id < 20", "vec_id % 50 = 0") + f", one AS (SELECT *, ({sql.tokens('query', 2, fixed.ENTITY_STOPWORDS)})[1] AS lexeme FROM queries)"


def _scoped_search(rows: str) -> str:
    return f"""found AS (SELECT query_id, id, round((1 + ln(count(*))) / (1 + ln(words)), 6) AS score FROM one JOIN (
        SELECT id, agent_id, user_id, shared, len(all_) AS words, unnest(all_) AS lexeme FROM (SELECT id, agent_id, user_id, shared, {sql.tokens('content', 2, fixed.ENTITY_STOPWORDS)} AS all_ FROM {rows})) r
        ON r.lexeme = one.lexeme AND {_MAY} GROUP BY query_id, id, words)
    SELECT query_id, id, score, rank FROM (SELECT *, {_BY_SCORE} FROM found) WHERE rank <= 20"""


@query("scoped_keyword_topk", f"WITH {views.MEMORIES}, {_ASKING}, live AS (SELECT * FROM memories WHERE {sql.alive()}), {_scoped_search('live')}")
def scoped_keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.keyword_search(asking(spark, d), views.memories(spark, d, vectors=False).where(alive(views.now())), 20)


@query(
    "scoped_fact_keyword_topk",
    f"""WITH {views.MEMORIES}, {views.FACTS}, {_ASKING}, live AS (SELECT f.id, m.agent_id, m.user_id, m.shared, f.fact AS content FROM facts f JOIN memories m ON m.id = f.memory_id
        WHERE active_until IS NULL AND {sql.alive('m.')}), {_scoped_search('live')}""",
)
def scoped_fact_keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    m = views.memories(spark, d, vectors=False, text=False).where(alive(views.now())).select(F.col("id").alias("memory_id"), *scope.ROW)
    return retrieval.keyword_search(asking(spark, d), views.facts(spark, d).where("active_until IS NULL").join(m, "memory_id"), 20, "fact")


@query(
    "scoped_knn_search",
    f"""WITH {views.MEMORIES}, {views.queries_sql().replace("vec_id < 20", "vec_id % 50 = 0")}, found AS (SELECT query_id, id, {sql.cosine('m.embedding', 'query_embedding')} AS similarity
        FROM queries JOIN memories m ON {_MAY} WHERE m.embedding IS NOT NULL AND {sql.alive()}) SELECT query_id, id, similarity, rank FROM (SELECT *, {_KNN} FROM found) WHERE rank <= 25""",
)
def scoped_knn_search(spark: SparkSession, d: str) -> DataFrame:
    """The search of a recall: every question whose id is divisible by 50, each over what it may see."""
    return retrieval.knn(asking(spark, d), views.memories(spark, d).where(alive(views.now())), 25)


@query(
    "bm25_topk",
    f"""WITH {views.MEMORIES}, {_Q}, {_POSTINGS}, sizes AS (SELECT count(*) AS rows, avg(words) AS mean FROM (SELECT DISTINCT id, words FROM postings)),
    seen AS (SELECT lexeme, count(*) AS df FROM postings GROUP BY lexeme),
    scored AS (SELECT query_id, id, round(sum(round(ln(1 + (rows - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (n * 2.2::DOUBLE / (n + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * words / mean))), 9)), 6) AS score
        FROM postings JOIN asked USING (lexeme) JOIN seen USING (lexeme), sizes GROUP BY query_id, id)
    SELECT query_id, id, score, rank FROM (SELECT *, {_BY_SCORE} FROM scored) WHERE rank <= 10""",
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(short_queries(spark, d), views.memories(spark, d, vectors=False), 10)


_FUSED = f"""v AS (SELECT query_id, id, rank AS vector_rank FROM (SELECT *, {_KNN} FROM (SELECT query_id, m.id, {sql.cosine('m.embedding', 'query_embedding')} AS similarity FROM queries, memories m WHERE m.embedding IS NOT NULL)) WHERE rank <= 25),
w AS (SELECT query_id, id, rank AS keyword_rank FROM (SELECT *, {_BY_SCORE} FROM matched) WHERE rank <= 25),
fused AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) + CASE WHEN vector_rank IS NOT NULL AND keyword_rank IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END, 9) AS rrf_score,
    CASE WHEN keyword_rank IS NULL THEN 'vector' WHEN vector_rank IS NULL THEN 'keyword' ELSE 'vector+keyword' END AS sources FROM v FULL JOIN w USING (query_id, id)),
ranked AS (SELECT *, round(rrf_score / greatest(max(rrf_score) OVER (PARTITION BY query_id), 0.001::DOUBLE), 6) AS similarity,
    row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST, id) AS rank FROM fused)"""
_FUSION = f"WITH {views.MEMORIES}, {_Q}, {_POSTINGS}, {_MATCHED}, {_FUSED}"


def fused(spark: SparkSession, d: str) -> DataFrame:
    m = views.memories(spark, d)
    v = retrieval.knn(views.query_batch(spark, d), m.select("id", "embedding"), 25)
    return retrieval.fuse(v, retrieval.keyword_search(short_queries(spark, d), m.drop("embedding"), 25))


@query("rrf_fusion", f"{_FUSION} SELECT query_id, id, rrf_score, sources, similarity, rank FROM ranked")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d).select("query_id", "id", "rrf_score", "sources", "similarity", "rank")


@query("rrf_noise_floor", f"{_FUSION} SELECT query_id, count(*) AS kept, count(*) FILTER (WHERE sources = 'vector+keyword') AS from_both FROM ranked WHERE similarity >= 0.35 GROUP BY query_id")
def rrf_noise_floor(spark: SparkSession, d: str) -> DataFrame:
    kept = fused(spark, d).where(F.col("similarity") >= fixed.MIN_SIMILARITY)
    return kept.groupBy("query_id").agg(F.count("*").alias("kept"), F.count_if(F.col("sources") == "vector+keyword").alias("from_both"))


_SCORE = f"similarity * similarity * 0.65::DOUBLE + {sql.recency('created_at')} * 0.15::DOUBLE + importance * 0.15::DOUBLE + access_count / greatest(max(access_count) OVER (PARTITION BY query_id), 1) * 0.05::DOUBLE"


@query(
    "rank_memories",
    f"""WITH {views.MEMORIES}, {_Q}, {_SCOPED}, scored AS (SELECT query_id, id, similarity, round({_SCORE.replace('similarity * similarity', 'greatest(similarity, 0) * greatest(similarity, 0)')}, 6) AS score FROM scoped WHERE similarity >= {FLOOR})
    SELECT query_id, id, similarity, score, rank FROM (SELECT *, {_BY_SCORE} FROM scored) WHERE rank <= 20""",
)
def rank_memories(spark: SparkSession, d: str) -> DataFrame:
    out = ranking.rank_memories(scoped(spark, d), views.now(), floor=FLOOR)
    return out.where("rank <= 20").select("query_id", "id", "similarity", "score", "rank")


_ASKED = "CASE query_id % 4 WHEN 0 THEN 'When was it?' WHEN 1 THEN 'What happened recently?' WHEN 2 THEN 'What is it?' END"
_DATED = "CASE WHEN turn % 3 = 0 THEN fact || ' on ' || (memory_id % 28 + 1) || ' march 20' || lpad((turn % 24)::VARCHAR, 2, '0') ELSE fact END"


@query(
    "rank_facts_temporal",
    f"""WITH {views.MEMORIES}, {views.FACTS}, {_Q}, pairs AS (
        SELECT query_id, f.id, f.importance, f.created_at, {sql.cosine('f.embedding', 'query_embedding')} AS similarity, {_ASKED} AS asked, {_DATED} AS dated
        FROM queries JOIN memories m ON m.user_id = query_user JOIN facts f ON f.memory_id = m.id WHERE active_until IS NULL AND f.embedding IS NOT NULL AND {sql.alive('m.')}),
    base AS (SELECT *, (greatest(similarity, 0) * greatest(similarity, 0) * 0.7::DOUBLE + {sql.recency('created_at')} * 0.15::DOUBLE + importance * 0.15::DOUBLE)
            * CASE WHEN {sql.any_match("coalesce(asked, '')", fixed.TEMPORAL_QUERY)} AND {sql.any_match('dated', fixed.DATES)} THEN 1.3::DOUBLE ELSE 1 END AS b,
            CASE WHEN regexp_matches(dated, '\\d march \\d', 'i') THEN make_date(regexp_extract(dated, '(\\d{{1,2}}) march (\\d{{4}})', 2)::INT, 3, 1) + (regexp_extract(dated, '(\\d{{1,2}}) march (\\d{{4}})', 1)::INT - 1) END AS day
        FROM pairs WHERE similarity >= {FLOOR}),
    boosted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY day DESC NULLS LAST, id) AS newest FROM base),
    scored AS (SELECT query_id, id, similarity, round(b * CASE WHEN {sql.match("coalesce(asked, '')", fixed.RECENCY_QUERY)} AND day IS NOT NULL THEN coalesce([1.5, 1.3, 1.1][newest]::DOUBLE, 1) ELSE 1 END, 6) AS score FROM boosted)
    SELECT query_id, id, similarity, score, rank FROM (SELECT *, {_BY_SCORE} FROM scored)""",
)
def rank_facts_temporal(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("query_id") % 4
    f = scoped_facts(spark, d).withColumn("query", F.when(i == 0, F.lit("When was it?")).when(i == 1, F.lit("What happened recently?")).when(i == 2, F.lit("What is it?")))
    stamp = F.concat(F.col("fact"), F.lit(" on "), (F.col("memory_id") % 28 + 1).cast("string"), F.lit(" march 20"), F.lpad((F.col("turn") % 24).cast("string"), 2, "0"))
    f = f.withColumn("fact", F.when(F.col("turn") % 3 == 0, stamp).otherwise(F.col("fact")))
    return ranking.rank_facts(f, views.now(), floor=FLOOR).select("query_id", "id", "similarity", "score", "rank")


@query(
    "rerank_blend",
    f"""WITH {views.MEMORIES}, {_Q}, {_SCOPED}, top AS (SELECT * FROM (SELECT *, {_KNN} FROM scoped) WHERE rank <= 15),
    lexed AS (SELECT *, {sql.lexemes('query')} AS q, {sql.lexemes('content')} AS c FROM top),
    scored AS (SELECT *, CASE WHEN rank <= 10 THEN round(1 / (1 + exp(-(coalesce(len(list_filter(q, lambda x: list_contains(c, x))) / nullif(len(q), 0)::DOUBLE, 0) * 8 - 4))), 6) END AS cross_encoder_score FROM lexed)
    SELECT query_id, id, rank, cross_encoder_score, CASE WHEN rank <= 10 THEN round(similarity * 0.6::DOUBLE + cross_encoder_score * 0.4::DOUBLE, 6) ELSE similarity END AS similarity
    FROM scored WHERE rank > 10 OR cross_encoder_score >= 0.2""",
)
def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    near = retrieval.top(scoped(spark, d), 15, F.desc("similarity"))
    return ranking.rerank(near, ranking.lexical_logit(F.col("query"), F.col("content"))).select("query_id", "id", "rank", "cross_encoder_score", "similarity")


@query(
    "newest_rows",
    f"WITH {views.MEMORIES} SELECT id, left(content, 60) || CASE WHEN length(content) > 60 THEN '...' ELSE '' END AS excerpt FROM memories ORDER BY created_at DESC, id LIMIT 3",
)
def newest_rows(spark: SparkSession, d: str) -> DataFrame:
    m = views.memories(spark, d, vectors=False)
    return m.orderBy(F.desc_nulls_first("created_at"), "id").limit(3).select("id", text.excerpt(F.col("content")).alias("excerpt"))


@query(
    "union_first_source",
    f"""WITH {_Q}, {_ALL}, k AS (SELECT query_id, id, similarity, {_KNN} FROM pairs),
    u AS (SELECT query_id, id, 'near' AS source, 0 AS o FROM k WHERE rank <= 5 UNION ALL SELECT query_id, id, 'wide', 1 FROM k WHERE rank BETWEEN 3 AND 9)
    SELECT query_id, id, arg_min(source, o) AS source FROM u GROUP BY query_id, id""",
)
def union_first_source(spark: SparkSession, d: str) -> DataFrame:
    k = retrieval.knn(views.query_batch(spark, d), _vectors(spark, d), 9).select("query_id", "id", "rank")
    near, wide = (k.where(c).select("query_id", "id", F.lit(s).alias("source")) for s, c in (("near", "rank <= 5"), ("wide", "rank BETWEEN 3 AND 9")))
    return retrieval.first_by_source(near, wide)


@query("exclude_ids", f"WITH {_Q}, {_ALL}, k AS (SELECT query_id, id, similarity, {_KNN} FROM pairs) SELECT query_id, id FROM k WHERE rank <= 9 AND id NOT IN (SELECT query_id FROM queries)")
def exclude_ids(spark: SparkSession, d: str) -> DataFrame:
    q = views.query_batch(spark, d)
    return retrieval.without(retrieval.knn(q, _vectors(spark, d), 9), q.select(F.col("query_id").alias("id"))).select("query_id", "id")
