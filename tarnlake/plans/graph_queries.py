"""Registered queries: the mention graph and what is found through it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, retrieval
from ..sources import views
from . import sql
from .registry import ORACLES, query

_SEEDS = "seeds AS (SELECT o_orderkey AS memory_id FROM orders WHERE o_orderkey % 500 = 7)"


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "orders").where("o_orderkey % 500 = 7").select(F.col("o_orderkey").alias("memory_id"))


#: Every row whose id is divisible by 50.
_SEEDS_WHOLE = _SEEDS.replace("% 500 = 7", "% 50 = 0")


def _seeds_whole(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("memory_id"))


@query("entities_of_memories", f"WITH {views.MENTIONS}, {_SEEDS} SELECT memory_id, entity_id FROM mentions WHERE memory_id IN (SELECT memory_id FROM seeds)")
def entities_of_memories(spark: SparkSession, d: str) -> DataFrame:
    return graph.entities_of(_seeds(spark, d), views.mentions(spark, d)).select("memory_id", "entity_id")


@query("entities_of_memories_whole", ORACLES["entities_of_memories"].replace(_SEEDS, _SEEDS_WHOLE))
def entities_of_memories_whole(spark: SparkSession, d: str) -> DataFrame:
    return graph.entities_of(_seeds_whole(spark, d), views.mentions(spark, d)).select("memory_id", "entity_id")


@query(
    "memories_of_entities",
    f"WITH {views.MENTIONS} SELECT memory_id, count(*) AS n_entities FROM mentions WHERE entity_id IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#4' AND p_size < 10) GROUP BY memory_id",
)
def memories_of_entities(spark: SparkSession, d: str) -> DataFrame:
    parts = views.table(spark, d, "part").where("p_brand = 'Brand#4' AND p_size < 10").select(F.col("p_partkey").alias("entity_id"))
    return graph.mentioning(parts, views.mentions(spark, d))


@query(
    "graph_neighbours_1hop",
    f"WITH {views.MENTIONS}, {_SEEDS} SELECT a.memory_id, b.memory_id AS other, count(*) AS n_entities FROM mentions a JOIN seeds USING (memory_id) JOIN mentions b ON a.entity_id = b.entity_id AND a.memory_id <> b.memory_id GROUP BY ALL",
)
def graph_neighbours_1hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_seeds(spark, d), views.mentions(spark, d))


@query("graph_neighbours_1hop_whole", ORACLES["graph_neighbours_1hop"].replace(_SEEDS, _SEEDS_WHOLE))
def graph_neighbours_1hop_whole(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_seeds_whole(spark, d), views.mentions(spark, d))


_EDGES = "edges AS (SELECT row_number() OVER (ORDER BY a, b) AS e, a, b FROM (SELECT DISTINCT l_orderkey % 3000 AS a, 3000 + l_suppkey AS b FROM lineitem WHERE l_linenumber = 1))"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """A sparser graph: orders by thousands, and the supplier of their first line."""
    e = views.table(spark, d, "lineitem").where("l_linenumber = 1").select((F.col("l_orderkey") % 3000).alias("a"), (F.col("l_suppkey") + 3000).alias("b")).distinct()
    return e.withColumn("edge_id", F.xxhash64("a", "b"))


@query(
    "graph_neighbours_2hop",
    f"""WITH {_EDGES}, both_ AS (SELECT e, a, b FROM edges UNION ALL SELECT e, b, a FROM edges), s AS (SELECT s_suppkey + 3000 AS a FROM supplier WHERE s_suppkey < 5),
    one AS (SELECT s.a AS start, x.b AS node, e FROM s JOIN both_ x ON x.a = s.a),
    two AS (SELECT start, y.b AS node FROM one JOIN both_ y ON y.a = node WHERE y.e <> one.e)
    SELECT start, node, min(hops) AS hops FROM (SELECT start, node, 1 AS hops FROM one UNION ALL SELECT start, node, 2 FROM two) GROUP BY start, node""",
)
def graph_neighbours_2hop(spark: SparkSession, d: str) -> DataFrame:
    s = views.table(spark, d, "supplier").where("s_suppkey < 5").select((F.col("s_suppkey") + 3000).alias("node"))
    return graph.traverse(s, _edges(spark, d), 2)


#: The supplier of every line; orders take even numbers, suppliers odd ones.
_EDGES_WHOLE = "edges AS (SELECT row_number() OVER (ORDER BY a, b) AS e, a, b FROM (SELECT DISTINCT l_orderkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem))"
_STARTS_WHOLE = "s AS (SELECT s_suppkey * 2 + 1 AS a FROM supplier WHERE s_suppkey % 50 = 0)"


@query("graph_neighbours_2hop_whole", ORACLES["graph_neighbours_2hop"].replace(_EDGES, _EDGES_WHOLE).replace("s AS (SELECT s_suppkey + 3000 AS a FROM supplier WHERE s_suppkey < 5)", _STARTS_WHOLE))
def graph_neighbours_2hop_whole(spark: SparkSession, d: str) -> DataFrame:
    """The graph of all lines with the orders' own keys, from every supplier whose key is divisible by 50."""
    e = views.table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).distinct()
    s = views.table(spark, d, "supplier").where("s_suppkey % 50 = 0").select((F.col("s_suppkey") * 2 + 1).alias("node"))
    return graph.traverse(s, e.withColumn("edge_id", F.xxhash64("a", "b")), 2)


@query("entity_cooccurrence", f"WITH {views.MENTIONS} SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n FROM mentions a JOIN mentions b ON a.memory_id = b.memory_id AND a.entity_id < b.entity_id GROUP BY ALL")
def entity_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return graph.cooccurrence(views.mentions(spark, d))


_FACT_MENTIONS = "fact_mentions AS (SELECT f.id, entity_id FROM facts f JOIN mentions USING (memory_id) WHERE active_until IS NULL)"


@query("backfill_fact_entities", f"WITH {views.MENTIONS}, {views.FACTS}, {_FACT_MENTIONS} SELECT DISTINCT id, entity_id FROM fact_mentions")
def backfill_fact_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.backfill(views.facts(spark, d), views.mentions(spark, d))


_Q = views.queries_sql(20)


@query(
    "graph_expand_knn",
    f"""WITH {views.MEMORIES}, {views.MENTIONS}, {views.FACTS}, {_FACT_MENTIONS}, {_Q},
    near AS (SELECT query_id, id FROM (SELECT query_id, f.id, row_number() OVER (PARTITION BY query_id ORDER BY {sql.cosine('f.embedding', 'query_embedding')} DESC, f.id) AS rank FROM queries, facts f WHERE active_until IS NULL AND f.embedding IS NOT NULL) WHERE rank <= 5),
    linked AS (SELECT DISTINCT n.query_id, y.id FROM near n JOIN fact_mentions x ON x.id = n.id JOIN fact_mentions y ON y.entity_id = x.entity_id),
    scored AS (SELECT l.query_id, f.id, {sql.cosine('f.embedding', 'query_embedding')} AS similarity FROM linked l JOIN facts f ON f.id = l.id JOIN queries q ON q.query_id = l.query_id
        JOIN memories m ON m.id = f.memory_id WHERE f.embedding IS NOT NULL AND {sql.alive('m.')} AND (l.query_id, l.id) NOT IN (SELECT (query_id, id) FROM near))
    SELECT query_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM scored) WHERE rank <= 10""",
)
def graph_expand_knn(spark: SparkSession, d: str) -> DataFrame:
    """Facts that share an entity with a query's five nearest, ranked by cosine among rows that may be seen."""
    q = views.query_batch(spark, d)
    f = views.facts(spark, d).where("active_until IS NULL")
    near = retrieval.knn(q, f, 5).select("query_id", "id")
    m = graph.backfill(f, views.mentions(spark, d))
    linked = near.join(m, "id").select("query_id", "entity_id").distinct().join(m, "entity_id").select("query_id", "id").distinct()
    linked = linked.join(near, ["query_id", "id"], "left_anti")
    from ..functions.scope import alive

    seen = views.memories(spark, d, vectors=False, text=False).where(alive(views.now())).select(F.col("id").alias("memory_id"))
    rows = linked.join(f.where("embedding IS NOT NULL").join(seen, "memory_id", "left_semi").select("id", "embedding"), "id").join(q.select("query_id", "query_embedding"), "query_id")
    return retrieval.top(retrieval.similarity(rows), 10, F.desc("similarity")).select("query_id", "id", "similarity", "rank")


@query(
    "person_expansion",
    r"""WITH words AS (SELECT DISTINCT item_id AS query_id, lower(unnest(regexp_extract_all(text, '\b([A-Z][a-z]+)\b', 1))) AS name FROM benchmark),
    named AS (SELECT DISTINCT conv_id * 100 + turn AS id, lower(unnest(regexp_extract_all(text, '\b([A-Z][a-z]+)\b', 1))) AS name FROM conversations),
    hits AS (SELECT query_id, id, count(*) AS n FROM words JOIN named USING (name) GROUP BY query_id, id)
    SELECT query_id, id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id) AS rank FROM hits) WHERE rank <= 10""",
)
def person_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Facts that name a capitalised word of the query, ten for each."""
    from ..functions import text

    def names(c: str):
        return F.explode(F.array_distinct(F.transform(text.all_groups(F.col(c), r"\b([A-Z][a-z]+)\b"), F.lower))).alias("name")

    w = views.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), names("text"))
    f = views.table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), names("text"))
    return retrieval.top(w.join(f, "name").groupBy("query_id", "id").agg(F.count("*").alias("n")), 10, F.desc("n"))


_RELATED = "related AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS n FROM mentions a JOIN mentions b ON a.memory_id = b.memory_id AND a.entity_id <> b.entity_id WHERE a.entity_id IN (SELECT entity_id FROM s3) GROUP BY ALL)"


@query(
    "capped_graph_expansion",
    f"""WITH {views.MENTIONS}, seeds AS (SELECT o_orderkey AS query_id, entity_id, min(entity_id) AS position FROM orders JOIN mentions ON memory_id = o_orderkey WHERE o_orderkey % 1500 = 7 GROUP BY ALL),
    s3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position, entity_id) AS k FROM seeds) WHERE k <= 3), {_RELATED},
    r2 AS (SELECT * FROM (SELECT s.query_id, s.entity_id, s.position, b, n, row_number() OVER (PARTITION BY s.query_id, s.entity_id ORDER BY n DESC, b) AS k2 FROM s3 s JOIN related ON a = s.entity_id) WHERE k2 <= 2),
    m2 AS (SELECT * FROM (SELECT r.query_id, r.position, r.n, r.b, memory_id AS id, row_number() OVER (PARTITION BY r.query_id, r.entity_id, r.b ORDER BY memory_id) AS k3 FROM r2 r JOIN mentions ON mentions.entity_id = r.b) WHERE k3 <= 2),
    one AS (SELECT query_id, id, min(struct_pack(position := position, n := -n, b := b)) AS by_ FROM m2 GROUP BY query_id, id)
    SELECT query_id, id, k AS position, 0.45::DOUBLE AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY by_, id) AS k FROM one) WHERE k <= 5""",
)
def capped_graph_expansion(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(views.mentions(spark, d), "memory_id % 1500 = 7")


@query("capped_graph_expansion_whole", ORACLES["capped_graph_expansion"].replace("o_orderkey % 1500 = 7", "o_orderkey % 50 = 0"))
def capped_graph_expansion_whole(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(views.mentions(spark, d), "memory_id % 50 = 0")


def _expanded(m: DataFrame, seeds: str) -> DataFrame:
    from ..functions import fixed

    s = m.where(seeds).select(F.col("memory_id").alias("query_id"), "entity_id", F.col("entity_id").alias("position"))
    pairs = m.join(s.select("entity_id").distinct(), "entity_id", "left_semi").select("memory_id", F.col("entity_id").alias("a")).join(m, "memory_id")
    related = pairs.where("a <> entity_id").groupBy("a", F.col("entity_id").alias("b")).agg(F.count("*").alias("n"))
    out = graph.capped_expansion(s, related, m)
    return out.withColumn("similarity", F.lit(fixed.GRAPH_SIMILARITY))


@query(
    "decode_graph_values",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'vertex' WHEN 1 THEN 'edge' WHEN 2 THEN 'json' WHEN 3 THEN 'text' END AS kind,
       CASE doc_id % 5 WHEN 0 THEN '{"id": ' || doc_id || '}' WHEN 1 THEN '{"id": ' || doc_id || '}' WHEN 2 THEN doc_id::VARCHAR WHEN 3 THEN 'plain ' || doc_id END AS json FROM documents""",
)
def decode_graph_values(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 5
    body = F.concat(F.lit('{"id": '), i, F.lit("}"))
    value = F.when(k == 0, F.concat(body, F.lit("::vertex"))).when(k == 1, F.concat(body, F.lit("::edge"))).when(k == 2, i).when(k == 3, F.concat(F.lit("plain "), i))
    return views.table(spark, d, "documents").select("doc_id", graph.decode_value(value).alias("v")).select("doc_id", "v.kind", "v.json")
