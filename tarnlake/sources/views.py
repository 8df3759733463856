"""Memory, fact, query, graph and log tables derived from the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which queries are asked.
NOW = "2024-02-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minutes(n: Column) -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=n.cast("int"))


def memories(spark: SparkSession, sf_dir: str, vectors: bool = True, text: bool = True) -> DataFrame:
    """Documents as memories; those with a vector of their number carry it."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    created = _minutes(i)
    out = d.select(
        i.alias("id"), (i % 5).alias("agent_id"), (i % 20).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("semantic", "episodic", "procedural"))), (i % 3 + 1).cast("int")).alias("memory_type"),
        *([F.col("text").alias("content")] if text else []),
        (i % 3 == 0).alias("shared"), F.when(i % 2 == 0, i % 7).alias("task_id"),
        ((i % 10) / F.lit(10.0)).alias("importance"), (i % 13).alias("access_count"), created.alias("created_at"),
        F.when(i % 11 == 0, created + F.expr("INTERVAL 1 DAY")).alias("expires_at"),
        F.when(i % 17 == 0, F.when(i % 2 == 0, now() + F.expr("INTERVAL 1 DAY")).otherwise(now() - F.expr("INTERVAL 1 DAY"))).alias("invalid_at"),
    )
    if vectors:
        e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
        out = out.join(e, "id", "left")
    return out


MEMORIES = """memories AS (
    SELECT doc_id AS id, doc_id % 5 AS agent_id, doc_id % 20 AS user_id, ['semantic', 'episodic', 'procedural'][doc_id % 3 + 1] AS memory_type,
           text AS content, doc_id % 3 = 0 AS shared, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 END AS task_id, (doc_id % 10) / 10.0::DOUBLE AS importance,
           doc_id % 13 AS access_count, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at,
           CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) + INTERVAL 1 DAY END AS expires_at,
           CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' + (CASE WHEN doc_id % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL (-1) DAY END) END AS invalid_at,
           embedding::DOUBLE[] AS embedding
    FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as facts of the memory with the conversation's number; every 7th has been superseded."""
    c = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("memory_id"), "turn", F.col("text").alias("fact"),
        ((F.col("conv_id") * 8 + F.col("turn")) % 500).alias("vec_id"), ((F.col("turn") % 10) / F.lit(10.0)).alias("importance"),
        _minutes(F.col("conv_id") * 60 + F.col("turn")).alias("created_at"),
        F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, now()).alias("active_until"),
    )
    return c.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "left")


FACTS = """facts AS (
    SELECT conv_id * 100 + turn AS id, conv_id AS memory_id, turn, c.text AS fact, (conv_id * 8 + turn) % 500 AS vec_id, (turn % 10) / 10.0::DOUBLE AS importance,
           TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 60 + turn) AS created_at,
           CASE WHEN (conv_id + turn) % 7 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS active_until, embedding::DOUBLE[] AS embedding
    FROM conversations c LEFT JOIN embeddings e ON e.vec_id = (conv_id * 8 + turn) % 500)"""


_whole: ContextVar[bool] = ContextVar("whole", default=False)


@contextmanager
def whole() -> Iterator[None]:
    """Plans made within take every row whose id is divisible by 50 as their query set, with its whole text."""
    token = _whole.set(True)
    try:
        yield
    finally:
        _whole.reset(token)


def is_whole() -> bool:
    return _whole.get()


def asked(key: str, n: int) -> Column:
    """What belongs to the query set: ids below n, or all that 50 divides."""
    return F.col(key) % 50 == 0 if _whole.get() else F.col(key) < n


def query_batch(spark: SparkSession, sf_dir: str, n: int = 20, asker: bool = False) -> DataFrame:
    """A stated set of questions: the first n vectors, each with a benchmark text; with asker a user and an agent."""
    e = table(spark, sf_dir, "embeddings").where(asked("vec_id", n)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    i = F.col("query_id")
    q = e.join(b, "query_id", "left")
    return q.withColumns({"query_user": i % 20, "query_agent": i % 5}) if asker else q


def queries_sql(n: int = 20) -> str:
    return f"""queries AS (
    SELECT vec_id AS query_id, embedding::DOUBLE[] AS query_embedding, b.text AS query, vec_id % 20 AS query_user, vec_id % 5 AS query_agent
    FROM embeddings LEFT JOIN benchmark b ON b.item_id = vec_id WHERE vec_id < {n})"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders mention parts: memory_id, entity_id, each pair once."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_id")).distinct()


MENTIONS = "mentions AS (SELECT DISTINCT l_orderkey AS memory_id, l_partkey AS entity_id FROM lineitem)"


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user as memories with a history: id, created_at, last_accessed, access_count, importance."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("id")).agg(
        F.min("ts").alias("created_at"), F.max(F.when(F.col("event_id") % 3 != 0, F.col("ts"))).alias("last_accessed"), F.count("*").alias("access_count")
    ).withColumns({"importance": ((F.col("id") % 10) / F.lit(10.0)), "expires_at": F.when(F.col("id") % 11 == 0, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))})


ACCESS_LOG = """access_log AS (
    SELECT user_id AS id, min(ts) AS created_at, max(ts) FILTER (WHERE event_id % 3 <> 0) AS last_accessed, count(*) AS access_count,
           (user_id % 10) / 10.0::DOUBLE AS importance, CASE WHEN user_id % 11 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS expires_at
    FROM events GROUP BY user_id)"""
