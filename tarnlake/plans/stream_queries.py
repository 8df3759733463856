"""Registered queries: streams run to the end of what there is, and what their operators give in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..sources import io, views
from ..streaming import ingest
from . import sql
from .registry import ORACLES, query


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what its source holds now; each batch replaces (complete) or adds to the result."""
    folder = io.shared_folder(spark)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream. A pattern as path lets the source take a single file as well as a folder."""
    return ingest.read(spark, f"{d}/{name[:-1]}[{name[-1]}].parquet", views.table(spark, d, name).schema)


@query("stream_sliding", ORACLES["sliding_consolidation"])
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    stream = _table(spark, d, "events")
    return _drained(spark, ingest.sliding(ingest.with_watermark(stream.withColumn("ts", ingest.instant(F.col("ts"))))), "complete")


@query("stream_first_sight", "SELECT user_id AS id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def stream_first_sight(spark: SparkSession, d: str) -> DataFrame:
    stream = _table(spark, d, "events")
    seen = ingest.expiring(stream.select(F.col("user_id").alias("id"), ingest.instant(F.col("ts")).alias("ts")), "60 days")
    return _drained(spark, seen, "append").groupBy("id").agg(F.count("*").alias("n"))


@query("stream_dedup")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as a stream of one user's texts, each with the earlier one that it repeats."""
    c = _table(spark, d, "conversations")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn"))
    rows = c.select(F.col("conv_id").alias("user_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), at.alias("ts"), F.split("text", r"\s+").alias("words"))
    return _drained(spark, ingest.dedup_by_user(rows.withWatermark("ts", "1 hour"), 0.2), "append")


@query("observe_batch", ORACLES["classify_memory_type"])
def observe_batch(spark: SparkSession, d: str) -> DataFrame:
    """What the stream of observations does, over a batch."""
    t = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return ingest.observe(t).select("id", "memory_type", F.round("type_confidence", 6).alias("confidence"))


@query(
    "embed_hashed",
    f"""WITH w AS (SELECT conv_id, turn, (('0x' || substr(md5(unnest({sql.tokens('text', 2, ['']) })), 1, 15))::BIGINT % 16)::INT AS slot FROM conversations),
    c AS (SELECT conv_id, turn, slot, count(*) AS n FROM w GROUP BY ALL)
    SELECT conv_id, turn, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 6) AS value FROM c""",
)
def embed_hashed(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(models.hashed_embedding(F.col("text"), 16)).alias("slot", "value"))
    return c.where("value > 0").select("conv_id", "turn", "slot", F.round("value", 6).alias("value"))
