"""Jobs on a timer: a stream whose only content is time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession


def every(spark: SparkSession, minutes: float, job: Callable[[SparkSession, int], None], checkpoint: str | None = None):
    """Run the job at once and then at that interval, one run at a time; stop() the returned query to end it."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.trigger(processingTime=f"{round(minutes * 60_000)} milliseconds").foreachBatch(lambda batch, n: job(batch.sparkSession, n))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def decay_and_reflect(spark: SparkSession, decay: Callable[[SparkSession], None], reflect: Callable[[SparkSession, int], None], decay_hours: float = 24, reflect_hours: float = 12):
    """The two background jobs; reflect looks back over two of its intervals."""
    return every(spark, decay_hours * 60, lambda s, _: decay(s)), every(spark, reflect_hours * 60, lambda s, _: reflect(s, round(2 * reflect_hours)))
