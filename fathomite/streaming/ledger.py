"""Streaming forms: resumable ingest and a ledger of what slots have seen. An extension; batch plans do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def stream_facts(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files under ``path`` as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_seen(events: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once, for as long as the watermark keeps it in state."""
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def coverage_windows(events: DataFrame, slot: str, score: str, event_time: str, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Mean and least coverage of each slot in tumbling windows of event time; later rows than ``delay`` are left out."""
    rows = events.withWatermark(event_time, delay).groupBy(F.window(event_time, width), slot)
    return rows.agg(F.count("*").alias("n"), F.avg(score).alias("mean_coverage"), F.min(score).alias("least_coverage"))


def ingest(stream: DataFrame, sink_path: str, checkpoint: str, key: str = "source_document"):
    """Write a stream of facts by batch and document. A batch that is run again replaces what it wrote itself and nothing
    else, so facts of one document may come in any number of files; ``ingested`` reads them back."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("document", F.col(key)).write.mode("overwrite").partitionBy("document").parquet(f"{sink_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, sink_path: str, key: str = "source_document", fact: str = "fact_id") -> DataFrame:
    """What ``ingest`` has written: of facts with one id in one document, the one of the last batch, for reruns of a file."""
    rows = spark.read.parquet(sink_path).drop("document")
    own = [c for c in rows.columns if c not in (key, fact, "batch")]
    return rows.groupBy(key, fact).agg(F.max_by(F.struct(*own), "batch").alias("_r")).select(key, fact, "_r.*")
