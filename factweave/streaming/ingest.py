"""Streams (an extension: the batch operators are the engine): facts and files that arrive continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REFS = "ref_id long, topic int, ref_subject string, ref_predicate string, ref_object string, line_no int, observed_at timestamp_ntz, ingested_at timestamp_ntz"


def refs_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Deliveries of references as they land in a folder."""
    return spark.readStream.schema(REFS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def upsert_facts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's new facts to a table partitioned by predicate; a fact that is there already is not written again.

    The anti join reads only the partitions of the batch's predicates; a batch that is run again after a failure finds its facts
    in the table and adds none.
    """
    from factweave.sources.store import facts_of_refs

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = facts_of_refs(batch)
        try:
            old = spark.read.parquet(path).select("topic", "s", "p", "o")
            new = new.join(old, ["topic", "s", "p", "o"], "left_anti")
        except Exception as e:  # noqa: BLE001 - the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").partitionBy("p").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type and window of event time; events later than the watermark are left out by the engine."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start_at"), "event_type", "n", "total")
