"""Continuous ingestion: new chunks once, late repeats dropped, tables replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(stream: DataFrame, key: str = "chunk_id", time: str = "ingested_at", delay: str = "7 days") -> DataFrame:
    """A stream without repeats of a key within the delay; state older than that is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def arrivals(stream: DataFrame, time: str = "ingested_at", window: str = "1 day", delay: str = "2 days", by: str = "source_type") -> DataFrame:
    """Rows per time window and source, final once the watermark has passed."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"), F.approx_count_distinct("document_id").alias("documents"))


def append_new(spark: SparkSession, source: str, target: str, checkpoint: str, key: str = "chunk_id") -> StreamingQuery:
    """Read Parquet files as they arrive below ``source`` and append rows with unseen keys to ``target``, once available, then stop.

    A batch that is run again after a failure finds its keys present and appends nothing twice.
    """
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(source)

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(target + "/_SUCCESS")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = rows.join(spark.read.schema(schema).parquet(target).select(key), key, "left_anti")
        rows.select(*schema.names).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
