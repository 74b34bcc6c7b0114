"""Reads and hits that arrive over time, by Structured Streaming.

The index of the genome's windows is static. Every micro-batch of reads is mapped by the same plan as a table; its hits are appended with the batch's number, so a
batch that runs again after a failure replaces itself. Late and repeated hits are dealt with by event time and watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.hamming import best_hits
from ..options import Options
from ..plans import mapper


def stream_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files (or one file) as a stream, with the schema of what is there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # a pattern stands for one file as well as for a folder
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path.rstrip("/") + "*")


def map_stream(reads: DataFrame, genome: DataFrame, path: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Map each micro-batch of reads (as for ``mapper.mapped``; repeated rows count once) and write its hits to ``path``/batch=n; stops when all that is there is read."""

    def step(batch: DataFrame, number: int) -> None:
        mapper.mapped(batch.distinct(), genome, options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_hits(spark: SparkSession, path: str) -> DataFrame:
    """The best hit of each read over all batches so far."""
    return best_hits(spark.read.parquet(path).drop("batch"))


def distinct_hits(hits: DataFrame, delay: str = "5 days") -> DataFrame:
    """Hits (read_id, mapped_at and others) without those that come again, remembered for as long as the delay."""
    return hits.withWatermark("mapped_at", delay).dropDuplicatesWithinWatermark(["read_id", "mapped_at"])


def hits_per_window(hits: DataFrame, width: str = "1 hour", delay: str | None = "5 days") -> DataFrame:
    """``start, mapped, unmapped`` of each stretch of event time; hits later than the delay are left out (None: nothing is, and no state is dropped)."""
    timed = hits.withWatermark("mapped_at", delay) if delay else hits
    good = F.coalesce(F.col("orientation").isin(1, 2), F.lit(False))
    return timed.groupBy(F.window("mapped_at", width).alias("w")).agg(F.count_if(good).alias("mapped"), F.count_if(~good).alias("unmapped")).select(F.col("w.start").alias("start"), "mapped", "unmapped")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there into a table in memory, for small results such as counts."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there into Parquet files."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
