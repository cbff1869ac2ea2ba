"""Quads that arrive as files: a stream of micro-batches appended to a table, each fact once within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources.rdf import QUADS


def quad_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of quads with an arrival time `at`, as they appear in a folder."""
    return spark.readStream.schema(f"{QUADS}, at timestamp").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_once(stream: DataFrame, table: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Appends facts that weren't seen within the watermark; runs until what is there has been read.

    State is bounded by the watermark: a fact later than that is dropped by the stream, as its contract
    says, and left to the next full snapshot.
    """
    parts = [F.col("s.v"), F.col("p"), F.col("o.v"), F.coalesce("o.d", F.lit("")), F.coalesce("o.l", F.lit("")), F.col("g")]
    keyed = stream.withColumn("fact_id", F.sha2(F.concat_ws("\0", *parts), 256)).withWatermark("at", late)
    unique = keyed.dropDuplicatesWithinWatermark(["fact_id"])
    return unique.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def graph_counts(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Facts per graph and window of arrival."""
    return stream.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "g").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "g", "n")
