"""Incremental landing of new month files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gridloom.operators.moments import ClimatologyStore
from gridloom.schema import GRID, LAT, LON, TIME, nan_to_null
from gridloom.session import broadcast_if_small, stage
from gridloom.sources.grids import month_index


def land_months(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType = GRID, files_per_batch: int = 64
) -> None:
    """Land every file that has arrived since the last run, into one directory per month index.

    The checkpoint remembers finished files; a run that is cut short resumes where it stopped
    and lands each file exactly once.
    """
    variables = [f.name for f in schema if f.name not in (TIME, LAT, LON)]
    arrived = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .parquet(source)
    )
    query = (
        nan_to_null(arrived, variables)
        .withColumn("part_idx", month_index())
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .partitionBy("part_idx")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def newest_files(batch: DataFrame) -> DataFrame:
    """The rows of each month that come from the newest of its files; (file, modified) name a row's file."""
    order = F.struct(F.col("modified"), F.col("file"))
    last = batch.groupBy("part_idx").agg(F.max(order).alias("_last"))
    kept = batch.join(broadcast_if_small(last, last.count()), "part_idx").where(order == F.col("_last"))
    return kept.drop("_last", "file", "modified")


def land_latest_months(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: StructType = GRID,
    files_per_batch: int = 64,
    climatology: ClimatologyStore | None = None,
) -> None:
    """Land month files of which a later one replaces an earlier one: a month has the rows of its newest file.

    A file holds whole months; a month published again comes under a new name.  Files are taken oldest first, of
    those that arrive together the newest (by time of change, then by name) counts, and a landed month replaces its
    directory.  So a batch that runs twice after a failure leaves the same rows, and no month is ever there twice.
    ``climatology`` takes in the same months.
    """
    variables = [f.name for f in schema if f.name not in (TIME, LAT, LON)]

    def land(batch: DataFrame, _: int) -> None:
        rows = nan_to_null(newest_files(batch), variables)
        held = stage(rows, "landing") if climatology is not None else rows
        (
            held.hint("rebalance", "part_idx")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("part_idx")
            .parquet(target)
        )
        if climatology is not None:
            climatology.land(held.drop("part_idx"), variables)

    arrived = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .parquet(source)
        .select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
        .withColumn("part_idx", month_index())
    )
    query = arrived.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
