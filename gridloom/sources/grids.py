"""Reading and writing grid datasets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gridloom.schema import GRID, HR_STATIC, HR_STATIC_GRID, LAT, LON, LR_STATIC, LR_STATIC_GRID, TEMPERATURE, TIME, nan_to_null

# Month 0 of the indexed month files.
FIRST_MONTH = (2006, 1)


def read_months(
    spark: SparkSession, paths: Sequence[str], schema: StructType = GRID, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Concatenate decoded month files along time; NaN becomes NULL."""
    grid = spark.read.schema(schema).format(fmt).options(**options).load(list(paths))
    return nan_to_null(grid, [f.name for f in schema if f.name not in (TIME, LAT, LON)])


def read_mixed(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Concatenate files with different variables; absent ones become NULL.

    Files of one schema are one scan, so the plan grows with the kinds of files, not with their number.
    """
    kinds: dict[str, tuple[StructType, list[str]]] = {}
    for path in paths:
        schema = spark.read.format(fmt).load(path).schema
        kinds.setdefault(schema.json(), (schema, []))[1].append(path)
    parts = [spark.read.schema(schema).format(fmt).load(same) for schema, same in kinds.values()]
    return _no_nan(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def _no_nan(grid: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating variable."""
    floats = [c for c, kind in grid.dtypes if kind in ("double", "float") and c not in (LAT, LON)]
    return nan_to_null(grid, floats)


def load_lr(spark: SparkSession, months: Sequence[str], static: str) -> tuple[DataFrame, DataFrame]:
    return read_months(spark, months), read_months(spark, [static], LR_STATIC_GRID)


def load_hr(spark: SparkSession, months: Sequence[str], static: str) -> tuple[DataFrame, DataFrame]:
    return read_months(spark, months), read_months(spark, [static], HR_STATIC_GRID)


def load_inputs(
    spark: SparkSession, hr_months: Sequence[str], hr_static: str, lr_months: Sequence[str], lr_static: str
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(fine temperature, fine static, coarse temperature, coarse static)."""
    return *load_hr(spark, hr_months, hr_static), *load_lr(spark, lr_months, lr_static)


def month_index(time: str = TIME, first: tuple[int, int] = FIRST_MONTH):
    return F.year(time) * 12 + F.month(time) - (first[0] * 12 + first[1])


def store_dataset(grid: DataFrame, name: str, path: str, mode: str = "overwrite") -> str:
    """Write a named dataset, partitioned by time of day and year.

    A time-of-day filter then skips whole directories.  The rebalance hint lets AQE cut large
    partitions into files of the advisory size instead of one task per partition.
    """
    target = f"{path.rstrip('/')}/{name}"
    labelled = grid.withColumns({"hhmm": F.hour(TIME) * 100 + F.minute(TIME), "year": F.year(TIME)})
    (
        labelled.hint("rebalance", "hhmm", "year")
        .sortWithinPartitions("hhmm", "year", TIME, LAT, LON)
        .write.mode(mode)
        .partitionBy("hhmm", "year")
        .parquet(target)
    )
    return target


def load_dataset(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A stored dataset; ``hhmm`` and ``year`` stay available for pruning."""
    return _no_nan(spark.read.parquet(f"{path.rstrip('/')}/{name}"))


def store_parts(grid: DataFrame, path: str) -> str:
    """One directory per month index."""
    parts = grid.withColumn("part_idx", month_index())
    parts.hint("rebalance", "part_idx").write.mode("overwrite").partitionBy("part_idx").parquet(path)
    return path


def read_parts(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Month parts with start <= index < end; others are pruned at planning."""
    parts = _no_nan(spark.read.parquet(path))
    return parts.where(F.col("part_idx").between(start, end - 1)).drop("part_idx")


def store_bucketed(grid: DataFrame, table: str, buckets: int) -> None:
    """Managed table clustered by time: per-timestep operators read it without a shuffle."""
    grid.write.mode("overwrite").bucketBy(buckets, TIME).sortBy(TIME, LAT, LON).saveAsTable(table)


__all__ = [
    "HR_STATIC",
    "LR_STATIC",
    "TEMPERATURE",
    "load_dataset",
    "load_hr",
    "load_inputs",
    "load_lr",
    "month_index",
    "read_mixed",
    "read_months",
    "read_parts",
    "store_bucketed",
    "store_dataset",
    "store_parts",
]
