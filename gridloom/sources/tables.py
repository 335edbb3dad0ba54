"""Grids derived from the star-schema test tables (lineitem, part, events).

Sums are taken over whole numbers, so the values do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.schema import LAT, LON, TIME


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _coord(origin: int, step: float, index: Column) -> Column:
    return F.round(F.lit(float(origin)) + F.lit(step) * index, 2)


def _start_of(unit: str) -> Column:
    return F.date_trunc(unit, "l_shipdate").cast("timestamp_ntz")


def _lineitem_grid(spark: SparkSession, sf_dir: str, time: Column, step: float, n: int) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            time.alias(TIME),
            _coord(44, step, F.col("l_suppkey") % n).alias(LAT),
            _coord(8, step, F.col("l_partkey") % n).alias(LON),
        )
        .agg((F.lit(250.0) + F.sum("l_quantity") / F.count("*")).alias("t2m"))
    )


def _three_hourly() -> Column:
    return _start_of("quarter") + F.make_dt_interval(hours=(F.col("l_linenumber") % 8) * 3)


def grid_hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem_grid(spark, sf_dir, _three_hourly(), 0.05, 12)


def grid_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem_grid(spark, sf_dir, _three_hourly(), 0.20, 3)


def grid_lr_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarse grid with its centre cell missing in the first and third quarter."""
    centre = (F.col(LAT) == 44.2) & (F.col(LON) == 8.2) & F.month(TIME).isin(1, 7)
    return grid_lr(spark, sf_dir).withColumn("t2m", F.when(~centre, F.col("t2m")))


def _daily_noon() -> Column:
    return _start_of("day") + F.make_dt_interval(hours=F.lit(12))


def daily_hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem_grid(spark, sf_dir, _daily_noon(), 0.05, 32)


def daily_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineitem_grid(spark, sf_dir, _daily_noon(), 0.25, 7)


def _part_grid(spark: SparkSession, sf_dir: str, step: float, n: int, **values: Column) -> DataFrame:
    static_time = F.lit("2018-01-01 12:00:00").cast("timestamp_ntz")
    return (
        table(spark, sf_dir, "part")
        .groupBy(
            static_time.alias(TIME),
            _coord(44, step, F.floor(F.col("p_partkey") / n) % n).alias(LAT),
            _coord(8, step, F.col("p_partkey") % n).alias(LON),
        )
        .agg(*[v.alias(k) for k, v in values.items()])
    )


def _land() -> Column:
    return F.sum(F.when(F.col("p_size") > 25, 1.0).otherwise(0.0)) / F.count("*")


def _height() -> Column:
    return F.sum(F.col("p_size").cast("double")) / F.count("*")


def static_hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_grid(spark, sf_dir, 0.05, 12, lsm=_land(), orog=_height())


def static_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = F.lit(9.80665) * F.sum(F.col("p_size").cast("double")) / F.count("*")
    return _part_grid(spark, sf_dir, 0.20, 3, lsm=_land(), z=height)


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noon truth against the per-cell noon climatology."""
    noon = grid_hr(spark, sf_dir).where(F.hour(TIME) == 12)
    mean = noon.groupBy(LAT, LON).agg(F.avg("t2m").alias("y_pred"))
    return noon.join(mean, [LAT, LON]).select(TIME, LAT, LON, F.col("t2m").alias("y_true"), "y_pred")
