"""A climatology that grows with the archive: stored moments of every month, merged when they are read.

Each month of a grid leaves one row a cell and variable: count, mean, sum of squared departures from that mean,
least and greatest value.  They merge exactly, so statistics over any set of months come from these rows alone; the
archive is not read again when a month arrives, is published anew or is taken out.  Months are directories:
landing a month replaces its own directory and no other, so landing it twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from gridloom.operators.normalize import Stats
from gridloom.schema import CELL_KEYS, LAT, LON, TIME, assert_grid, with_cell_keys
from gridloom.session import Files
from gridloom.sources.grids import month_index

MOMENTS = T.StructType(
    [
        T.StructField("variable", T.StringType()),
        *(T.StructField(k, T.LongType()) for k in CELL_KEYS),
        *(T.StructField(c, T.DoubleType()) for c in (LAT, LON)),
        T.StructField("n", T.LongType()),
        *(T.StructField(c, T.DoubleType()) for c in ("mean", "m2", "xmin", "xmax")),
        T.StructField("part_idx", T.IntegerType()),
    ]
)


def moments(grid: DataFrame, variables: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, variable, cell, n, mean, m2, xmin, xmax): one partly combined aggregate; missing values are left out."""
    assert_grid(grid, variables, time=False)
    pairs = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("v")) for v in variables))
    values = with_cell_keys(grid).select(*by, *CELL_KEYS, LAT, LON, F.inline(pairs)).where("v IS NOT NULL AND NOT isnan(v)")
    return values.groupBy(*by, "variable", *CELL_KEYS).agg(
        F.min(LAT).alias(LAT),
        F.min(LON).alias(LON),
        F.count("*").alias("n"),
        F.avg("v").alias("mean"),
        (F.var_pop("v") * F.count("*")).alias("m2"),
        F.min("v").alias("xmin"),
        F.max("v").alias("xmax"),
    )


def merged(parts: DataFrame, by: Sequence[str] = ("variable", *CELL_KEYS)) -> DataFrame:
    """Moments of the union of what the rows of ``parts`` stand for, by any of their columns."""
    n, mean = F.col("n"), F.col("mean")
    cell = [F.min(LAT).alias(LAT), F.min(LON).alias(LON)] if set(CELL_KEYS) <= set(by) else []
    found = parts.groupBy(*by).agg(
        *cell,
        F.sum("n").alias("n"),
        F.sum(n * mean).alias("_s"),
        F.sum("m2").alias("_within"),
        F.sum(n * mean * mean).alias("_squares"),
        F.min("xmin").alias("xmin"),
        F.max("xmax").alias("xmax"),
    )
    whole = found.withColumn("mean", F.col("_s") / F.col("n"))
    between = F.greatest(F.col("_squares") - F.col("_s") * F.col("mean"), F.lit(0.0))
    return whole.withColumn("m2", F.col("_within") + between).drop("_s", "_within", "_squares")


@dataclass(frozen=True)
class ClimatologyStore:
    """Moments by month under ``path``, a folder that all executors reach."""

    spark: SparkSession
    path: str

    def land(self, grid: DataFrame, variables: Sequence[str]) -> None:
        """Take in the months of ``grid``, whole ones; months stored before are replaced, others not touched."""
        months = grid.withColumn("part_idx", month_index(TIME).cast("int"))
        rows = moments(months, variables, ["part_idx"]).select(*(F.col(f.name).cast(f.dataType) for f in MOMENTS))
        rows.hint("rebalance", "part_idx").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part_idx").parquet(self.path)

    def remove(self, months: Sequence[int]) -> None:
        """Forget months."""
        files = Files(self.spark)
        for month in months:
            files.delete(f"{self.path}/part_idx={int(month)}")

    def parts(self, months: Column | None = None) -> DataFrame:
        """Stored rows; a condition on ``part_idx`` prunes directories."""
        rows = self.spark.read.schema(MOMENTS).parquet(self.path)
        return rows if months is None else rows.where(months)

    def cells(self, variable: str, name: str, months: Column | None = None) -> DataFrame:
        """The per-cell climatology (data_name, latitude, longitude, mu, sigma)."""
        found = merged(self.parts(months).where(F.col("variable") == variable))
        return found.select(F.lit(name).alias("data_name"), LAT, LON, F.col("mean").alias("mu"), F.sqrt(F.col("m2") / F.col("n")).alias("sigma"))

    def scalars(self, variables: Sequence[str], prefix: str = "", months: Column | None = None) -> DataFrame:
        """Statistics over all cells (data_name, mu, sigma, xmin, xmax)."""
        rows = self.parts(months).where(F.col("variable").isin(*variables))
        n, mean = F.col("n"), F.col("mean")
        total = rows.groupBy("variable").agg(
            (F.sum(n * mean) / F.sum("n")).alias("mu"), F.sum("n").alias("_n"), F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax")
        )
        about = rows.join(F.broadcast(total.select("variable", "mu", "_n")), "variable")  # one row a variable
        spread = about.groupBy("variable", "_n").agg(F.sum(F.col("m2") + n * (mean - F.col("mu")) * (mean - F.col("mu"))).alias("_m2"))
        joined = total.drop("_n").join(spread, "variable")
        return joined.select(F.concat(F.lit(prefix), "variable").alias("data_name"), "mu", F.sqrt(F.col("_m2") / F.col("_n")).alias("sigma"), "xmin", "xmax")

    def into(self, stats: Stats, variable: str, name: str, months: Column | None = None) -> Stats:
        """``stats`` with the stored climatology of a variable, under ``name``."""
        return stats.with_cells(self.cells(variable, name, months), name)
