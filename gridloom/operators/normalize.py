"""Climatology fits and the two normalisations, with statistics kept as small tables."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.functions import anomaly, inverse_anomaly, inverse_min_max, min_max
from gridloom.operators.align import join_cells, keyed, require_hit
from gridloom.schema import LAT, LON, STATS_CELL, STATS_GLOBAL, TEMPERATURE, assert_grid, with_cell_keys
from gridloom.session import stage


def cell_climatology(grid: DataFrame, variable: str, data_name: str) -> DataFrame:
    """Mean and population standard deviation over time, per cell; one combined aggregate."""
    return (
        with_cell_keys(grid)
        .groupBy("lat_key", "lon_key")
        .agg(
            F.min(LAT).alias(LAT),
            F.min(LON).alias(LON),
            F.avg(variable).alias("mu"),
            F.stddev_pop(variable).alias("sigma"),
        )
        .select(F.lit(data_name).alias("data_name"), LAT, LON, "mu", "sigma")
    )


def global_stats(grid: DataFrame, variables: Sequence[str], prefix: str) -> DataFrame:
    """Mean, deviation, minimum and maximum over all cells and times, all variables in one pass."""
    fns = {"mu": F.avg, "sigma": F.stddev_pop, "xmin": F.min, "xmax": F.max}
    one = grid.agg(*[f(v).alias(f"{v}_{s}") for v in variables for s, f in fns.items()])
    rows = [
        F.struct(
            F.lit(prefix + v).alias("data_name"),
            *[F.col(f"{v}_{s}").cast("double").alias(s) for s in fns],
        )
        for v in variables
    ]
    return one.select(F.inline(F.array(*rows)))


@dataclass(frozen=True)
class Stats:
    """Fitted statistics: a per-cell table and a table of scalars, by ``data_name``.

    Immutable: fitting returns a new object, resetting means starting from ``Stats.empty``.
    """

    cells: DataFrame
    scalars: DataFrame
    names: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def empty(cls, spark: SparkSession) -> Stats:
        return cls(spark.createDataFrame([], STATS_CELL), spark.createDataFrame([], STATS_GLOBAL))

    def reset(self) -> Stats:
        return Stats.empty(self.cells.sparkSession)

    def with_cells(self, table: DataFrame, name: str) -> Stats:
        kept = self.cells.where(F.col("data_name") != name)
        return replace(self, cells=kept.unionByName(stage(table, "climatology")), names=self.names | {name})

    def with_scalars(self, table: DataFrame, names: Sequence[str]) -> Stats:
        kept = self.scalars.where(~F.col("data_name").isin(*names))
        return replace(self, scalars=kept.unionByName(stage(table, "scalars")), names=self.names | set(names))

    def require(self, name: str) -> None:
        if name not in self.names:
            raise ValueError(f"no fitted statistics for {name!r}; fit on the training split first")

    def cell(self, name: str) -> tuple[DataFrame, int]:
        """Join-ready per-cell statistics and their row count."""
        self.require(name)
        side = keyed(self.cells.where(F.col("data_name") == name), F.col("mu").alias("_mu"), F.col("sigma").alias("_sigma"))
        return side, side.count()

    def scalar(self, name: str) -> Column:
        """Struct of mu, sigma, xmin and xmax (scalar subquery on the small table)."""
        self.require(name)
        row = F.struct(*[F.max(c).alias(c) for c in ("mu", "sigma", "xmin", "xmax")])
        return self.scalars.where(F.col("data_name") == name).agg(row.alias("row")).scalar()

    def save(self, path: str) -> None:
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")
        self.scalars.write.mode("overwrite").parquet(f"{path}/scalars")

    @classmethod
    def load(cls, spark: SparkSession, path: str, current: Stats | None = None) -> Stats:
        """Read saved statistics; a missing path warns and leaves ``current`` as it is."""
        try:
            cells = spark.read.schema(STATS_CELL).parquet(f"{path}/cells")
            scalars = spark.read.schema(STATS_GLOBAL).parquet(f"{path}/scalars")
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            warnings.warn(f"no statistics at {path!r}; nothing loaded", stacklevel=2)
            return current or cls.empty(spark)
        # A handful of data names, whatever the size of the grid.
        found = cells.select("data_name").union(scalars.select("data_name")).distinct()
        return cls(cells, scalars, frozenset(r.data_name for r in found.toLocalIterator()))


class AnomalyScaler:
    """Standardised anomalies: per cell for the temperature, global for static features."""

    kind = "standardized_anomalies"

    def fit_temperature(self, stats: Stats, lr: DataFrame, hr: DataFrame) -> Stats:
        for name, grid in (("lr_t2m", lr), ("hr_t2m", hr)):
            stats = stats.with_cells(cell_climatology(assert_grid(grid, [TEMPERATURE]), TEMPERATURE, name), name)
        return stats

    def fit_features(self, stats: Stats, data: DataFrame, variables: Sequence[str], prefix: str = "lr_") -> Stats:
        return stats.with_scalars(global_stats(data, variables, prefix), [prefix + v for v in variables])

    def apply_temperature(self, stats: Stats, grid: DataFrame, resolution: str) -> DataFrame:
        return self._per_cell(stats, grid, f"{resolution}_{TEMPERATURE}", anomaly)

    def apply_features(self, stats: Stats, data: DataFrame, variables: Sequence[str], prefix: str = "lr_") -> DataFrame:
        fitted = {v: stats.scalar(prefix + v) for v in variables}
        return data.withColumns({v: anomaly(v, s["mu"], s["sigma"]) for v, s in fitted.items()})

    def inverse(
        self, stats: Stats, grid: DataFrame, variable: str, resolution: str, strict: bool = False
    ) -> DataFrame:
        """Physical units; a cell without statistics stays, as NULL, or raises if ``strict``."""
        name = f"{resolution}_{variable}"
        if variable == TEMPERATURE:
            return self._per_cell(stats, grid, name, inverse_anomaly, "left", strict)
        fitted = stats.scalar(name)
        return grid.withColumn(variable, inverse_anomaly(variable, fitted["mu"], fitted["sigma"]))

    @staticmethod
    def _per_cell(stats: Stats, grid: DataFrame, name: str, fn, how: str = "inner", strict: bool = False) -> DataFrame:
        side, rows = stats.cell(name)
        joined = join_cells(grid, side.withColumn("_hit", F.lit(True)), rows, how)
        joined = joined.withColumn(TEMPERATURE, fn(TEMPERATURE, F.col("_mu"), F.col("_sigma"))).drop("_mu", "_sigma")
        return require_hit(joined, TEMPERATURE, strict, "statistics")


class MinMaxScaler:
    """Scaling to [0, 1] with one minimum and maximum per variable."""

    kind = "min_max"

    def fit_temperature(self, stats: Stats, lr: DataFrame, hr: DataFrame) -> Stats:
        for prefix, grid in (("lr_", lr), ("hr_", hr)):
            stats = self.fit_features(stats, assert_grid(grid, [TEMPERATURE]), [TEMPERATURE], prefix)
        return stats

    def fit_features(self, stats: Stats, data: DataFrame, variables: Sequence[str], prefix: str = "lr_") -> Stats:
        return stats.with_scalars(global_stats(data, variables, prefix), [prefix + v for v in variables])

    def apply_temperature(self, stats: Stats, grid: DataFrame, resolution: str) -> DataFrame:
        return self.apply_features(stats, grid, [TEMPERATURE], f"{resolution}_")

    def apply_features(self, stats: Stats, data: DataFrame, variables: Sequence[str], prefix: str = "lr_") -> DataFrame:
        fitted = {v: stats.scalar(prefix + v) for v in variables}
        return data.withColumns({v: min_max(v, s["xmin"], s["xmax"]) for v, s in fitted.items()})

    def inverse(
        self, stats: Stats, grid: DataFrame, variable: str, resolution: str, strict: bool = False
    ) -> DataFrame:
        """Physical units; the scalars cover every cell, so ``strict`` never raises.

        The orography shares the statistics of the coarse geopotential field.
        """
        name = f"{resolution}_{'z' if variable == 'orog' else variable}"
        fitted = stats.scalar(name)
        return grid.withColumn(variable, inverse_min_max(variable, fitted["xmin"], fitted["xmax"]))


SCALERS = {s.kind: s for s in (AnomalyScaler, MinMaxScaler)}


def scaler(kind: str = AnomalyScaler.kind) -> AnomalyScaler | MinMaxScaler:
    if kind not in SCALERS:
        raise ValueError(f"unknown normalisation {kind!r}; use one of {sorted(SCALERS)}")
    return SCALERS[kind]()


def normalize_temperature(
    kind: str, stats: Stats, lr: DataFrame, hr: DataFrame, fit: bool = True
) -> tuple[DataFrame, DataFrame, Stats]:
    """Normalised coarse and fine temperature with the statistics used."""
    s = scaler(kind)
    if fit:
        stats = s.fit_temperature(stats, lr, hr)
    return s.apply_temperature(stats, lr, "lr"), s.apply_temperature(stats, hr, "hr"), stats


def normalize_features(
    kind: str, stats: Stats, data: DataFrame, variables: Sequence[str], prefix: str = "lr_", fit: bool = True
) -> tuple[DataFrame, Stats]:
    s = scaler(kind)
    if fit:
        stats = s.fit_features(stats, data, variables, prefix)
    return s.apply_features(stats, data, variables, prefix), stats


def denormalize_dataset(
    kind: str, grid: DataFrame, resolution: str, stats_path: str, current: Stats | None = None
) -> DataFrame:
    """Load saved statistics and restore the temperature in physical units."""
    stats = Stats.load(grid.sparkSession, stats_path, current)
    return scaler(kind).inverse(stats, grid, TEMPERATURE, resolution)
