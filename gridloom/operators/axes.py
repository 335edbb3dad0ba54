"""Axis tables: the few distinct coordinates of a grid, kept apart from its many cells.

Positions are only ever computed here, on distinct coordinates, never on the cell table.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.schema import HALF_KEY, LAT, LON, TIME, coord_key
from gridloom.session import broadcast_if_small, stage

# Rank buckets for a shuffled order: enough to spread the work, few enough to total in one task.
HASH_BUCKETS = 4096


@dataclass(frozen=True)
class GridAxes:
    """Latitude and longitude axes as one small table (dim, idx, coord_key, coord)."""

    table: DataFrame
    _values: dict[str, Column] = field(default_factory=dict, compare=False, repr=False)
    _summary: dict[str, tuple] = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def of(cls, grid: DataFrame, staged: bool = True) -> GridAxes:
        """One pass over the two coordinate columns; partial aggregation keeps the shuffle tiny.

        ``staged`` writes the result to the scratch folder, so that later steps do not rescan
        the grid.
        """
        coords = grid.select(
            F.inline(
                F.array(
                    F.struct(F.lit(LAT).alias("dim"), coord_key(LAT).alias("coord_key"), F.col(LAT).alias("coord")),
                    F.struct(F.lit(LON).alias("dim"), coord_key(LON).alias("coord_key"), F.col(LON).alias("coord")),
                )
            )
        )
        points = coords.groupBy("dim", "coord_key").agg(F.min("coord").alias("coord"))
        axes = cls(_numbered(points))
        return axes.stage() if staged else axes

    def stage(self) -> GridAxes:
        return GridAxes(stage(self.table, "axes"))

    def axis(self, dim: str) -> DataFrame:
        """(coord_key, idx, <dim>) of one dimension."""
        return self.table.where(F.col("dim") == dim).select(
            "coord_key", "idx", F.col("coord").alias(dim)
        )

    def positions(self, dim: str) -> DataFrame:
        """Key -> position table, broadcast if its counted length allows."""
        return broadcast_if_small(self.table.where(F.col("dim") == dim).select("coord_key", "idx"), self.size(dim))

    def values(self, dim: str) -> Column:
        """All coordinates of a dimension as one ascending array (scalar subquery)."""
        if dim not in self._values:
            ordered = "transform(sort_array(collect_list(struct(idx, coord))), p -> p.coord)"
            one = self.table.where(F.col("dim") == dim).agg(F.expr(ordered).alias("v"))
            self._values[dim] = one.scalar()
        return self._values[dim]

    def summary(self) -> dict[str, tuple[int, float | None, float | None]]:
        """Length, smallest and largest coordinate per dimension: two rows, read once."""
        if not self._summary:
            found = self.table.groupBy("dim").agg(
                F.count("*").alias("n"), F.min("coord").alias("lo"), F.max("coord").alias("hi")
            )
            self._summary.update({LAT: (0, None, None), LON: (0, None, None)})
            self._summary.update({r.dim: (r.n, r.lo, r.hi) for r in found.toLocalIterator()})
        return self._summary

    def size(self, dim: str) -> int:
        return self.summary()[dim][0]

    def inside(self) -> Column:
        """Predicate for rows within the extent: literals, so it reaches the scan.

        The bounds are half a coordinate key wider, for coordinates stored in another precision.
        """
        keep = F.lit(True)
        for dim, (n, lo, hi) in self.summary().items():
            keep = keep & (F.col(dim).between(lo - HALF_KEY, hi + HALF_KEY) if n else F.lit(False))
        return keep

    def within(self, lon_min: float, lat_min: float, lon_max: float, lat_max: float) -> GridAxes:
        keep = F.when(F.col("dim") == LAT, F.col("coord").between(lat_min - HALF_KEY, lat_max + HALF_KEY)).otherwise(
            F.col("coord").between(lon_min - HALF_KEY, lon_max + HALF_KEY)
        )
        return GridAxes(_numbered(self.table.where(keep)))

    def divisible(self, factor: int) -> GridAxes:
        """Symmetric trim of both axes to a multiple of ``factor``."""
        n = F.count("*").over(Window.partitionBy("dim"))
        sized = self.table.withColumn("_n", n).withColumn("_m", F.floor(F.col("_n") / factor) * factor)
        start = F.floor((F.col("_n") - F.col("_m")) / 2)
        kept = sized.where((F.col("idx") >= start) & (F.col("idx") < start + F.col("_m")))
        return GridAxes(_numbered(kept.drop("_n", "_m")))

    def union(self, other: GridAxes) -> GridAxes:
        both = self.table.unionByName(other.table)
        return GridAxes(_numbered(both.groupBy("dim", "coord_key").agg(F.min("coord").alias("coord"))))

    def warn_if_empty(self) -> GridAxes:
        if not all(n for n, _, _ in self.summary().values()):
            warnings.warn("an axis is shorter than the crop factor: the crop is empty", stacklevel=2)
        return self


def _numbered(points: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("dim").orderBy("coord_key"))
    return points.select("dim", (rank - 1).cast("int").alias("idx"), "coord_key", "coord")


def axis_positions(grid: DataFrame, axes: GridAxes | None = None) -> DataFrame:
    """Add lat_idx / lon_idx, the ascending positions on the axes."""
    axes = axes or GridAxes.of(grid)
    for dim, name in ((LAT, "lat_idx"), (LON, "lon_idx")):
        pos = axes.positions(dim).withColumnsRenamed({"coord_key": "_key", "idx": name})
        grid = grid.withColumn("_k", coord_key(dim)).join(pos, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")
    return grid


def dense_index(
    keys: DataFrame, order: Column, bucket: Column, name: str, within: Sequence[str] = ()
) -> DataFrame:
    """0-based rank of distinct rows (per ``within`` group) without sorting them in one task.

    ``bucket`` must rise with ``order``.  Ranks are taken inside buckets and shifted by the
    number of rows in the buckets before; only the bucket totals meet in one place.
    """
    rows = keys.withColumns({"_bucket": bucket, "_order": order})
    totals = rows.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *within, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    local = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy("_order"))
    return (
        rows.withColumn("_local", local)
        .join(offsets, [*within, "_bucket"])
        .withColumn(name, F.col("_local") - 1 + F.col("_offset"))
        .drop("_bucket", "_order", "_local", "_offset")
    )


def time_axis(grid: DataFrame, staged: bool = True) -> DataFrame:
    """(time, time_idx): distinct timesteps in chronological order."""
    times = grid.select(TIME).distinct()
    if staged:
        times = stage(times, "times")
    month = F.year(TIME) * 12 + F.month(TIME)
    return dense_index(times, F.col(TIME), month, "time_idx")


def bounding_box(grid: DataFrame) -> DataFrame:
    return grid.agg(
        F.min(LON).alias("lon_min"),
        F.min(LAT).alias("lat_min"),
        F.max(LON).alias("lon_max"),
        F.max(LAT).alias("lat_max"),
    )


def input_shape(grid: DataFrame, variables: list[str]) -> DataFrame:
    """(n_lat, n_lon, n_vars) as one row."""
    axes = GridAxes.of(grid, staged=False).table
    per_dim = {d: F.count(F.when(F.col("dim") == d, 1)).cast("bigint") for d in (LAT, LON)}
    return axes.agg(
        per_dim[LAT].alias("n_lat"),
        per_dim[LON].alias("n_lon"),
        F.lit(len(variables)).cast("bigint").alias("n_vars"),
    )


def dataset_size(grid: DataFrame, variables: list[str], bytes_per_value: int = 8) -> DataFrame:
    """Stored values and their size per variable, in one pass."""
    counts = grid.agg(F.count("*").alias("n_rows"), *[F.count(v).alias(v) for v in variables])
    per_var = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("n_values")) for v in variables])
    return counts.select("n_rows", F.inline(per_var)).withColumn(
        "size_gib", F.col("n_rows") * bytes_per_value / F.lit(float(1024**3))
    )


def value_peek(grid: DataFrame, variables: list[str]) -> DataFrame:
    """Largest and smallest value of each variable."""
    extremes = grid.agg(*[f(v).alias(f"{n}_{v}") for v in variables for n, f in (("max", F.max), ("min", F.min))])
    rows = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.col(f"max_{v}").alias("max_value"), F.col(f"min_{v}").alias("min_value"))
            for v in variables
        ]
    )
    return extremes.select(F.inline(rows))
