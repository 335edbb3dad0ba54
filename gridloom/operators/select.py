"""Filters, crops and projections over grid tables."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridloom.functions import hhmm, minute_of_day
from gridloom.operators.axes import GridAxes, time_axis
from gridloom.schema import HALF_KEY, LAT, LON, TEMPERATURE, TEMPERATURE_ATTRS, TIME, Region, assert_grid
from gridloom.session import broadcast_if_small


def at_times(
    grid: DataFrame, specific_times: Sequence[str] = ("12:00",), variables: Sequence[str] = (TEMPERATURE,)
) -> DataFrame:
    """Timesteps at the given 'HH:MM' times of day, keeping only the temperature.

    Tables written by the dataset sink are partitioned by ``hhmm``; there the filter prunes
    whole directories.  Other tables are filtered on the minute of the day.
    """
    assert_grid(grid, variables)
    if dict(grid.dtypes).get("hhmm") in ("int", "bigint", "smallint"):
        wanted = F.col("hhmm").isin(*[int(t.replace(":", "")) for t in specific_times])
    else:
        minutes = [int(t[:2]) * 60 + int(t[3:]) for t in specific_times]
        wanted = minute_of_day(TIME).isin(*minutes)
    kept = grid.where(wanted)
    return kept.select(TIME, LAT, LON, *[with_attrs(kept, v) for v in variables])


def with_attrs(grid: DataFrame, variable: str, attrs: dict[str, str] | None = None):
    """Column carrying its units and long name as metadata."""
    attrs = attrs or (TEMPERATURE_ATTRS if variable == TEMPERATURE else {})
    return F.col(variable).alias(variable, metadata=attrs) if attrs else F.col(variable)


def time_labels(grid: DataFrame) -> DataFrame:
    return grid.withColumn("hhmm", hhmm(TIME))


def crop_to_region(grid: DataFrame, region: Region | Sequence[float] | None) -> DataFrame:
    """Inclusive bounding box on literals, so the comparison reaches the parquet scan."""
    box = Region.of(region)
    if box is None:
        return grid
    lon = F.col(LON).between(box.lon_min - HALF_KEY, box.lon_max + HALF_KEY)
    return grid.where(lon & F.col(LAT).between(box.lat_min - HALF_KEY, box.lat_max + HALF_KEY))


def crop_to_axes(grid: DataFrame, axes: GridAxes) -> DataFrame:
    """Rows inside the extent of ``axes``."""
    return grid.where(axes.inside())


def cropped_axes(
    grid: DataFrame, region: Region | Sequence[float] | None = None, divisible_factor: int = 32
) -> GridAxes:
    """Axes left after the region crop and the symmetric crop to a divisible size.

    One pass over the coordinates of the region; a crop that leaves nothing warns.
    """
    found = GridAxes.of(crop_to_region(grid, region), staged=False)
    return found.divisible(divisible_factor).stage().warn_if_empty()


def crop_spatial(
    grid: DataFrame, region: Region | Sequence[float] | None = None, divisible_factor: int = 32
) -> DataFrame:
    axes = cropped_axes(grid, region, divisible_factor)
    return crop_to_axes(crop_to_region(grid, region), axes)


def crop_to_extent(grids: Sequence[DataFrame], of: DataFrame) -> list[DataFrame]:
    """Crop coarse grids to the extent of a fine one."""
    axes = GridAxes.of(of)
    return [crop_to_axes(g, axes) for g in grids]


def first_time(grid: DataFrame) -> DataFrame:
    """The earliest timestep."""
    earliest = grid.agg(F.min(TIME).alias("t")).scalar()
    return grid.where(F.col(TIME) == earliest)


def take_times(grid: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Timesteps by position on the chronological time axis."""
    axis = time_axis(grid)
    picked = axis.where(F.col("time_idx").isin(*positions)).select(TIME)
    return select_times(grid, picked, rows=len(positions))


def select_times(grid: DataFrame, times: DataFrame, rows: int | None = None) -> DataFrame:
    """Timesteps by label: a semi-join against the wanted times."""
    rows = times.count() if rows is None else rows
    return grid.join(broadcast_if_small(times.select(TIME), rows), TIME, "left_semi")


def pick_variables(grid: DataFrame, variables: Sequence[str]) -> DataFrame:
    return assert_grid(grid, variables).select(TIME, LAT, LON, *variables)


def replace_variables(grid: DataFrame, **columns) -> DataFrame:
    return grid.withColumns(columns)


def flat_values(grid: DataFrame, variable: str) -> DataFrame:
    return grid.select(variable)


def sort_axes(grid: DataFrame, north_up: bool = False) -> DataFrame:
    """Ordered output; only useful right before rows leave Spark."""
    lat = F.desc(LAT) if north_up else F.asc(LAT)
    return grid.orderBy(TIME, lat, LON) if TIME in grid.columns else grid.orderBy(lat, LON)


def concat_times(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Append along time, keeping duplicates; missing variables become NULL."""
    for other in others:
        if set(other.columns) != set(first.columns):
            warnings.warn("concatenating grids with different variables", stacklevel=2)
        first = first.unionByName(other, allowMissingColumns=True)
    return first
