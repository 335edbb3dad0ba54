"""Joins between grids; always on integer cell keys, never on row position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridloom.operators.select import first_time
from gridloom.schema import CELL_KEYS, LAT, LON, TEMPERATURE, TIME, assert_grid, with_cell_keys
from gridloom.session import broadcast_if_small


def keyed(grid: DataFrame, *columns: str) -> DataFrame:
    return with_cell_keys(grid).select(*CELL_KEYS, *columns)


def join_cells(grid: DataFrame, side: DataFrame, rows: int, how: str) -> DataFrame:
    """Join a per-cell table (cell keys + values) of ``rows`` counted rows to a grid."""
    joined = with_cell_keys(grid).join(broadcast_if_small(side, rows), CELL_KEYS, how)
    return joined.drop(*CELL_KEYS)


def require_hit(joined: DataFrame, variable: str, strict: bool, side: str) -> DataFrame:
    """Drop the mark ``_hit`` of a left join; with ``strict``, ``variable`` raises where the mark is missing."""
    if strict:
        missing = F.raise_error(F.lit(f"{side} do not cover every cell of the grid"))
        joined = joined.withColumn(variable, F.when(F.col("_hit").isNull(), missing).otherwise(F.col(variable)))
    return joined.drop("_hit")


def combine_static(
    grid: DataFrame, static: DataFrame, variables: Sequence[str], strict: bool = False
) -> DataFrame:
    """Repeat the first timestep of static fields at every timestep of the grid.

    The per-cell table is counted first, so that it is broadcast only while it is small.
    ``strict`` raises where a grid cell has no static value.
    """
    assert_grid(static, variables)
    cells = keyed(first_time(static), *variables, F.lit(True).alias("_hit"))
    joined = join_cells(grid, cells, cells.count(), "left")
    return require_hit(joined, variables[0], strict, "static fields")


def _paired(left: DataFrame, right: DataFrame, keys: Sequence[str], strict: bool) -> DataFrame:
    """Inner join on ``keys``; ``strict`` counts what has no partner and raises if there is any."""
    if strict:
        lost = _only_in_one(left, right, keys).groupBy("only_in").agg(F.count("*").alias("n")).collect()
        if lost:
            counts = ", ".join(f"{r.n} cells only {r.only_in}" for r in sorted(lost, key=lambda r: r.only_in))
            raise ValueError(f"the grids do not match: {counts}")
    return left.join(right, list(keys))


def _only_in_one(
    left: DataFrame, right: DataFrame, keys: Sequence[str], names: tuple[str, str] = ("left", "right"), keep: Sequence[str] = ()
) -> DataFrame:
    """Keys of one side only, in one combined aggregate."""
    sides = [d.select(*keys, *keep, F.lit(n).alias("only_in")) for d, n in zip((left, right), names, strict=True)]
    marks = sides[0].unionByName(sides[1]).groupBy(*keys)
    both = marks.agg(F.min("only_in").alias("only_in"), F.max("only_in").alias("_last"), *(F.min(c).alias(c) for c in keep))
    return both.where(F.col("only_in") == F.col("_last")).drop("_last")


def pair_samples(
    truth: DataFrame,
    prediction: DataFrame,
    variable: str = TEMPERATURE,
    on: Sequence[str] = (TIME,),
    names: tuple[str, str] = ("y_true", "y_pred"),
    strict: bool = False,
) -> DataFrame:
    """Match truth and prediction on (time, latitude, longitude) and any further label.

    Cells without a partner are left out (``unpaired_cells`` lists them); ``strict`` raises with their numbers.
    """
    left = with_cell_keys(truth).select(*on, *CELL_KEYS, LAT, LON, F.col(variable).alias(names[0]))
    right = with_cell_keys(prediction).select(*on, *CELL_KEYS, F.col(variable).alias(names[1]))
    return _paired(left, right, [*on, *CELL_KEYS], strict).select(*on, LAT, LON, *names)


def pair_features(
    features: DataFrame,
    labels: DataFrame,
    variables: Sequence[str],
    label: str,
    on: Sequence[str] = (TIME,),
    strict: bool = False,
) -> DataFrame:
    """Feature rows with the label of the same cell and timestep; ``strict`` as in ``pair_samples``."""
    left = with_cell_keys(features).select(*on, *CELL_KEYS, LAT, LON, *variables)
    right = with_cell_keys(labels).select(*on, *CELL_KEYS, F.col(TEMPERATURE).alias(label))
    return _paired(left, right, [*on, *CELL_KEYS], strict).select(*on, LAT, LON, *variables, label)


def unpaired_times(lr: DataFrame, hr: DataFrame) -> DataFrame:
    """Timesteps that only one side has; pairing by key leaves them out."""
    return _only_in_one(lr, hr, [TIME], ("lr", "hr"))


def unpaired_cells(lr: DataFrame, hr: DataFrame) -> DataFrame:
    """Cells of a timestep that only one side has; pairing by key leaves them out."""
    found = _only_in_one(with_cell_keys(lr), with_cell_keys(hr), [TIME, *CELL_KEYS], ("lr", "hr"), keep=(LAT, LON))
    return found.select(TIME, LAT, LON, "only_in")
