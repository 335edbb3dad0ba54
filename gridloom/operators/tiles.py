"""Cell rows <-> tiles (2-D arrays, north row first) of each timestep."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gridloom.operators.axes import GridAxes, axis_positions
from gridloom.operators.regrid import densify
from gridloom.schema import LAT, LON, TEMPERATURE, TIME

# Rows and columns of a tile; timesteps of any size are cut into such tiles.
TILE_SIDE = 512


def to_tiles(
    grid: DataFrame,
    variables: Sequence[str],
    axes: GridAxes | None = None,
    size: int = TILE_SIDE,
    cluster: str = "time",
) -> DataFrame:
    """(time, tile_y, tile_x, <variable> array<array<double>>): latitude descending, longitude ascending.

    Tiles are counted from the north-west corner and hold ``size`` x ``size`` values, those at
    the southern and eastern end what is left.  Missing cells are NULL elements: the grid is made
    dense on its axes first.  ``cluster='time'`` builds the tiles of a timestep where the timestep
    is; ``'lane'`` spreads a single huge timestep over many tasks.
    """
    axes = axes or GridAxes.of(grid)
    placed = densify(grid, variables, axes, cluster, positions=True)
    north = F.lit(axes.size(LAT) - 1) - F.col("lat_idx")
    cells = placed.withColumns(
        {"tile_y": F.floor(north / size).cast("int"), "tile_x": F.floor(F.col("lon_idx") / size).cast("int")}
    )
    names, tile = list(variables), [TIME, "tile_y", "tile_x"]
    rows = cells.groupBy(*tile, LAT).agg(F.sort_array(F.collect_list(F.struct(LON, *names))).alias("_row"))
    tiles = rows.groupBy(*tile).agg(
        F.sort_array(F.collect_list(F.struct((-F.col(LAT)).alias("_south"), "_row"))).alias("_tile")
    )

    def plane(variable: str):
        return F.transform("_tile", lambda r: F.transform(r["_row"], lambda c: c[variable])).alias(variable)

    return tiles.select(*tile, *map(plane, names))


def from_tiles(tiles: DataFrame, axes: GridAxes, variable: str = TEMPERATURE, size: int = TILE_SIDE) -> DataFrame:
    """Tile arrays back to cell rows: position in the grid -> axis coordinate."""
    cells = tile_cells(tiles, variable, size).withColumnsRenamed({"row": "_r", "col": "_c", "value": variable})
    return cells.select(
        TIME,
        F.get(axes.values(LAT), F.lit(axes.size(LAT) - 1) - F.col("_r")).alias(LAT),
        F.get(axes.values(LON), F.col("_c")).alias(LON),
        variable,
    )


def tile_cells(tiles: DataFrame, variable: str = TEMPERATURE, size: int = TILE_SIDE) -> DataFrame:
    """(time, row, col, value), rows counted from the north, columns from the west of the grid."""
    rows = tiles.select(TIME, "tile_y", "tile_x", F.posexplode(variable).alias("_r", "_row"))
    cells = rows.select(TIME, "tile_y", "tile_x", "_r", F.posexplode("_row").alias("_c", "value"))
    row, col = F.col("tile_y") * size + F.col("_r"), F.col("tile_x") * size + F.col("_c")
    return cells.select(TIME, row.alias("row"), col.alias("col"), "value")


def score_tiles(
    samples: DataFrame,
    score: Callable[[pd.DataFrame], pd.Series],
    variables: Sequence[str],
    output: str = TEMPERATURE,
    size: int | None = TILE_SIDE,
    halo: int = 0,
    axes: GridAxes | None = None,
) -> DataFrame:
    """Apply a spatial scorer to every tile of every timestep.

    ``score`` gets the cells of a tile and of a margin of ``halo`` rows and columns around it,
    north-up, as a pandas frame with their positions ``lat_idx`` and ``lon_idx``, and returns one
    value per row; the margin's values are dropped.  A scorer that looks no farther than ``halo``
    gives the same result for every ``size``.  ``size=None`` hands over whole timesteps, for
    scorers that cannot do with less: each must then fit into one task.
    """
    if halo < 0:
        raise ValueError("halo must not be negative")
    schema = T.StructType(
        [
            T.StructField(TIME, T.TimestampNTZType()),
            T.StructField(LAT, T.DoubleType()),
            T.StructField(LON, T.DoubleType()),
            T.StructField(output, T.DoubleType()),
        ]
    )

    tile_key = ["_tile_y", "_tile_x"]

    def one(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values([LAT, LON], ascending=[False, True], ignore_index=True)
        own = tile.pop("_own")
        return tile[[TIME, LAT, LON]].assign(**{output: score(tile.drop(columns=tile_key))})[own]

    cells = axis_positions(samples.select(TIME, LAT, LON, *variables), axes or GridAxes.of(samples))
    if size is None:
        cells = cells.withColumns({"_tile_y": F.lit(0), "_tile_x": F.lit(0), "_own": F.lit(True)})
    else:
        own = F.lit(True)
        for key, position in zip(tile_key, ("lat_idx", "lon_idx"), strict=True):
            first, last = (F.floor((F.col(position) + d) / size).cast("int") for d in (-halo, halo))
            cells = cells.withColumn(key, F.explode(F.sequence(first, last)))
            own = own & (F.floor(F.col(position) / size) == F.col(key))
        cells = cells.withColumn("_own", own)
    return cells.groupBy(TIME, *tile_key).applyInPandas(one, schema)


def score_rows(
    samples: DataFrame, score: Callable[[pd.DataFrame], pd.Series], variables: Sequence[str], output: str = TEMPERATURE
) -> DataFrame:
    """Apply a cell-wise scorer to Arrow batches, without any shuffle."""
    picked = samples.select(TIME, LAT, LON, *variables)
    schema = T.StructType([*picked.schema.fields[:3], T.StructField(output, T.DoubleType())])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[TIME, LAT, LON]].assign(**{output: score(frame)})

    return picked.mapInPandas(batches, schema)
