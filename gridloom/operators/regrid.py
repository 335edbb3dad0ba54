"""Reindexing, gap filling and regridding along the axes of a target grid.

All three are the same walk.  The known points of a lane (one row or one column of a
timestep) are put on positions of the target axis; neighbouring points span a run of target
positions, and each run is exploded and valued.  The cost is proportional to the output:
nothing is compared with points it does not belong to, and no target cell is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions import linear_between
from gridloom.operators.axes import GridAxes
from gridloom.schema import LAT, LON, TIME, assert_grid, coord_key
from gridloom.session import clustered

METHODS = ("linear", "nearest", "none")


def _position(points: DataFrame, axes: GridAxes, dim: str, name: str) -> DataFrame:
    pos = axes.positions(dim).withColumnsRenamed({"coord_key": "_key", "idx": name})
    return points.withColumn("_k", coord_key(dim)).join(pos, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")


def _unique(points: DataFrame, keys: list[str], on_grid: Column) -> DataFrame:
    """One row per grid point.

    Aggregated before anything is gathered, so copies of a point collapse on the map side and
    are reported instead of piling up in one lane.
    """
    merged = points.groupBy(*keys).agg(F.max("_v").alias("_v"), F.count("*").alias("_n"))
    clash = F.raise_error(F.lit("grid has several values for one (time, latitude, longitude)"))
    return merged.withColumn("_v", F.when(on_grid & (F.col("_n") > 1), clash).otherwise(F.col("_v"))).drop("_n")


# Runs of target positions with the two known points that value them.  The first and the last
# run reach the ends of the axis.  A lane with fewer than two known points becomes one run over
# the whole axis that keeps the single point, if there is one.
_RUNS = """
CASE WHEN size(_known) >= 2 THEN
  transform(sequence(0, size(_known) - 2), i -> named_struct(
    'lo', if(i = 0, 0, get(_known, i).p),
    'hi', if(i = size(_known) - 2, _size - 1, get(_known, i + 1).p - 1),
    'p0', get(_known, i).p, 'y0', get(_known, i).y,
    'p1', get(_known, i + 1).p, 'y1', get(_known, i + 1).y))
ELSE
  array(named_struct(
    'lo', 0, 'hi', _size - 1,
    'p0', get(_known, 0).p, 'y0', get(_known, 0).y,
    'p1', get(_known, 1).p, 'y1', get(_known, 1).y))
END"""


def _valued(axis: Column, pos: str, method: str) -> Column:
    p, p0, p1, y0, y1 = (F.col(c) for c in (pos, "p0", "p1", "y0", "y1"))
    exact = F.when(p == p0, y0).when(p == p1, y1)
    if method == "none":
        return exact
    x, x0, x1 = (F.get(axis, c) for c in (p, p0, p1))
    if method == "nearest":
        # On integer keys, so that a target half-way between two points always takes the lower.
        near = F.when(coord_key(x) * 2 <= coord_key(x0) + coord_key(x1), y0).otherwise(y1)
        return exact.when(p1.isNotNull(), near)
    return exact.when(p1.isNotNull(), linear_between(x, x0, y0, x1, y1))


def _fill_lanes(points: DataFrame, lane: list[str], pos: str, axes: GridAxes, dim: str, method: str) -> DataFrame:
    """Spread the known points of every lane over all positions of the ``dim`` axis."""
    point = f"if({pos} IS NOT NULL AND _v IS NOT NULL, named_struct('p', {pos}, 'y', _v), NULL)"
    lanes = points.groupBy(*lane).agg(F.expr(f"sort_array(collect_list({point}))").alias("_known"))
    runs = lanes.withColumn("_size", F.lit(axes.size(dim))).select(*lane, F.expr(f"inline({_RUNS})"))
    cells = runs.select("*", F.expr(f"explode(sequence(lo, hi)) AS {pos}"))
    return cells.select(*lane, pos, _valued(axes.values(dim), pos, method).alias("_v"))


def _coordinates(cells: DataFrame, axes: GridAxes, *positions: tuple[str, str]) -> DataFrame:
    return cells.withColumns({dim: F.get(axes.values(dim), F.col(pos)) for dim, pos in positions})


def _melt(grid: DataFrame, variables: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if len(variables) == 1:
        return grid.withColumn("_v", F.col(variables[0]).cast("double")), []
    pairs = [F.struct(F.lit(v).alias("_var"), F.col(v).cast("double").alias("_v")) for v in variables]
    return grid.select("*", F.inline(F.array(*pairs))), ["_var"]


def _unmelt(cells: DataFrame, variables: Sequence[str], positions: Sequence[str] = ()) -> DataFrame:
    if len(variables) == 1:
        return cells.select(TIME, LAT, LON, *positions, F.col("_v").alias(variables[0]))
    picks = [F.max(F.when(F.col("_var") == v, F.col("_v"))).alias(v) for v in variables]
    return cells.groupBy(TIME, LAT, LON, *positions).agg(*picks)


def _points(grid: DataFrame, axes: GridAxes, variables: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One row per usable point (time, [variable,] _iy, _ix, _v) on positions of the target axes.

    Points off the target axes carry no value; they collapse into one marker per timestep, which keeps
    timesteps without any usable point in the dense result.
    """
    melted, var = _melt(grid.select(TIME, LAT, LON, *variables), variables)
    placed = _position(_position(melted, axes, LAT, "_iy"), axes, LON, "_ix")
    on_grid = F.col("_iy").isNotNull() & F.col("_ix").isNotNull()
    placed = placed.select(
        TIME,
        *var,
        F.when(on_grid, F.col("_iy")).alias("_iy"),
        F.when(on_grid, F.col("_ix")).alias("_ix"),
        F.when(on_grid, F.col("_v")).alias("_v"),
    )
    return _unique(placed, [TIME, *var, "_iy", "_ix"], F.col("_iy").isNotNull()), var


def _walk(points: DataFrame, axes: GridAxes, var: list[str], method: str, cluster: str) -> DataFrame:
    """Cells (time, [variable,] _iy, _ix, _v) from points, along longitude first, then along latitude."""
    rows = _fill_lanes(points, [TIME, *var, "_iy"], "_ix", axes, LON, method)
    if cluster == "lane":
        rows = clustered(rows, TIME, "_ix")
    return _fill_lanes(rows, [TIME, *var, "_ix"], "_iy", axes, LAT, method)


def _checked(grid: DataFrame, variables: Sequence[str], method: str, cluster: str) -> None:
    assert_grid(grid, variables)
    if method not in METHODS:
        raise ValueError(f"unsupported interpolation method {method!r}; use one of {METHODS}")
    if cluster not in ("time", "lane"):
        raise ValueError("cluster must be 'time' or 'lane'")


def _onto(
    grid: DataFrame, axes: GridAxes, variables: Sequence[str], method: str, cluster: str, positions: bool = False
) -> DataFrame:
    """``positions`` adds lat_idx and lon_idx, which are known here without another join."""
    _checked(grid, variables, method, cluster)
    if not (axes.size(LAT) and axes.size(LON)):
        none = [F.lit(0).alias(c) for c in ("lat_idx", "lon_idx") if positions]
        return grid.select(TIME, LAT, LON, *none, *variables).limit(0)
    points, var = _points(grid, axes, variables)
    # Clustered by time, both passes group by keys that contain time: one shuffle of the coarse points serves
    # both, and the fine cells are produced where their timestep already is.
    points = clustered(points, TIME) if cluster == "time" else clustered(points, TIME, "_iy")
    cells = _coordinates(_walk(points, axes, var, method, cluster), axes, (LAT, "_iy"), (LON, "_ix"))
    if not positions:
        return _unmelt(cells, variables)
    return _unmelt(cells.withColumnsRenamed({"_iy": "lat_idx", "_ix": "lon_idx"}), variables, ("lat_idx", "lon_idx"))


def regrid(
    coarse: DataFrame,
    axes: GridAxes,
    variables: Sequence[str],
    method: str = "linear",
    cluster: str = "time",
    use_outside_neighbours: bool = False,
) -> DataFrame:
    """Coarse grid on the axes of a fine one: along longitude first, then along latitude.

    Only coarse points that lie on the target axes take part, so edges beyond them are
    extrapolated; ``use_outside_neighbours`` lets the other points help as well.
    ``cluster='time'`` shuffles once and suits many timesteps of bounded size; ``'lane'``
    shuffles once per pass and spreads a single huge timestep (static fields) over many tasks.
    """
    if not use_outside_neighbours:
        return _onto(coarse, axes, variables, method, cluster)
    wide = axes.union(GridAxes.of(coarse)).stage()
    cells = _onto(coarse, wide, variables, method, cluster)
    for dim in (LAT, LON):
        keys = axes.positions(dim).select("coord_key")
        cells = cells.join(keys, coord_key(dim) == F.col("coord_key"), "left_semi")
    return cells


def reindex(grid: DataFrame, axes: GridAxes, variables: Sequence[str], cluster: str = "time") -> DataFrame:
    """Values only where coordinates match exactly, NULL at every other target cell."""
    return _onto(grid, axes, variables, "none", cluster)


def densify(
    grid: DataFrame,
    variables: Sequence[str],
    axes: GridAxes | None = None,
    cluster: str = "time",
    positions: bool = False,
) -> DataFrame:
    """Every (time, latitude, longitude) of the grid's own axes, NULL where absent.

    ``positions`` adds the ascending positions lat_idx and lon_idx.
    """
    return _onto(grid, axes or GridAxes.of(grid), variables, "none", cluster, positions)


def interpolate_gaps(
    grid: DataFrame, dim: str, variable: str, method: str = "linear", axes: GridAxes | None = None
) -> DataFrame:
    """Fill missing values along one axis; ends are extrapolated, lanes with <2 points kept."""
    if method not in METHODS:
        raise ValueError(f"unsupported interpolation method {method!r}; use one of {METHODS}")
    axes = axes or GridAxes.of(grid)
    other = LON if dim == LAT else LAT
    placed = _position(grid.select(TIME, LAT, LON, F.col(variable).alias("_v")), axes, dim, "_pos")
    points = _unique(placed, [TIME, other, "_pos"], F.lit(True))
    filled = _coordinates(_fill_lanes(points, [TIME, other], "_pos", axes, dim, method), axes, (dim, "_pos"))
    return filled.select(TIME, LAT, LON, F.col("_v").alias(variable))
