"""Regridding by a weight table: a sparse linear map from source points to target cells.

Where a timestep has all its points, a target cell is a fixed weighted sum of at most four of them.  The weights
depend on the two pairs of axes alone, so they are made once, kept per axis (a cell's weight is the product of
its latitude's and its longitude's), and applied by a broadcast join and one partial sum.  No lane is gathered.
Timesteps that lack a point go through the walk along the axes instead, in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from gridloom.operators.axes import GridAxes
from gridloom.operators.regrid import _checked, _coordinates, _points, _unmelt, _walk
from gridloom.schema import LAT, LON, TIME
from gridloom.session import broadcast_if_small, clustered, stage


@dataclass(frozen=True)
class WeightTable:
    """(dim, src, idx, weight): the share of the source point at target position ``src`` in the value at ``idx``.

    ``known`` is the number of source points per dimension, ``rows`` the number of weights.
    """

    table: DataFrame
    axes: GridAxes
    known: dict[str, int]
    rows: dict[str, int]
    method: str

    @classmethod
    def of(cls, source: GridAxes, target: GridAxes, method: str = "linear") -> WeightTable:
        """Weights between two pairs of axes; source points off the target axes have none.

        A lone source point keeps its own position and no other, as in the walk.
        """
        known = target.table.join(source.table.select("dim", "coord_key"), ["dim", "coord_key"])
        order = Window.partitionBy("dim").orderBy("idx")
        pairs = known.select(
            "dim",
            F.col("idx").alias("p0"),
            F.col("coord_key").alias("k0"),
            F.lead("idx").over(order).alias("p1"),
            F.lead("coord_key").over(order).alias("k1"),
            F.row_number().over(order).alias("i"),
            F.count("*").over(Window.partitionBy("dim")).alias("n"),
        )
        # The first and the last run reach the ends of the axis.
        size = F.when(F.col("dim") == LAT, F.lit(target.size(LAT))).otherwise(F.lit(target.size(LON)))
        lone = F.col("n") == 1
        lo = F.when(lone | (F.col("i") > 1), F.col("p0")).otherwise(0)
        hi = F.when(lone, F.col("p0")).when(F.col("i") == F.col("n") - 1, size - 1).otherwise(F.col("p1") - 1)
        runs = pairs.where(lone | F.col("p1").isNotNull()).select("*", F.explode(F.sequence(lo, hi)).alias("idx"))
        cells = runs.join(target.table.select("dim", "idx", "coord_key"), ["dim", "idx"])
        # On integer keys: the share of the upper point is the same fraction whatever the precision of coordinates.
        x, x0, x1 = F.col("coord_key"), F.col("k0"), F.col("k1")
        upper = F.when(lone, F.lit(0.0)).otherwise((x - x0) / (x1 - x0))
        if method == "nearest":
            upper = F.when(upper > 0.5, 1.0).otherwise(0.0)
        elif method == "none":
            upper = F.when(x == x0, 0.0).when(x == x1, 1.0)
        ends = F.array(
            F.struct(F.col("p0").alias("src"), (1 - upper).alias("weight")),
            F.struct(F.col("p1").alias("src"), upper.alias("weight")),
        )
        table = stage(cells.select("dim", "idx", F.inline(ends)).where("weight <> 0"), "weights")
        found = {r["dim"]: (r["known"], r["rows"]) for r in table.groupBy("dim").agg(F.countDistinct("src").alias("known"), F.count("*").alias("rows")).collect()}
        return cls(table, target, *({d: found.get(d, (0, 0))[i] for d in (LAT, LON)} for i in (0, 1)), method)

    def of_axis(self, dim: str, src: str, idx: str, weight: str) -> DataFrame:
        side = self.table.where(F.col("dim") == dim).select(F.col("src").alias(src), F.col("idx").alias(idx), F.col("weight").alias(weight))
        return broadcast_if_small(side, self.rows[dim])


def regrid_by_weights(grid: DataFrame, weights: WeightTable, variables: Sequence[str], complete: bool = False) -> DataFrame:
    """``grid`` on the weights' axes: the rows of ``regrid``, whole timesteps by weights, others by the walk.

    The points are shuffled once, by time; the completeness of a timestep is counted where it then lies, and the
    sums need no further shuffle.  ``complete=True`` leaves the walk out of the plan and raises on a timestep
    that lacks a point.  With the method ``none`` the target cells that are no points stay absent from whole
    timesteps, so it is refused.
    """
    _checked(grid, variables, weights.method, "time")
    if weights.method == "none":
        raise ValueError("cells between the points have no weights; use reindex")
    axes = weights.axes
    if not (axes.size(LAT) and axes.size(LON)):
        return grid.select(TIME, LAT, LON, *variables).limit(0)
    points, var = _points(grid, axes, variables)
    points = clustered(points, TIME)
    wanted = weights.known[LAT] * weights.known[LON]
    # A lone line of points reaches no other line: those cells are NULL, which the walk makes.
    thin = min(weights.known.values()) < 2
    found = F.count(F.when(F.col("_iy").isNotNull(), F.col("_v"))).over(Window.partitionBy(TIME, *var))
    flagged = points.withColumn("_whole", F.lit(False) if thin else found == wanted)
    if complete:
        lacking = F.raise_error(F.lit("a timestep lacks points of the source axes")).cast("boolean")
        flagged = flagged.withColumn("_whole", F.when(F.col("_whole"), F.lit(True)).otherwise(lacking))
    whole = (
        flagged.where(F.col("_whole") & F.col("_iy").isNotNull())
        .withColumnsRenamed({"_iy": "_sy", "_ix": "_sx"})
        .join(weights.of_axis(LAT, "_sy", "_iy", "_wy"), "_sy")
        .join(weights.of_axis(LON, "_sx", "_ix", "_wx"), "_sx")
        .groupBy(TIME, *var, "_iy", "_ix")
        .agg(F.sum(F.col("_v") * F.col("_wy") * F.col("_wx")).alias("_v"))
    )
    if not complete:
        holey = _walk(flagged.where(~F.col("_whole")).drop("_whole"), axes, var, weights.method, "time")
        whole = whole.unionByName(holey)
    return _unmelt(_coordinates(whole, axes, (LAT, "_iy"), (LON, "_ix")), variables)
