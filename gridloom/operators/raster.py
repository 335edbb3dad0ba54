"""Block and neighbourhood operators over the cells of each timestep.

Neighbourhoods are scattered, not joined: a cell sends its weighted value to the cells it
touches and the sums are taken per target.  Timesteps are cut into bands of rows with a thin
overlap first, so one shuffle of the cells is enough, the scatter itself stays local, and even
a single enormous timestep spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.operators.axes import GridAxes, axis_positions
from gridloom.schema import CELL_KEYS, LAT, LON, TEMPERATURE, TIME, with_cell_keys
from gridloom.session import clustered

Kernel = Sequence[Sequence[float]]

BAND_ROWS = 64
# Epsilon of the batch normalisation, bilinear doubling kernel.
NORM_EPSILON = 1e-3
BILINEAR = [[0.25, 0.5, 0.25], [0.5, 1.0, 0.5], [0.25, 0.5, 0.25]]
NEAREST = [[1.0, 1.0], [1.0, 1.0]]

MISSING = ("null", "zero", "renormalise")

POOLS = {"max": F.max, "min": F.min, "avg": F.avg}


def block_pool(
    grid: DataFrame,
    variable: str = TEMPERATURE,
    size: int = 2,
    how: str = "max",
    axes: GridAxes | None = None,
    origin: str = "north",
) -> DataFrame:
    """Aggregate size x size blocks, numbered from the south-west.

    Blocks start at the northernmost row (``origin='south'``: the southernmost) and the
    westernmost column; the incomplete row or column of blocks at the other end is dropped.
    """
    if origin not in ("north", "south"):
        raise ValueError("origin must be 'north' or 'south'")
    axes = axes or GridAxes.of(grid)
    skipped = axes.size(LAT) % size if origin == "north" else 0
    y, x = F.floor((F.col("lat_idx") - skipped) / size).cast("int"), F.floor(F.col("lon_idx") / size).cast("int")
    blocks = axis_positions(grid, axes).select(TIME, y.alias("block_y"), x.alias("block_x"), variable)
    whole = F.col("block_y").between(0, axes.size(LAT) // size - 1) & (F.col("block_x") < axes.size(LON) // size)
    return blocks.where(whole).groupBy(TIME, "block_y", "block_x").agg(POOLS[how](variable).alias(variable))


def _scatter(
    cells: DataFrame, taps: list[tuple[int, int, dict[str, float]]], stride: int, keep: Sequence[str] = ()
) -> DataFrame:
    """Sum tap-weighted values at (stride*y + dy, stride*x + dx).

    Besides ``_sum``: ``_taps``, the number of present values with a weight other than zero, and
    ``_weight``, the sum of their weights.

    ``cells`` has time, y, x, the weighted variables and the columns of ``keep``, which are
    taken from the cell that lands on its own position with dy = dx = 0.
    """
    reach = [stride * F.col("y") + dy for dy in (min(t[0] for t in taps), 0, max(t[0] for t in taps))]
    rows = cells.withColumn("_band", F.explode(F.array_distinct(F.array(*map(_band, reach)))))
    return _spread(clustered(rows, TIME, "_band"), taps, stride, keep, 0).drop("_band")


def _band(position: Column) -> Column:
    return F.floor(position / BAND_ROWS).cast("int")


def _spread(
    rows: DataFrame, taps: list[tuple[int, int, dict[str, float]]], stride: int, keep: Sequence[str], margin: int
) -> DataFrame:
    """``_scatter`` inside bands that are in place: targets of each ``_band`` and of ``margin`` rows around it."""
    variables = list(taps[0][2])
    weights = F.array(
        *[
            F.struct(
                F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), *[F.lit(float(w[v])).alias(f"w_{v}") for v in variables]
            )
            for dy, dx, w in taps
        ]
    )
    sent = rows.select("*", F.inline(weights)).withColumns(
        {"_ty": stride * F.col("y") + F.col("dy"), "_tx": stride * F.col("x") + F.col("dx")}
    )
    # Taps without weight take no part, so a missing cell under them does no harm.
    used = {v: F.col(v).isNotNull() & (F.col(f"w_{v}") != 0) for v in variables}
    part, weight = (
        sum((F.when(used[v], term(v)).otherwise(F.lit(0.0)) for v in variables), F.lit(0.0))
        for term in (lambda v: F.col(v) * F.col(f"w_{v}"), lambda v: F.col(f"w_{v}"))
    )
    found = sum((hit.cast("int") for hit in used.values()), F.lit(0))
    centre = (F.col("dy") == 0) & (F.col("dx") == 0)
    first = F.col("_band") * BAND_ROWS
    return (
        sent.where(F.col("_ty").between(first - margin, first + (BAND_ROWS - 1 + margin)))
        .groupBy(TIME, "_band", "_ty", "_tx")
        .agg(
            F.sum(part).alias("_sum"),
            F.sum(weight).alias("_weight"),
            F.sum(found).alias("_taps"),
            F.max(centre).alias("_own"),
            *[F.max(F.when(centre, F.col(k))).alias(k) for k in keep],
        )
    )


def _inside(axes: GridAxes, taps: list[tuple[int, int, dict[str, float]]], stride: int) -> tuple[Column, Column]:
    """Number and weight of the taps that reach a target from inside the axes, missing cells included."""
    count, weight = F.lit(0), F.lit(0.0)
    for dy, dx, weights in taps:
        used = [w for w in weights.values() if w != 0]
        if not used:
            continue
        here = F.lit(True)
        for target, shift, dim in (("_ty", dy, LAT), ("_tx", dx, LON)):
            source = F.col(target) - shift
            here = here & (F.pmod(source, F.lit(stride)) == 0) & source.between(0, stride * (axes.size(dim) - 1))
        count = count + F.when(here, len(used)).otherwise(0)
        weight = weight + F.when(here, float(sum(used))).otherwise(0.0)
    return count, weight


def _complete(value: Column, count: Column, weight: Column, on_missing: str) -> Column:
    """What a sum is worth where cells inside the grid are missing."""
    if on_missing not in MISSING:
        raise ValueError(f"on_missing must be one of {MISSING}")
    if on_missing == "zero":
        return value
    whole = F.col("_taps") == count
    rescaled = value * weight / F.when(F.col("_weight") != 0, F.col("_weight")) if on_missing == "renormalise" else F.lit(None)
    return F.when(whole, value).otherwise(rescaled)


def convolve(
    grid: DataFrame,
    kernels: Mapping[str, Kernel],
    output: str = "focal",
    bias: float = 0.0,
    axes: GridAxes | None = None,
    on_missing: str = "null",
) -> DataFrame:
    """'Same' convolution (cross-correlation) summed over variables; zero outside the grid.

    Kernel rows follow ascending latitude, kernel columns ascending longitude.  Where a cell
    inside the grid that a weight reaches is missing (NULL or absent), the result is NULL;
    ``on_missing='zero'`` counts it as zero, ``'renormalise'`` spreads its weight over the rest.
    """
    return convolve_chain(grid, [Stencil(kernels, bias)], output, axes, on_missing)


@dataclass(frozen=True)
class Stencil:
    """One 'same' convolution of a chain: a kernel by variable, a bias, what is done to the sum."""

    kernels: Mapping[str, Kernel]
    bias: float = 0.0
    activation: str = "linear"

    def taps(self) -> list[tuple[int, int, dict[str, float]]]:
        first = next(iter(self.kernels.values()))
        ry, rx = len(first) // 2, len(first[0]) // 2
        return [
            (ry - r, rx - c, {v: k[r][c] for v, k in self.kernels.items()})
            for r in range(len(first))
            for c in range(len(first[0]))
        ]


def convolve_chain(
    grid: DataFrame,
    steps: Sequence[Stencil],
    output: str = "focal",
    axes: GridAxes | None = None,
    on_missing: str = "null",
) -> DataFrame:
    """Convolutions one after the other, as calls of ``convolve`` in a row, with one exchange of the cells.

    Every step but the first has a kernel for ``output``, what the step before gave.  The halos of
    the steps are added up and each band of rows gets so many rows around it at once; a step then works
    on the band and the halos of the steps after it, and the last one on the band alone.  Rows of a halo
    are computed once for each band they belong to.
    """
    if not steps or any(list(s.kernels) != [output] for s in steps[1:]):
        raise ValueError(f"a chain needs steps, and those after the first one kernel, for {output!r}")
    axes = axes or GridAxes.of(grid)
    taps = [s.taps() for s in steps]
    halos = [max(abs(dy) for dy, _, _ in t) for t in taps]
    cells = axis_positions(grid, axes).select(
        TIME, F.col("lat_idx").alias("y"), F.col("lon_idx").alias("x"), LAT, LON, *steps[0].kernels
    )
    around = F.sequence(*(_band(F.col("y") + d) for d in (-sum(halos), sum(halos))))
    rows = clustered(cells.withColumn("_band", F.explode(around)), TIME, "_band")
    for n, (step, reached) in enumerate(zip(steps, taps, strict=True)):
        out = _spread(rows, reached, 1, (LAT, LON), sum(halos[n + 1 :])).where(F.col("_own"))
        value = _complete(F.col("_sum"), *_inside(axes, reached, 1), on_missing) + step.bias
        rows = activate(
            out.select(TIME, "_band", F.col("_ty").alias("y"), F.col("_tx").alias("x"), LAT, LON, value.alias(output)), output, step.activation
        )
    return rows.select(TIME, LAT, LON, output)


def upsample(
    grid: DataFrame,
    variable: str = TEMPERATURE,
    kernel: Kernel = BILINEAR,
    stride: int = 2,
    axes: GridAxes | None = None,
    on_missing: str = "null",
    interpolate: bool = True,
) -> DataFrame:
    """Kernel-weighted cells as (time, out_y, out_x, value) on an axis ``stride`` times longer.

    Input (y, x) reaches outputs stride*y .. stride*y + k - 1; what falls beyond the end of the
    longer axis is cut off.  An output is the mean of the inputs that reach it by their weights,
    so a constant field stays constant up to its edges; ``interpolate=False`` gives the plain
    sums of a transposed convolution.  ``on_missing`` as in ``convolve``; outputs that no present
    cell reaches are absent.
    """
    axes = axes or GridAxes.of(grid)
    taps = [(r, c, {variable: kernel[r][c]}) for r in range(len(kernel)) for c in range(len(kernel[0]))]
    cells = axis_positions(grid, axes).select(TIME, F.col("lat_idx").alias("y"), F.col("lon_idx").alias("x"), variable)
    out = _scatter(cells, taps, stride)
    inside = (F.col("_ty") < stride * axes.size(LAT)) & (F.col("_tx") < stride * axes.size(LON))
    count, weight = _inside(axes, taps, stride)
    value = _complete(F.col("_sum"), count, weight, on_missing)
    if interpolate:
        value = value / F.when(weight != 0, weight)
    return out.where(inside).where(F.col("_taps") > 0).select(
        TIME, F.col("_ty").alias("out_y"), F.col("_tx").alias("out_x"), value.alias(variable)
    )


def pointwise(weights: Mapping[str, float], bias: float = 0.0) -> Column:
    """1x1 convolution: a linear combination of the variables of a cell."""
    return sum((F.col(v) * F.lit(float(w)) for v, w in weights.items()), F.lit(float(bias)))


def join_channels(left: DataFrame, right: DataFrame, keys: Sequence[str] = (TIME, LAT, LON)) -> DataFrame:
    """Add the channels of the same cell; coordinates meet by key, those of ``left`` stay."""
    cells = [k for k in keys if k in (LAT, LON)]
    if len(cells) < 2:
        return left.join(right, list(keys))
    on = [*(k for k in keys if k not in cells), *CELL_KEYS]
    return with_cell_keys(left).join(with_cell_keys(right).drop(LAT, LON), on).drop(*CELL_KEYS).select(
        *left.columns, *(c for c in right.columns if c not in keys)
    )


def batch_norm(grid: DataFrame, variable: str = TEMPERATURE, epsilon: float = NORM_EPSILON) -> DataFrame:
    """Standardise a channel over all cells and times, without learned scale."""
    moments = grid.agg(F.struct(F.avg(variable).alias("mean"), F.var_pop(variable).alias("var")).alias("m")).scalar()
    return grid.withColumn(variable, (F.col(variable) - moments["mean"]) / F.sqrt(moments["var"] + epsilon))


def activate(grid: DataFrame, variable: str = TEMPERATURE, activation: str = "tanh") -> DataFrame:
    if activation not in ("tanh", "linear"):
        raise ValueError("activation must be 'tanh' or 'linear'")
    return grid.withColumn(variable, F.tanh(variable)) if activation == "tanh" else grid
