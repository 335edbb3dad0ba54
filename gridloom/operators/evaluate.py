"""Scores and the tables behind maps and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions import degree_label, residual
from gridloom.operators.align import keyed
from gridloom.operators.axes import bounding_box
from gridloom.schema import CELL_KEYS, LAT, LON, TEMPERATURE, with_cell_keys

# Histogram bins, display clip of difference maps, tick spacing, graticule points.
HISTOGRAM_BINS = 50
DIFFERENCE_CLIP = 5.0
TICK_STEP = 5.0
GRATICULE_POINTS = 100


def _missing(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c)


def _checked(value: Column, on_missing: str) -> Column:
    if on_missing == "skip":
        return value
    if on_missing != "error":
        raise ValueError("on_missing must be 'error' or 'skip'")
    gaps = F.count(F.when(_missing("y_true") | _missing("y_pred"), 1))
    return F.when(gaps > 0, F.raise_error(F.lit("missing values among truth or prediction"))).otherwise(value)


def metrics(pair: DataFrame, by: Sequence[str] = (), on_missing: str = "error") -> DataFrame:
    """Intervals, RMSE, MAE and their share of the true range; a single aggregate."""
    error = F.col("y_true") - F.col("y_pred")
    both = ~(_missing("y_true") | _missing("y_pred"))
    pair = pair if on_missing == "error" else pair.where(both)
    scored = pair.groupBy(*by).agg(
        F.min("y_true").alias("true_min"),
        F.max("y_true").alias("true_max"),
        F.min("y_pred").alias("pred_min"),
        F.max("y_pred").alias("pred_max"),
        _checked(F.sqrt(F.avg(error * error)), on_missing).alias("rmse"),
        _checked(F.avg(F.abs(error)), on_missing).alias("mae"),
        F.count("*").alias("n"),
    )
    true_range = F.col("true_max") - F.col("true_min")
    return scored.withColumns(
        {f"{m}_percentage_true": F.try_divide(F.col(m), true_range) * 100 for m in ("rmse", "mae")}
    )


def losses(pair: DataFrame, by: Sequence[str] = (), delta: float = 1.0) -> DataFrame:
    """mse, mae and huber_loss of every group."""
    error = F.col("y_true") - F.col("y_pred")
    size = F.abs(error)
    huber = F.when(size <= delta, 0.5 * error * error).otherwise(delta * size - 0.5 * delta * delta)
    return pair.groupBy(*by).agg(
        F.avg(error * error).alias("mse"), F.avg(size).alias("mae"), F.avg(huber).alias("huber_loss")
    )


def mean_map(grid: DataFrame, variables: Sequence[str] = (TEMPERATURE,)) -> DataFrame:
    """Mean over time of every variable, per cell."""
    return (
        with_cell_keys(grid)
        .groupBy(*CELL_KEYS)
        .agg(F.min(LAT).alias(LAT), F.min(LON).alias(LON), *[F.avg(v).alias(v) for v in variables])
        .drop(*CELL_KEYS)
    )


def spatial_comparison(
    truth: DataFrame, prediction: DataFrame, variable: str = TEMPERATURE, both_extents: bool = False
) -> DataFrame:
    """Temporal means of truth and prediction side by side, with the extent of the truth.

    ``both_extents`` adds the extent of the prediction, as pred_lon_min and so on.
    """
    means = [
        keyed(mean_map(g, [variable]), LAT, LON, F.col(variable).alias(name))
        for g, name in ((truth, "y_true_mean"), (prediction, "y_pred_mean"))
    ]
    joined = means[0].join(means[1].drop(LAT, LON), CELL_KEYS).drop(*CELL_KEYS)
    box = bounding_box(truth)
    extent = box.select(F.struct("*").alias("extent")).scalar()
    joined = joined.withColumns({c: extent[c] for c in box.columns})
    if not both_extents:
        return joined
    other = bounding_box(prediction).select(F.struct("*").alias("extent")).scalar()
    return joined.withColumns({f"pred_{c}": other[c] for c in box.columns})


def difference_map(
    truth: DataFrame, prediction: DataFrame, variable: str = TEMPERATURE, clip: float = DIFFERENCE_CLIP
) -> DataFrame:
    """Mean truth minus mean prediction per cell, and the value as displayed."""
    means = [
        keyed(mean_map(g, [variable]), LAT, LON, F.col(variable).alias(name))
        for g, name in ((truth, "_t"), (prediction, "_p"))
    ]
    joined = means[0].join(means[1].drop(LAT, LON), CELL_KEYS)
    return joined.select(
        LAT, LON, residual("_t", "_p").alias("difference"), residual("_t", "_p", clip).alias("shown")
    )


def _number(column: str) -> Column:
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def histogram(data: DataFrame, series: dict[str, str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width counts of each series on its own range; ``series`` maps label -> column.

    Bins are half-open but for the last one; empty bins are present.  A constant series is
    widened by half a unit on both sides.  Missing values (NULL, NaN) are in no bin.  Two column scans, one shuffle of bin counts.
    """
    limits = data.agg(
        F.struct(
            *[f(_number(c)).alias(f"{n}_{s}") for s, c in series.items() for n, f in (("lo", F.min), ("hi", F.max))]
        ).alias("limits")
    ).scalar()
    edges = {}
    for label in series:
        lo, hi = limits[f"lo_{label}"], limits[f"hi_{label}"]
        flat = lo == hi
        edges[label] = (F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi))

    def bin_of(label: str) -> Column:
        (lo, hi), x = edges[label], _number(series[label])
        step = (hi - lo) / bins
        guess = F.least(F.floor((x - lo) * bins / (hi - lo)), F.lit(bins - 1))
        # Rounding may put a value next to an edge on the wrong side of it.
        down = F.when(x < lo + guess * step, -1).otherwise(0)
        up = F.when((guess < bins - 1) & (x >= lo + (guess + 1) * step), 1).otherwise(0)
        return F.when(x.isNotNull(), (guess + down + up).cast("int"))

    binned = data.select(
        F.inline(F.array(*[F.struct(F.lit(s).alias("series"), bin_of(s).alias("bin")) for s in series]))
    )
    counts = binned.where(F.col("bin").isNotNull()).groupBy("series", "bin").agg(F.count("*").alias("n"))
    lo = F.coalesce(*[F.when(F.col("series") == s, e[0]) for s, e in edges.items()])
    hi = F.coalesce(*[F.when(F.col("series") == s, e[1]) for s, e in edges.items()])
    return (
        _bin_frame(data, series, bins)
        .join(counts, ["series", "bin"], "left")
        .withColumns({"n": F.coalesce("n", F.lit(0)), "_lo": lo, "_hi": hi})
        .select(
            "series",
            "bin",
            (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("left_edge"),
            (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("right_edge"),
            "n",
        )
    )


def _bin_frame(data: DataFrame, series: dict[str, str], bins: int) -> DataFrame:
    labels = F.array(*map(F.lit, series))
    ids = data.sparkSession.range(len(series) * bins, numPartitions=1)
    return ids.select(
        F.get(labels, F.floor(F.col("id") / bins).cast("int")).alias("series"), (F.col("id") % bins).cast("int").alias("bin")
    )


def axis_ticks(grid: DataFrame, step: float = TICK_STEP) -> DataFrame:
    """Tick values from the smallest coordinate up to, not including, the largest."""
    box = bounding_box(grid)
    parts = []
    for axis, lo, hi, letter in ((LAT, "lat_min", "lat_max", "N"), (LON, "lon_min", "lon_max", "E")):
        n = F.ceil((F.col(hi) - F.col(lo)) / step).cast("int")
        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1))
        ticks = box.select(F.col(lo).alias("_lo"), F.explode(steps).alias("_i"))
        value = F.col("_lo") + F.col("_i") * step
        parts.append(ticks.select(F.lit(axis).alias("axis"), value.alias("tick"), degree_label(value, letter).alias("label")))
    return parts[0].unionByName(parts[1])


def graticule(grid: DataFrame, points: int = GRATICULE_POINTS) -> DataFrame:
    """Evenly spaced coordinates over the bounding box, both ends included."""
    box = bounding_box(grid)
    i = F.col("i")
    at = lambda lo, hi: F.col(lo) + i * (F.col(hi) - F.col(lo)) / (points - 1)
    return box.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select(
        "i", at("lat_min", "lat_max").alias(LAT), at("lon_min", "lon_max").alias(LON)
    )
