"""Raw grids -> normalised, aligned features and labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from gridloom.operators.align import combine_static
from gridloom.operators.axes import GridAxes
from gridloom.operators.normalize import Stats, scaler
from gridloom.operators.regrid import regrid
from gridloom.operators.select import at_times, crop_to_axes, crop_to_region, cropped_axes
from gridloom.operators.weights import WeightTable, regrid_by_weights
from gridloom.schema import DEFAULT_REGION, LR_STATIC, TEMPERATURE, Region
from gridloom.session import stage


@dataclass(frozen=True)
class Aligned:
    """Physical-unit grids on the same axes, before normalisation."""

    lr: DataFrame
    hr: DataFrame
    lr_static: DataFrame
    axes: GridAxes


@dataclass(frozen=True)
class Preprocessed:
    lr: DataFrame
    hr: DataFrame
    stats: Stats
    axes: GridAxes


def _regridded(lr: DataFrame, axes: GridAxes, regridding: str) -> DataFrame:
    if regridding == "weights":
        return regrid_by_weights(lr, WeightTable.of(GridAxes.of(lr), axes), [TEMPERATURE])
    return regrid(lr, axes, [TEMPERATURE], cluster=regridding)


def align(
    lr: DataFrame,
    hr: DataFrame,
    lr_static: DataFrame,
    hr_static: DataFrame,
    region: Region | Sequence[float] | None = DEFAULT_REGION,
    times: Sequence[str] = ("12:00",),
    divisible_factor: int = 32,
    regridding: str = "time",
) -> Aligned:
    """Time-of-day filter, crop of the fine grid, regridding of the coarse one onto it.

    Static fields are not filtered by time; the fine static grid serves as target axes only.  ``regridding``
    of the temperature: ``"time"`` or ``"lane"`` as the clustering of ``regrid``, ``"weights"`` by a weight table.
    """
    lr, hr = at_times(lr, times), at_times(hr, times)
    axes = cropped_axes(hr, region, divisible_factor)
    static_axes = cropped_axes(hr_static, region, divisible_factor)
    return Aligned(
        # Read by the fit, the transform and the prediction: written once, not regridded thrice.
        lr=stage(_regridded(lr, axes, regridding), "regridded"),
        hr=crop_to_axes(crop_to_region(hr, region), axes),
        # One row per cell, read by the fit and by the join: worth writing once.
        lr_static=stage(regrid(lr_static, static_axes, LR_STATIC, cluster="lane"), "static"),
        axes=axes,
    )


def preprocess(
    lr: DataFrame,
    hr: DataFrame,
    lr_static: DataFrame,
    hr_static: DataFrame,
    kind: str = "standardized_anomalies",
    stats: Stats | None = None,
    fit: bool = True,
    reset_stats: bool = True,
    stats_path: str | None = None,
    region: Region | Sequence[float] | None = DEFAULT_REGION,
    times: Sequence[str] = ("12:00",),
    divisible_factor: int = 32,
    fit_lr: Column | None = None,
    fit_hr: Column | None = None,
    regridding: str = "time",
) -> Preprocessed:
    """Aligned and normalised coarse features (t2m, lsm, z) and fine labels.

    ``fit=False`` reuses ``stats``.  ``fit_lr`` / ``fit_hr`` restrict the rows that statistics
    are fitted on, so that one call can fit on the training range and transform everything.
    """
    empty = Stats.empty(lr.sparkSession)
    stats = empty if stats is None or (fit and reset_stats) else stats
    aligned = align(lr, hr, lr_static, hr_static, region, times, divisible_factor, regridding)
    s = scaler(kind)
    if fit:
        lr_fit = aligned.lr if fit_lr is None else aligned.lr.where(fit_lr)
        hr_fit = aligned.hr if fit_hr is None else aligned.hr.where(fit_hr)
        stats = s.fit_temperature(stats, lr_fit, hr_fit)
        stats = s.fit_features(stats, aligned.lr_static, LR_STATIC)
    features = combine_static(
        s.apply_temperature(stats, aligned.lr, "lr"),
        s.apply_features(stats, aligned.lr_static, LR_STATIC),
        LR_STATIC,
    )
    labels = s.apply_temperature(stats, aligned.hr, "hr")
    if stats_path is not None:
        stats.save(stats_path)
    return Preprocessed(features, labels, stats, aligned.axes)
