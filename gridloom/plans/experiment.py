"""Split, preprocess, fit, predict, score: one experiment end to end."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gridloom.operators.align import pair_features, pair_samples, unpaired_times
from gridloom.operators.evaluate import difference_map, histogram, losses, metrics, spatial_comparison
from gridloom.operators.gram import GroupLinear, LossFitter
from gridloom.operators.model import CellLines, LineFitter
from gridloom.operators.normalize import Stats, scaler
from gridloom.operators.split import TEST_SIZE, SplitCuts
from gridloom.plans.preprocess import preprocess
from gridloom.schema import DEFAULT_REGION, TEMPERATURE, TIME, Region
from gridloom.session import stage
from gridloom.sources.runs import run_records, save_runs


@dataclass(frozen=True)
class Evaluation:
    metrics: DataFrame
    spatial: DataFrame
    difference: DataFrame
    histogram: DataFrame
    pair: DataFrame


@dataclass(frozen=True)
class Experiment:
    stats: Stats
    model: CellLines | GroupLinear
    prediction: DataFrame
    evaluation: Evaluation
    run: DataFrame
    unpaired: DataFrame


def predict(
    model, features: DataFrame, stats: Stats, kind: str = "standardized_anomalies", stats_resolution: str = "lr"
) -> DataFrame:
    """Score coarse features and restore physical units.

    By default the prediction is restored with the coarse statistics, as in the original
    flow; ``stats_resolution='hr'`` uses those of the target.
    """
    return scaler(kind).inverse(stats, model.predict(features), TEMPERATURE, stats_resolution)


def evaluate(truth: DataFrame, prediction: DataFrame, on_missing: str = "error", strict: bool = False) -> Evaluation:
    """Scores and tables; scores are of the pairs, histograms of each whole series, with or without a partner."""
    pair = pair_samples(truth, prediction, strict=strict)
    series = truth.select(F.col(TEMPERATURE).alias("y_true")).unionByName(
        prediction.select(F.col(TEMPERATURE).alias("y_pred")), allowMissingColumns=True
    )
    return Evaluation(
        metrics=metrics(pair, on_missing=on_missing),
        spatial=spatial_comparison(truth, prediction, both_extents=True),
        difference=difference_map(truth, prediction),
        histogram=histogram(series, {"actual": "y_true", "predicted": "y_pred"}),
        pair=pair,
    )


def train_and_evaluate(
    lr: DataFrame,
    hr: DataFrame,
    stats: Stats,
    setup: dict,
    run_id: str,
    kind: str = "standardized_anomalies",
    stats_resolution: str = "lr",
    result_path: str | None = None,
    on_missing: str = "error",
    fitter: LineFitter | LossFitter = LineFitter(),  # noqa: B008
    strict: bool = False,
) -> Experiment:
    """Fit on the training split, score the test split.

    ``lr`` and ``hr`` are normalised and carry a ``split`` column.  The paired samples are the
    one large join; they are staged and serve the fit and the losses.  The ``fitter`` says which
    features take part and whether the setup's loss is fitted; ``strict`` raises on cells without a partner.
    """
    paired = pair_features(lr, hr, fitter.features, "label", on=("split", TIME), strict=strict)
    samples = stage(paired, "samples")
    model = fitter.fit(samples.where("split = 'train'"), setup)

    # Losses on the normalised values the model was fitted on, train and validation in one pass.
    fitted = model.predict(samples.where("split <> 'test'"), "y_pred", keep=["split", "label"])
    known = fitted.withColumnRenamed("label", "y_true").where("y_true IS NOT NULL AND y_pred IS NOT NULL")
    loss_name = setup.get("loss_type") or "mae"
    by_split = losses(known, ["split"])
    both = [F.max(F.when(F.col("split") == s, F.col(loss_name))).alias(s) for s in ("train", "val")]
    loss = by_split.agg(F.struct(*both).alias("loss")).scalar()

    prediction = stage(predict(model, lr.where("split = 'test'"), stats, kind, stats_resolution), "prediction")
    truth = scaler(kind).inverse(stats, hr.where("split = 'test'").drop("split"), TEMPERATURE, "hr")
    evaluation = evaluate(truth, prediction, on_missing, strict)
    setup = {"normalization_type": kind, **setup}
    run = run_records(evaluation.metrics, F.lit(run_id), setup, F.array(loss["train"]), F.array(loss["val"]))
    if result_path is not None:
        save_runs(run, result_path)
    return Experiment(stats, model, prediction, evaluation, run, unpaired_times(lr, hr))


def run_experiment(
    lr: DataFrame,
    hr: DataFrame,
    lr_static: DataFrame,
    hr_static: DataFrame,
    setup: dict,
    run_id: str,
    kind: str = "standardized_anomalies",
    region: Region | Sequence[float] | None = DEFAULT_REGION,
    times: Sequence[str] = ("12:00",),
    divisible_factor: int = 32,
    test_size: float | int = TEST_SIZE,
    fit_on: str = "train",
    label_from: str = "own",
    stats_resolution: str = "lr",
    stats_path: str | None = None,
    result_path: str | None = None,
    on_missing: str = "error",
    fitter: LineFitter | LossFitter = LineFitter(),  # noqa: B008
    strict: bool = False,
    regridding: str = "time",
) -> Experiment:
    """Split the raw time axes first, fit statistics on the training range only.

    Coarse and fine grids are cut on their own times unless ``label_from='hr'``.  Static fields
    belong to every split.  ``fit_on='all'`` is the older flow that normalises everything.
    ``fitter`` and ``strict`` as in ``train_and_evaluate``, ``regridding`` as in ``align``.
    """
    hr_cuts = SplitCuts.of(hr, test_size)
    lr_cuts = hr_cuts if label_from == "hr" else SplitCuts.of(lr, test_size)
    only_train = fit_on == "train"
    done = preprocess(
        lr,
        hr,
        lr_static,
        hr_static,
        kind=kind,
        stats_path=stats_path,
        region=region,
        times=times,
        divisible_factor=divisible_factor,
        fit_lr=lr_cuts.where("train") if only_train else None,
        fit_hr=hr_cuts.where("train") if only_train else None,
        regridding=regridding,
    )
    return train_and_evaluate(
        done.lr.withColumn("split", lr_cuts.label()),
        done.hr.withColumn("split", hr_cuts.label()),
        done.stats,
        setup,
        run_id,
        kind,
        stats_resolution,
        result_path,
        on_missing,
        fitter,
        strict,
    )
