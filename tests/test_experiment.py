import math
from datetime import timedelta

import pytest
from grids import START
from gridloom.operators.normalize import Stats
from gridloom.operators.split import SplitCuts
from gridloom.plans.experiment import run_experiment
from gridloom.plans.preprocess import preprocess
from gridloom.session import scratch_path
from gridloom.sources.runs import leaderboard, load_runs
from pyspark.sql import functions as F

FINE = ([44 + 0.05 * i for i in range(8)], [8 + 0.05 * i for i in range(8)])
COARSE = ([44 + 0.1 * i for i in range(4)], [8 + 0.1 * i for i in range(4)])
DAYS = 40
SETUP = {"loss_type": "mae", "batch_size": 4}
OPTIONS = {"region": None, "divisible_factor": 4}


def weather(d, y, x):
    return 280 + 8 * math.sin(d / 3) + 2 * (y - 44) + (x - 8) * math.cos(d)


@pytest.fixture(scope="module")
def inputs(make_grid):
    static = lambda axes, second: (
        make_grid(*axes, 1, lambda d, y, x: y - 44).withColumnRenamed("t2m", "lsm").withColumn(second, F.col("longitude") * 9)
    )
    return (
        make_grid(*COARSE, DAYS, weather),
        make_grid(*FINE, DAYS, lambda d, y, x: 1.1 * weather(d, y, x) + 3),
        static(COARSE, "z"),
        static(FINE, "orog"),
    )


def stats_of(stats: Stats):
    cells = {(r.data_name, round(r.latitude, 4), round(r.longitude, 4)): (r.mu, r.sigma) for r in stats.cells.collect()}
    scalars = {r.data_name: (r.mu, r.sigma, r.xmin, r.xmax) for r in stats.scalars.collect()}
    return cells, scalars


def test_preprocessed_grids_agree(inputs):
    done = preprocess(*inputs, **OPTIONS)
    assert done.lr.columns == ["time", "latitude", "longitude", "t2m", "lsm", "z"]
    assert done.lr.count() == done.hr.count() == DAYS * 64
    assert done.lr.where("t2m IS NULL OR lsm IS NULL OR z IS NULL").count() == 0
    assert done.stats.names == {"lr_t2m", "hr_t2m", "lr_lsm", "lr_z"}


@pytest.mark.parametrize("kind", ["standardized_anomalies", "min_max"])
def test_held_out_values_do_not_reach_the_statistics(inputs, kind):
    lr, hr, lr_static, hr_static = inputs
    cut = SplitCuts.of(hr).first_val
    later = F.col("time") >= F.lit(str(cut)).cast("timestamp_ntz")
    spoiled = [g.withColumn("t2m", F.when(later, F.col("t2m") + 500).otherwise(F.col("t2m"))) for g in (lr, hr)]
    clean = run_experiment(lr, hr, lr_static, hr_static, SETUP, "clean", kind, **OPTIONS)
    dirty = run_experiment(*spoiled, lr_static, hr_static, SETUP, "dirty", kind, **OPTIONS)
    assert stats_of(clean.stats) == stats_of(dirty.stats)
    lines = [e.model.table.orderBy("latitude", "longitude").collect() for e in (clean, dirty)]
    assert lines[0] == lines[1]
    leaked = run_experiment(*spoiled, lr_static, hr_static, SETUP, "all", kind, fit_on="all", **OPTIONS)
    assert stats_of(leaked.stats) != stats_of(dirty.stats)


def test_linear_relation_is_learned_and_saved(spark, inputs):
    path = scratch_path(spark, "results")
    done = run_experiment(*inputs, SETUP, "sa_1", stats_resolution="hr", result_path=path, **OPTIONS)
    score = done.evaluation.metrics.first()
    assert score.rmse < 0.5 and score.n == 5 * 64
    assert done.evaluation.spatial.count() == done.evaluation.difference.count() == 64
    assert done.evaluation.histogram.count() == 100
    assert done.unpaired.count() == 0
    best = leaderboard(load_runs(spark, path)).first()
    assert (best.run_id, best.rmse) == ("sa_1", pytest.approx(score.rmse))
    run = load_runs(spark, path).first()
    assert len(run.training_history.training_loss) == len(run.training_history.validation_loss) == 1
    assert run.training_history.training_loss[0] < 0.1


def test_restoring_with_coarse_statistics_is_the_default(inputs):
    done = run_experiment(*inputs, SETUP, "sa_2", **OPTIONS)
    # The fine values are 1.1 times the coarse ones plus 3: restored with coarse statistics
    # the prediction misses by that much.
    assert done.evaluation.metrics.first().mae == pytest.approx(31, abs=2)


def test_reused_statistics_and_common_labels(inputs):
    lr, hr, lr_static, hr_static = inputs
    first = preprocess(*inputs, **OPTIONS)
    shifted = hr.withColumn("t2m", F.col("t2m") + 10)
    again = preprocess(lr, shifted, lr_static, hr_static, stats=first.stats, fit=False, **OPTIONS)
    moved = again.hr.agg(F.avg("t2m")).first()[0] - first.hr.agg(F.avg("t2m")).first()[0]
    assert moved > 0.5
    short = lr.where(F.col("time") < F.lit(str(START + timedelta(days=30))).cast("timestamp_ntz"))
    common = run_experiment(short, hr, lr_static, hr_static, SETUP, "hr", label_from="hr", on_missing="skip", **OPTIONS)
    assert common.unpaired.select("only_in").distinct().collect()[0].only_in == "hr"


def test_statistics_must_exist_without_fit(inputs):
    with pytest.raises(ValueError, match="no fitted statistics"):
        preprocess(*inputs, fit=False, **OPTIONS)
