import json
from datetime import datetime
from pathlib import Path

import pytest
from gridloom.operators.select import at_times
from gridloom.session import scratch_path
from gridloom.sources import catalog as cat, grids as gr, runs as rn
from gridloom.streaming import land_months
from pyspark.sql import functions as F


def value(d, y, x):
    return 280.0 + d + y - x


@pytest.fixture(scope="module")
def grid(make_grid):
    return make_grid([44.0, 44.05], [8.0, 8.05], 70, value)


def test_published_months(spark):
    files = {p: cat.parse_catalog(cat.month_files(spark, p, "base/")) for p in cat.MONTHS}
    assert {p: f.count() for p, f in files.items()} == {"era5": 192, "cerra": 186}
    both = files["era5"].union(files["cerra"])
    assert cat.missing_months(both).count() == 0
    small = cat.index_months(cat.select_months(both)).orderBy("product", "part_idx").collect()
    assert [(r.product, r.yyyymm, r.part_idx) for r in small[:2]] == [("cerra", "200605", 0), ("cerra", "200606", 1)]
    assert {r.resolution for r in small} == {0.05, 0.25}
    holed = both.where("NOT (product = 'era5' AND yyyymm = '201003')")
    assert [tuple(r) for r in cat.missing_months(holed).collect()] == [("era5", "201003")]
    with pytest.raises(ValueError, match="unknown product"):
        cat.month_files(spark, "merra", "base")


def test_static_file_names(spark):
    rows = [(f"x/{n}.parquet",) for n in [*cat.STATIC_FILE.values(), "readme"]]
    parsed = cat.parse_catalog(spark.createDataFrame(rows, "url string")).collect()
    assert {(r.product, r.kind) for r in parsed} == {("era5", "lsm_geop"), ("cerra", "lsm_orog")}


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_month_files_in_any_format(spark, grid, fmt):
    paths = []
    for month in (1, 2):
        paths.append(scratch_path(spark, f"m{month}"))
        grid.where(F.month("time") == month).write.format(fmt).save(paths[-1])
    assert gr.read_months(spark, paths, fmt=fmt).exceptAll(grid.where(F.month("time") < 3)).count() == 0


def test_round_trips(spark, grid):
    path = scratch_path(spark, "sets")
    gr.store_dataset(grid, "a", path)
    back = gr.load_dataset(spark, "a", path)
    assert back.drop("hhmm", "year").exceptAll(grid).count() == 0
    assert at_times(back).count() == grid.count() and at_times(back, ["06:00"]).count() == 0
    first = (datetime(2020, 1, 1).year * 12 + 1) - (2006 * 12 + 1)
    parts = gr.store_parts(grid, scratch_path(spark, "parts"))
    assert gr.read_parts(spark, parts, first, first + 1).count() == 31 * 4


def test_streaming_lands_each_file_once(spark, grid):
    source, target, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    grid.where(F.month("time") == 1).coalesce(1).write.parquet(f"{source}/1")
    land_months(spark, source, target, state)
    assert spark.read.parquet(target).count() == 31 * 4
    grid.where(F.month("time") > 1).coalesce(1).write.parquet(f"{source}/2")
    land_months(spark, source, target, state)
    land_months(spark, source, target, state)
    landed = spark.read.parquet(target)
    assert landed.drop("part_idx").exceptAll(grid).count() == 0 and landed.count() == grid.count()


def test_run_files(spark):
    path = scratch_path(spark, "runs")
    scored = spark.createDataFrame(
        [("a", 2.0, [3.0, 1.0, 2.0]), ("b", 1.0, [5.0, 4.0, 4.0])], "id string, rmse double, val array<double>"
    )
    for c in ("true_min", "true_max", "pred_min", "pred_max", "rmse_percentage_true", "mae", "mae_percentage_true"):
        scored = scored.withColumn(c, F.lit(1.0))
    runs = rn.run_records(scored, F.col("id"), {"loss_type": "mae", "filters": [8, 4]}, F.col("val"), F.col("val"))
    rn.save_runs(runs.where("run_id = 'a'"), path)
    rn.save_runs(runs.where("run_id = 'b'"), path)
    loaded = rn.load_runs(spark, path)
    assert [r.run_id for r in rn.leaderboard(loaded, 1).collect()] == ["b"]
    assert {r.run_id: r.best_epoch for r in rn.best_epochs(loaded).collect()} == {"a": 2, "b": 2}
    assert rn.training_history(loaded).where("run_id = 'a'").count() == 3
    assert loaded.select("model_setup.filters").first()[0] == [8, 4]


def test_pretty_printed_run_files(spark, tmp_path):
    record = {
        "model_setup": {"loss_type": "huber_loss", "batch_size": 4},
        "training_history": {"training_loss": [0.5, 0.25], "validation_loss": [0.6, 0.7]},
        "evaluation_metrics": {"rmse": [8.5], "mae": [7.2], "true_values_interval": [250.0, 300.0]},
    }
    Path(tmp_path, "model_and_results_demo_1.json").write_text(json.dumps(record, indent=4))
    runs = rn.load_runs(spark, str(tmp_path), multi_line=True)
    best = rn.leaderboard(runs).first()
    assert (best.run_id, best.rmse, best.rmse_percentage_true) == ("demo_1", 8.5, None)
    assert rn.best_epochs(runs).first().best_epoch == 1
