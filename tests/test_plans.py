"""The physical plans that the operators are meant to have."""

import re

import pytest
from gridloom.operators import normalize as nz
from gridloom.operators.align import pair_samples
from gridloom.operators.axes import GridAxes
from gridloom.operators.raster import convolve
from gridloom.operators.regrid import densify, regrid, reindex
from gridloom.operators.select import at_times, crop_spatial
from gridloom.operators.split import SplitCuts
from gridloom.operators.tiles import to_tiles
from gridloom.session import scratch_path, stage
from gridloom.sources import grids as gr, tables as tb


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main_part(text: str) -> str:
    """The plan without its subqueries, which only touch axis and statistics tables."""
    return "\n".join(line for line in text.splitlines() if not re.match(r"^[\s:]*:", line))


@pytest.fixture(scope="module")
def fine(spark, sf_dir):
    return stage(tb.grid_hr(spark, sf_dir), "fine")


@pytest.fixture(scope="module")
def coarse(spark, sf_dir):
    return stage(tb.grid_lr(spark, sf_dir), "coarse")


@pytest.fixture(scope="module")
def axes(fine):
    return GridAxes.of(fine)


def exchanges(text: str) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)


def test_regrid_shuffles_points_never_cells(coarse, axes):
    text = main_part(plan(regrid(coarse, axes, ["t2m"])))
    keys = exchanges(text)
    # Once to merge copies of a point, once to bring a timestep together; both below the first
    # step that multiplies rows.
    assert len(keys) == 2
    assert re.match(r"time#\d+, 8$", keys[0])
    assert text.index("Generate") < text.index("Exchange hashpartitioning")
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_lane_clustering_splits_one_timestep(coarse, axes):
    keys = exchanges(main_part(plan(regrid(coarse, axes, ["t2m"], cluster="lane"))))
    assert [k.count("#") for k in keys[:2]] == [2, 2]


@pytest.mark.parametrize("op", [reindex, lambda g, a, v: densify(g, v, a)])
def test_dense_results_without_cross_join(coarse, axes, op):
    text = plan(op(coarse, axes, ["t2m"]))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_tiles_reuse_the_time_clustering(coarse, axes):
    assert len(exchanges(main_part(plan(to_tiles(coarse, ["t2m"], axes))))) == 2


def test_convolution_shuffles_cells_once(fine, axes):
    text = main_part(plan(convolve(fine, {"t2m": [[1, 1, 1]] * 3}, axes=axes)))
    assert len(exchanges(text)) == 1
    assert text.index("Generate inline") < text.index("Exchange hashpartitioning")


def test_anomalies_do_not_shuffle_the_grid(spark, fine):
    _, hr, _ = nz.normalize_temperature("standardized_anomalies", nz.Stats.empty(spark), fine, fine)
    text = plan(hr)
    assert "BroadcastHashJoin" in text and not exchanges(text)


def test_crop_bounds_reach_the_scan(fine):
    text = plan(crop_spatial(fine, (8.0, 44.05, 8.45, 44.5), 4))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "GreaterThanOrEqual(latitude" in pushed and "LessThanOrEqual(longitude" in pushed


def test_split_is_a_pushed_range_even_through_regridding(coarse, axes):
    cuts = SplitCuts.of(coarse)
    text = plan(regrid(coarse, axes, ["t2m"]).where(cuts.where("val")))
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line and "t2m" in line)
    assert "GreaterThanOrEqual(time" in scan and "LessThan(time" in scan


def test_time_of_day_prunes_directories(spark, fine):
    path = scratch_path(spark, "pruned")
    gr.store_dataset(fine, "fine", path)
    noon = at_times(gr.load_dataset(spark, "fine", path))
    assert re.search(r"PartitionFilters: \[[^\]]*hhmm#\d+ = 1200", plan(noon))
    assert "ReadSchema: struct<time:timestamp_ntz,latitude:double,longitude:double,t2m:double>" in plan(noon)
    assert noon.count() == at_times(fine).count()


def test_pairing_reuses_the_time_clustering(spark, fine, coarse, axes):
    # Sizes as on a cluster: neither side is small enough to broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = main_part(plan(pair_samples(fine, regrid(coarse, axes, ["t2m"]))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text
    # Between the join and the regridded cells there is a sort, but no further shuffle.
    assert len(exchanges(text)) == 2
    assert text.index("Generate") < text.index("Exchange hashpartitioning")


def test_global_statistics_are_one_aggregate(spark, sf_dir):
    text = plan(nz.global_stats(tb.static_lr(spark, sf_dir), ["lsm", "z"], "lr_"))
    assert text.count("FileScan") == 1
