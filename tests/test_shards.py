"""Batches as files: order, one batch a shard, resuming."""

import pytest
from gridloom.operators.axes import GridAxes
from gridloom.operators.split import assign_batches
from gridloom.session import Files, scratch_path
from gridloom.sources.shards import BatchShards
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def samples(make_grid):
    grid = make_grid([44.0, 44.1, 44.2], [8.0, 8.1], 7, lambda d, y, x: d + y, drop=lambda d, y, x: d == 3 and x == 8.0)
    return grid.withColumn("label", F.col("t2m") * 2)


@pytest.fixture(scope="module")
def shards(spark, samples):
    out = BatchShards(spark, scratch_path(spark, "shards"), size=2)
    assert out.write(samples, ["t2m", "label"], 3, epochs=2, seed=9) == [0, 1]
    return out


def test_shards_hold_the_assigned_batches(samples, shards):
    wanted = {(r.epoch, r.time): (r.batch_id, r.position) for r in assign_batches(samples, 3, 2, 9).collect()}
    for epoch in (0, 1):
        rows = shards.read(epoch).select("time", "batch_id", "position").distinct().collect()
        assert {(epoch, r.time): (r.batch_id, r.position) for r in rows} == {k: v for k, v in wanted.items() if k[0] == epoch}
        assert [(r.batch_id, r.n_times, r.n_tiles, r.first_position) for r in shards.manifest(epoch).orderBy("batch_id").collect()] == [
            (0, 3, 6, 0), (1, 3, 6, 3), (2, 1, 2, 6)]


def test_cells_come_back(samples, shards):
    back = shards.cells(shards.read(1), ["t2m", "label"], GridAxes.of(samples)).drop("batch_id", "position")
    assert back.count() == samples.count() and back.exceptAll(samples.select(back.columns)).isEmpty()


def test_resuming(shards):
    seen = [(e, b) for e, b, _ in shards.batches(0, 2)]
    assert seen == [(0, 2), (1, 0), (1, 1), (1, 2)]
    _, _, tiles = next(shards.batches(1, 1))
    assert {r.batch_id for r in tiles.select("batch_id").collect()} == {1}
    plan = shards.read(0, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "batch_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.batch_id for r in shards.read(0, 2).select("batch_id").distinct().collect()} == {2}


def test_an_unfinished_epoch_is_written_again(spark, samples):
    out = BatchShards(spark, scratch_path(spark, "shards"), size=2)
    out.write(samples, ["t2m", "label"], 3, seed=9)
    Files(spark).delete(f"{out.path}/manifest/epoch-000000/_SUCCESS")
    assert out.epochs() == []
    with pytest.raises(ValueError, match="no finished epoch"):
        out.read(0)
    assert out.write(samples, ["t2m", "label"], 3, epochs=2, seed=9) == [0, 1]
    assert out.write(samples, ["t2m", "label"], 3, epochs=2, seed=9) == []
    assert out.read(0).select("time").distinct().count() == 7
