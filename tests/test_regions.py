"""Archives whose files are chosen by time and place."""

from datetime import timedelta

import pytest
from grids import START
from gridloom.schema import GRID
from gridloom.session import Files, scratch_path
from gridloom.sources.regions import RegionArchive, hilbert
from pyspark.sql import functions as F

LATS, LONS = [44 + 0.25 * i for i in range(16)], [8 + 0.25 * i for i in range(16)]
BOX = (8.5, 44.25, 9.0, 44.75)


@pytest.fixture(scope="module")
def grid(make_grid):
    return make_grid(LATS, LONS, 40, lambda d, y, x: d + y + x)


@pytest.fixture(scope="module")
def archive(spark, grid):
    out = RegionArchive(spark, scratch_path(spark, "regions"), rows_a_file=400)
    assert out.write(grid) == 0
    return out


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b.select(a.columns)).isEmpty()


def boxed(grid):
    return grid.where(F.col("longitude").between(BOX[0], BOX[2]) & F.col("latitude").between(BOX[1], BOX[3]))


def test_the_curve_visits_every_square_by_steps_to_neighbours(spark):
    squares = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    walk = squares.withColumn("d", hilbert(F.col("x"), F.col("y"), 4)).orderBy("d").collect()
    assert [r.d for r in walk] == list(range(256))
    assert (walk[0].x, walk[0].y) == (0, 0)
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(walk[:-1], walk[1:], strict=True))


def test_region_and_range(archive, grid):
    first, last = START + timedelta(days=3), START + timedelta(days=20)
    wanted = boxed(grid).where(F.col("time").between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))
    assert wanted.count() == 3 * 3 * 18
    assert same(archive.read(BOX, first, last), wanted)
    assert same(archive.read(BOX), boxed(grid))
    assert same(archive.read(), grid)


def test_only_files_that_touch_the_box_are_read(archive):
    every, few = archive.manifest(), archive.files(BOX)
    assert every.agg(F.sum("n")).first()[0] == 16 * 16 * 40
    assert few.count() * 4 <= every.count()
    read = archive.read(BOX).inputFiles()
    assert len(read) == few.count() and {r.rsplit("/", 1)[1] for r in read} == {r.file for r in few.select("file").collect()}
    plan = archive.read(BOX)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThanOrEqual(latitude" in plan


def test_appending_replacing_and_old_versions(spark, grid):
    out = RegionArchive(spark, scratch_path(spark, "regions"), rows_a_file=2000)
    early = grid.where(F.dayofmonth("time") < 10)
    late = grid.where(F.dayofmonth("time") >= 10)
    out.write(early)
    assert out.write(late, append=True) == 1
    assert same(out.read(), grid) and same(out.read(version=0), early) and same(out.read(BOX, version=0), boxed(early))
    # Rewritten from itself while it is read.
    assert out.write(out.read().withColumn("t2m", F.col("t2m") + 1)) == 2
    assert same(out.read(), grid.withColumn("t2m", F.col("t2m") + 1))
    assert out.clean(keep=1) == [0, 1]
    assert len(Files(spark).names(f"{out.path}/data")) == 1 and same(out.read(BOX), boxed(grid).withColumn("t2m", F.col("t2m") + 1))
    with pytest.raises(ValueError, match="has no version 0"):
        out.read(version=0)
    with pytest.raises(ValueError, match="columns"):
        out.write(grid.withColumnRenamed("t2m", "z"), append=True)


def test_missing_keys_and_empty_grids(spark, archive):
    odd = [(None, 44.0, 8.5, 1.0), (START, None, 8.5, 2.0), (START, 44.5, float("nan"), 3.0), (START, 44.5, 8.75, None), (START, 44.5, 8.75, None)]
    out = RegionArchive(spark, scratch_path(spark, "regions"))
    out.write(spark.createDataFrame(odd, GRID))
    assert out.read().count() == 5
    assert [tuple(r) for r in out.read(BOX).collect()] == [(START, 44.5, 8.75, None)] * 2
    assert out.read(first=START).count() == 4
    none = RegionArchive(spark, scratch_path(spark, "regions"))
    with pytest.raises(ValueError, match="has no version"):
        none.read()
    none.write(spark.createDataFrame([], GRID))
    assert none.read().isEmpty() and none.read(BOX).isEmpty() and none.read(BOX).schema.names == GRID.names
