"""Month moments and republished months."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from gridloom.operators.moments import ClimatologyStore, merged, moments
from gridloom.operators.normalize import AnomalyScaler, Stats, cell_climatology
from gridloom.schema import GRID
from gridloom.session import scratch_path
from gridloom.streaming import land_latest_months
from pyspark.sql import functions as F
from test_plans import plan


def noise(d, y, x):
    return None if d % 11 == 3 else 270 + 9 * float(np.sin(d * 1.7 + y * 3 + x * 5))


@pytest.fixture(scope="module")
def archive(make_grid):
    return make_grid([44.0, 44.05, 44.1], [8.0, 8.05], 150, noise)


def climatology(grid):
    return {(r.latitude, r.longitude): (r.mu, r.sigma) for r in cell_climatology(grid, "t2m", "x").collect()}


def stored(store, months=None):
    return {(r.latitude, r.longitude): (r.mu, r.sigma) for r in store.cells("t2m", "x", months).collect()}


def close(a, b):
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)


@pytest.fixture
def store(spark):
    return ClimatologyStore(spark, scratch_path(spark, "moments"))


def test_merged_months_equal_a_new_fit(store, archive, spark):
    early, late = archive.where("month(time) <= 2"), archive.where("month(time) > 2")
    store.land(early, ["t2m"])
    close(stored(store), climatology(early))
    store.land(late, ["t2m"])
    close(stored(store), climatology(archive))
    store.land(late, ["t2m"])
    close(stored(store), climatology(archive))
    march = 14 * 12 + 2
    store.land(archive.where("month(time) = 3").withColumn("t2m", F.col("t2m") * 2), ["t2m"])
    close(stored(store), climatology(archive.withColumn("t2m", F.expr("CASE WHEN month(time) = 3 THEN 2 * t2m ELSE t2m END"))))
    close(stored(store, F.col("part_idx") != march), climatology(archive.where("month(time) <> 3")))
    store.remove([march])
    close(stored(store), climatology(archive.where("month(time) <> 3")))
    row = store.scalars(["t2m"], "lr_").first()
    wanted = archive.where("month(time) <> 3").agg(F.avg("t2m"), F.stddev_pop("t2m"), F.min("t2m"), F.max("t2m")).first()
    assert row.data_name == "lr_t2m" and list(row)[1:] == pytest.approx(list(wanted), rel=1e-9)


def test_statistics_of_a_store_scale_a_grid(store, archive, spark):
    store.land(archive, ["t2m"])
    a, b = (AnomalyScaler().apply_temperature(s, archive, "lr") for s in (
        store.into(Stats.empty(spark), "t2m", "lr_t2m"), Stats.empty(spark).with_cells(cell_climatology(archive, "t2m", "lr_t2m"), "lr_t2m")))
    total = lambda g: g.agg(F.sum(F.abs("t2m"))).first()[0]
    assert total(a) == pytest.approx(total(b), rel=1e-9)


def test_only_stored_rows_are_read(store, archive):
    store.land(archive, ["t2m"])
    text = plan(store.cells("t2m", "x"))
    assert "moments" in text and "time" not in text.split("ReadSchema")[-1]
    assert moments(archive, ["t2m"]).count() == 6 and merged(store.parts()).count() == 6


def month_file(spark, root, name, month, value, part=None):
    rows = [(datetime(2020, month, 1, 12) + timedelta(days=i), 44.0, 8.0, value + i) for i in range(3)]
    spark.createDataFrame(rows, GRID).coalesce(1).write.parquet(f"{root}/{name}")


def test_a_republished_month_replaces_the_first(spark):
    root, target, checkpoint, path = (scratch_path(spark, n) for n in ("pub", "landed", "check", "moments"))
    store = ClimatologyStore(spark, path)
    land = lambda: land_latest_months(spark, root, target, checkpoint, climatology=store)
    month_file(spark, root, "a1", 1, 100.0)
    month_file(spark, root, "a2", 2, 200.0)
    month_file(spark, root, "b1", 1, 110.0)  # two files of one month arrive together: the newer counts
    land()
    values = lambda: sorted(r.t2m for r in spark.read.parquet(target).collect())
    assert values() == [110, 111, 112, 200, 201, 202]
    month_file(spark, root, "c2", 2, 250.0)
    land()
    land()
    assert values() == [110, 111, 112, 250, 251, 252]
    assert spark.read.schema(GRID).parquet(target).count() == 6
    found = store.cells("t2m", "x").first()
    assert found.mu == pytest.approx((111 + 251) / 2)
