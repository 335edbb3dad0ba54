"""Snapshots under readers, and scratch folders that a run leaves empty."""

import pytest
from gridloom.operators.axes import GridAxes
from gridloom.operators.regrid import regrid
from gridloom.session import Files, scratch_path, scratch_root, scratch_run
from gridloom.sources.snapshots import ConcurrentWrite, SnapshotTable


@pytest.fixture
def table(spark):
    return SnapshotTable(spark, scratch_path(spark, "snapshots"))


def test_a_reader_keeps_its_snapshot(spark, table):
    table.write(spark.range(10))
    held = table.read()
    table.write(spark.range(10, 30))
    assert held.count() == 10 and table.read().count() == 20 and table.read(0).count() == 10
    assert table.versions() == [0, 1]


def test_overwriting_from_itself(spark, table):
    table.write(spark.range(10).selectExpr("id", "id % 2 AS part"), "part")
    for _ in range(3):
        table.write(table.read().selectExpr("id + 1 AS id", "part"), "part")
    assert sorted(r.id for r in table.read().collect()) == list(range(3, 13))
    assert table.clean(keep=1) == [0, 1, 2] and table.versions() == [3]
    assert len(Files(spark).names(f"{table.path}/data")) == 1 and table.read().count() == 10


def test_the_second_of_two_writers_fails(spark, table, monkeypatch):
    table.write(spark.range(1))
    stale = table.versions()
    table.write(spark.range(2))
    real = SnapshotTable.versions
    monkeypatch.setattr(SnapshotTable, "versions", lambda self: stale)
    with pytest.raises(ConcurrentWrite):
        table.write(spark.range(3))
    monkeypatch.setattr(SnapshotTable, "versions", real)
    assert table.read().count() == 2 and len(Files(spark).names(f"{table.path}/data")) == 2
    assert all(n.isdigit() for n in Files(spark).names(f"{table.path}/manifest") if not n.endswith(".crc"))


def test_missing_snapshots(table):
    with pytest.raises(ValueError, match="no snapshot"):
        table.read()
    with pytest.raises(ValueError, match="always kept"):
        table.clean(keep=0)


def test_scratch_is_empty_after_a_run(spark, make_grid):
    coarse, fine = (make_grid([44.0, 44.1], [8.0, 8.1], 2, lambda d, y, x: y), make_grid([44.0, 44.05, 44.1], [8.0, 8.1], 1, lambda d, y, x: y))
    before = Files(spark).names(scratch_root(spark))
    with scratch_run(spark) as folder:
        assert regrid(coarse, GridAxes.of(fine), ["t2m"]).count() == 12
        assert folder.startswith(scratch_root(spark)) and Files(spark).names(folder)
        with scratch_run(spark) as inner:
            GridAxes.of(fine)
            assert inner.startswith(folder)
        assert Files(spark).names(inner) == []
    assert Files(spark).names(folder) == [] and Files(spark).names(scratch_root(spark)) == before
    with pytest.raises(RuntimeError), scratch_run(spark) as folder:
        GridAxes.of(fine)
        raise RuntimeError("cut short")
    assert Files(spark).names(folder) == []
