"""Regridding by weights gives the rows of the walk; whole timesteps gather no lanes."""

import re

import pytest
from gridloom.operators.axes import GridAxes
from gridloom.operators.regrid import regrid
from gridloom.operators.weights import WeightTable, regrid_by_weights
from test_plans import plan

FINE = ([44 + 0.05 * i for i in range(11)], [8 + 0.05 * i for i in range(9)])
COARSE = ([43.9 + 0.1 * i for i in range(7)], [8.1 + 0.15 * i for i in range(3)])


def bumpy(d, y, x):
    return 100.0 * d + (y * 7) ** 2 + (x * 5) ** 3


@pytest.fixture(scope="module")
def fine(make_grid):
    return GridAxes.of(make_grid(*FINE, 1, bumpy))


def same(a, b):
    key = lambda r: (r.time, round(r.latitude, 4), round(r.longitude, 4))
    left, right = ({key(r): r[3:] for r in df.collect()} for df in (a, b))
    assert left.keys() == right.keys() and len(left) == a.count()
    for k, values in left.items():
        assert all((u is None and v is None) or u == pytest.approx(v, abs=1e-7) for u, v in zip(values, right[k], strict=True))


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_whole_and_holey_steps_are_those_of_the_walk(make_grid, fine, method):
    hole = lambda d, y, x: (d == 1 and abs(y - 44.1) < 1e-6) or (d == 2 and x > 8.2) or (d == 3 and y >= 44)
    coarse = make_grid(*COARSE, 6, lambda d, y, x: None if d == 4 and abs(x - 8.25) < 1e-6 else bumpy(d, y, x), drop=hole)
    weights = WeightTable.of(GridAxes.of(coarse), fine, method)
    same(regrid_by_weights(coarse, weights, ["t2m"]), regrid(coarse, fine, ["t2m"], method))


def test_several_variables(make_grid, fine):
    coarse = make_grid(*COARSE, 2, bumpy).selectExpr("*", "t2m * 2 + latitude AS z", "CASE WHEN longitude < 8.2 THEN NULL ELSE t2m END AS gap")
    weights = WeightTable.of(GridAxes.of(coarse), fine)
    same(regrid_by_weights(coarse, weights, ["t2m", "z", "gap"]), regrid(coarse, fine, ["t2m", "z", "gap"]))


@pytest.mark.parametrize("coarse", [([44.1], [8.1]), ([44.1], [8.1, 8.3]), ([43.0, 43.5], [8.1, 8.3]), ([44.1, 44.4], [7.0])])
def test_thin_source_axes(make_grid, fine, coarse):
    grid = make_grid(*coarse, 2, bumpy)
    same(regrid_by_weights(grid, WeightTable.of(GridAxes.of(grid), fine), ["t2m"]), regrid(grid, fine, ["t2m"]))


def test_weights_of_a_position_add_up_to_one(make_grid, fine):
    table = WeightTable.of(GridAxes.of(make_grid(*COARSE, 1, bumpy)), fine)
    sums = table.table.groupBy("dim", "idx").sum("weight").collect()
    assert len(sums) == 20 and all(r[2] == pytest.approx(1) for r in sums)
    assert table.known == {"latitude": 6, "longitude": 3} and sum(table.rows.values()) == table.table.count()


def test_whole_steps_gather_no_lane(make_grid, fine):
    coarse = make_grid(*COARSE, 3, bumpy)
    weights = WeightTable.of(GridAxes.of(coarse), fine)
    found = regrid_by_weights(coarse, weights, ["t2m"], complete=True)
    text = plan(found).split("Subqueries")[0]
    assert "Generate" not in text and not re.search(r"collect_list\(if", text)
    # Copies of a point are merged, then timesteps brought together; the sums need no more.
    assert len(re.findall(r"Exchange hashpartitioning\((time#[^)]*)\)", text)) == 2
    same(found, regrid(coarse, fine, ["t2m"]))


def test_claimed_completeness_is_checked(make_grid, fine):
    coarse = make_grid(*COARSE, 3, bumpy, drop=lambda d, y, x: d == 1 and y > 44.3)
    weights = WeightTable.of(GridAxes.of(make_grid(*COARSE, 1, bumpy)), fine)
    with pytest.raises(Exception, match="lacks points"):
        regrid_by_weights(coarse, weights, ["t2m"], complete=True).collect()
    with pytest.raises(ValueError, match="reindex"):
        regrid_by_weights(coarse, WeightTable.of(GridAxes.of(coarse), fine, "none"), ["t2m"])
