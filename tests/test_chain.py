"""Convolutions in a row with one exchange."""

import pytest
from gridloom.operators import raster as ra
from gridloom.operators.axes import GridAxes
from pyspark.sql import functions as F

FIRST = [[0.5, 1.0, -0.25], [2.0, 3.0, 1.5], [-1.0, 0.75, 0.125]]
SECOND = [[0.0, 0.5, 0.0], [0.25, 1.0, -0.5], [0.0, 0.125, 0.0]]


@pytest.fixture(scope="module", params=["complete", "holes"])
def grid(request, make_grid):
    drop = (lambda d, y, x: (round(y * 10) * 7 + round(x * 10) + d) % 23 == 0) if request.param == "holes" else (lambda d, y, x: False)
    lats, lons = [44.0 + i / 10 for i in range(11)], [8.0 + i / 10 for i in range(5)]
    return make_grid(lats, lons, 2, lambda d, y, x: None if request.param == "holes" and (d, x) == (1, 8.2) else y * d + x, drop=drop)


@pytest.mark.parametrize("on_missing", ra.MISSING)
@pytest.mark.parametrize("band_rows", [2, 3, 64])
def test_equals_calls_in_a_row(grid, as_values, monkeypatch, on_missing, band_rows):
    monkeypatch.setattr(ra, "BAND_ROWS", band_rows)
    axes = GridAxes.of(grid)
    steps = [ra.Stencil({"t2m": FIRST}, 0.5, "tanh"), ra.Stencil({"t2m": SECOND}, -2.0), ra.Stencil({"t2m": SECOND})]
    chained = as_values(ra.convolve_chain(grid, steps, "t2m", axes, on_missing))
    one = ra.activate(ra.convolve(grid, {"t2m": FIRST}, "t2m", 0.5, axes, on_missing))
    two = ra.convolve(one, {"t2m": SECOND}, "t2m", -2.0, axes, on_missing)
    wanted = as_values(ra.convolve(two, {"t2m": SECOND}, "t2m", 0.0, axes, on_missing))
    assert chained.keys() == wanted.keys() and len(chained) == grid.count()
    assert all((chained[k] is None) == (v is None) and (v is None or chained[k] == pytest.approx(v)) for k, v in wanted.items())


def test_one_exchange(grid):
    axes = GridAxes.of(grid)
    steps = [ra.Stencil({"t2m": FIRST}), ra.Stencil({"t2m": SECOND})]
    plan = ra.convolve_chain(grid, steps, "t2m", axes)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(time" in line for line in plan.splitlines()) == 1


def test_steps_are_checked(grid):
    with pytest.raises(ValueError, match="kernel"):
        ra.convolve_chain(grid, [], "t2m")
    with pytest.raises(ValueError, match="kernel"):
        ra.convolve_chain(grid.withColumn("z", F.lit(1.0)), [ra.Stencil({"t2m": FIRST}), ra.Stencil({"z": FIRST})], "t2m")
