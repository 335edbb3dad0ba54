import numpy as np
import pytest
from gridloom.operators.axes import GridAxes
from gridloom.operators.regrid import densify, interpolate_gaps, regrid, reindex
from pyspark.sql import functions as F

FINE = ([44 + 0.05 * i for i in range(12)], [8 + 0.05 * i for i in range(12)])
COARSE = ([44 + 0.2 * i for i in range(3)], [8 + 0.2 * i for i in range(3)])


def plane(d, y, x):
    return 100.0 * d + 10 * y + 3 * x


@pytest.fixture(scope="module")
def axes(make_grid):
    return GridAxes.of(make_grid(*FINE, 1, plane))


@pytest.mark.parametrize("cluster", ["time", "lane"])
def test_plane_is_reproduced_with_extrapolated_edges(make_grid, axes, cluster):
    out = regrid(make_grid(*COARSE, 3, plane), axes, ["t2m"], cluster=cluster)
    rows = out.collect()
    assert len(rows) == 3 * 144
    start = min(r.time for r in rows)
    for r in rows:
        assert r.t2m == pytest.approx(plane((r.time - start).days, r.latitude, r.longitude), abs=1e-9)


def test_bilinear_against_numpy(make_grid, axes, as_values):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(3, 3))
    lookup = {(round(y, 2), round(x, 2)): float(z[i, j]) for i, y in enumerate(COARSE[0]) for j, x in enumerate(COARSE[1])}
    out = as_values(regrid(make_grid(*COARSE, 1, lambda d, y, x: lookup[(round(y, 2), round(x, 2))]), axes, ["t2m"]))

    def line(xs, ys, x):
        k = int(np.clip(np.searchsorted(xs, x, side="right") - 1, 0, len(xs) - 2))
        return ys[k] + (ys[k + 1] - ys[k]) * (x - xs[k]) / (xs[k + 1] - xs[k])

    for (_, y, x), value in out.items():
        along = [line(COARSE[1], z[i], x) for i in range(3)]
        assert value == pytest.approx(line(COARSE[0], along, y), abs=1e-9)


def test_missing_point_is_refilled(make_grid, axes):
    gap = make_grid(*COARSE, 1, lambda d, y, x: None if abs(y - 44.2) < 1e-6 and abs(x - 8.2) < 1e-6 else plane(d, y, x))
    out = regrid(gap, axes, ["t2m"])
    assert out.where("t2m IS NULL").count() == 0
    assert out.where(F.abs(F.col("t2m") - 10 * F.col("latitude") - 3 * F.col("longitude")) > 1e-9).count() == 0


def test_lone_point_stays_alone_and_result_is_dense(make_grid, axes):
    lone = make_grid([44.2], [8.2], 1, plane)
    out = regrid(lone, axes, ["t2m"])
    assert (out.count(), out.where("t2m IS NOT NULL").count()) == (144, 1)


def test_timestep_without_usable_points_is_all_null(make_grid, axes):
    far = make_grid([60.0], [8.2], 1, plane)
    out = regrid(far, axes, ["t2m"])
    assert (out.count(), out.where("t2m IS NOT NULL").count()) == (144, 0)


def test_points_off_the_axes_are_ignored_unless_asked_for(make_grid):
    inner = GridAxes.of(make_grid([44.05, 44.1, 44.15], [8.0, 8.05], 1, plane))
    bent = make_grid([44.0, 44.1, 44.2], [8.0, 8.05], 1, lambda d, y, x: (y - 44.1) ** 2 * 100)
    off = regrid(bent, inner, ["t2m"]).where("latitude = 44.05").first().t2m
    helped = regrid(bent, inner, ["t2m"], use_outside_neighbours=True)
    assert off is None
    assert helped.where("latitude = 44.05").first().t2m == pytest.approx(0.5)
    assert helped.count() == 6


def test_several_variables(make_grid, axes):
    both = make_grid(*COARSE, 1, plane).withColumn("z", F.when(F.col("latitude") > 44.1, F.col("t2m") * 2))
    out = regrid(both, axes, ["t2m", "z"], cluster="lane")
    assert out.where(F.abs(F.col("z") - 2 * F.col("t2m")) > 1e-6).count() == 0
    assert (out.count(), out.where("z IS NULL").count()) == (144, 0)


def test_duplicates_are_reported(make_grid, axes):
    twice = make_grid(*COARSE, 1, plane)
    with pytest.raises(Exception, match="several values"):
        regrid(twice.union(twice), axes, ["t2m"]).collect()


def test_unknown_method(make_grid, axes):
    with pytest.raises(ValueError, match="unsupported"):
        regrid(make_grid(*COARSE, 1, plane), axes, ["t2m"], method="cubic")


def test_reindex_keeps_exact_matches_only(make_grid, axes, as_values):
    out = as_values(reindex(make_grid(*COARSE, 2, plane), axes, ["t2m"]))
    assert len(out) == 288
    assert sum(v is not None for v in out.values()) == 18


def test_densify(make_grid):
    sparse = make_grid(*COARSE, 2, plane, drop=lambda d, y, x: d == 0 and y > 44.1)
    out = densify(sparse, ["t2m"])
    assert (out.count(), out.where("t2m IS NULL").count()) == (18, 6)


def test_gap_fill_one_axis(make_grid):
    lane = make_grid([44.0], [8.0, 8.1, 8.2, 8.4], 1, lambda d, y, x: None if x in (8.1, 8.4) else 10 * x)
    out = {round(r.longitude, 1): r.t2m for r in interpolate_gaps(lane, "longitude", "t2m").collect()}
    assert out == pytest.approx({8.0: 80.0, 8.1: 81.0, 8.2: 82.0, 8.4: 84.0})


def test_nearest_takes_lower_at_half_way(make_grid, axes, as_values):
    out = as_values(regrid(make_grid(*COARSE, 1, lambda d, y, x: x), axes, ["t2m"], method="nearest"))
    picked = {x: v for (_, y, x), v in out.items() if y == 44.0}
    assert picked[8.1] == 8.0 and picked[8.15] == pytest.approx(8.2) and picked[8.55] == pytest.approx(8.4)
