import math
import warnings
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from gridloom.operators import align, axes as ax, evaluate as ev, model as md, normalize as nz, raster as ra, select as sel
from gridloom.operators import split as sp
from gridloom.operators.tiles import from_tiles, score_tiles, tile_cells, to_tiles
from gridloom.schema import Region, assert_grid, nan_to_null
from gridloom.session import BROADCAST_ROWS_CONF, scratch_path
from pyspark.sql import functions as F

LATS, LONS = [44 + 0.05 * i for i in range(7)], [8 + 0.05 * i for i in range(9)]


def wave(d, y, x):
    return 280 + 5 * math.sin(d + 3 * y) + 2 * math.cos(d * x)


@pytest.fixture(scope="module")
def grid(make_grid):
    return make_grid(LATS, LONS, 20, wave)


# ---------------------------------------------------------------- selection


def test_region_is_inclusive(grid):
    out = sel.crop_to_region(grid, [8.0, 44.05, 8.1, 44.1])
    assert out.select("latitude", "longitude").distinct().count() == 6
    assert sel.crop_to_region(grid, None) is grid
    assert Region.of([1, 2, 3, 4]) == Region(1.0, 2.0, 3.0, 4.0)


@pytest.mark.parametrize(("factor", "shape"), [(2, (6, 8)), (3, (6, 9)), (4, (4, 8)), (1, (7, 9))])
def test_divisible_crop_is_symmetric(grid, factor, shape):
    axes = sel.cropped_axes(grid, None, factor)
    assert (axes.size("latitude"), axes.size("longitude")) == shape
    start = (7 - shape[0]) // 2
    assert axes.summary()["latitude"][1] == pytest.approx(LATS[start])


def test_crop_smaller_than_factor_is_empty_and_warns(grid):
    with pytest.warns(UserWarning, match="empty"):
        out = sel.crop_spatial(grid, None, 32)
    assert out.count() == 0


def test_time_filter_may_find_nothing(grid):
    assert sel.at_times(grid, ["03:00"]).count() == 0
    assert sel.at_times(grid).count() == grid.count()
    assert sel.at_times(grid).schema["t2m"].metadata == {"units": "K", "long_name": "2 metre temperature"}


def test_positions_do_not_depend_on_row_order(grid, as_values):
    ordered = ax.axis_positions(grid.orderBy("time", F.desc("latitude")))
    assert {r.lat_idx for r in ordered.where("latitude = 44.0").collect()} == {0}
    assert ax.input_shape(grid, ["t2m"]).first() == (7, 9, 1)


def test_axes_have_no_bound(grid):
    assert ax.GridAxes.of(grid).size("latitude") == grid.select("latitude").distinct().count()


def test_times_by_position_and_label(grid):
    picked = sel.take_times(grid, [0, 19])
    assert {r.time.day for r in picked.select("time").distinct().collect()} == {1, 20}


def test_schema_check(grid):
    with pytest.raises(ValueError, match="missing columns"):
        assert_grid(grid, ["z"])
    with pytest.raises(TypeError, match="unexpected types"):
        assert_grid(grid.withColumn("t2m", F.col("t2m").cast("string")), ["t2m"])


def test_nan_becomes_null(grid):
    assert nan_to_null(grid.withColumn("t2m", F.lit(float("nan"))), ["t2m"]).where("t2m IS NULL").count() == grid.count()


# ------------------------------------------------------------ normalisation


@pytest.mark.parametrize("kind", sorted(nz.SCALERS))
def test_normalise_and_restore(spark, grid, as_values, kind):
    lr, hr, stats = nz.normalize_temperature(kind, nz.Stats.empty(spark), grid, grid)
    back = as_values(nz.scaler(kind).inverse(stats, hr, "t2m", "hr"))
    assert back == pytest.approx(as_values(grid), abs=1e-9)


def test_anomalies_have_mean_0_and_deviation_1(spark, grid):
    _, hr, _ = nz.normalize_temperature("standardized_anomalies", nz.Stats.empty(spark), grid, grid)
    worst = hr.groupBy("latitude", "longitude").agg(F.avg("t2m").alias("m"), F.stddev_pop("t2m").alias("s"))
    assert worst.where((F.abs("m") > 1e-9) | (F.abs(F.col("s") - 1) > 1e-9)).count() == 0


def test_constant_cell_gives_null(spark, make_grid):
    flat = make_grid([44.0], [8.0], 3, lambda d, y, x: 280.0)
    out, _, _ = nz.normalize_temperature("standardized_anomalies", nz.Stats.empty(spark), flat, flat)
    assert out.where("t2m IS NULL").count() == 3
    out, _, _ = nz.normalize_temperature("min_max", nz.Stats.empty(spark), flat, flat)
    assert out.where("t2m IS NULL").count() == 3


def test_missing_statistics(spark, grid):
    empty = nz.Stats.empty(spark)
    with pytest.raises(ValueError, match="no fitted statistics"):
        nz.normalize_temperature("standardized_anomalies", empty, grid, grid, fit=False)
    with pytest.raises(ValueError, match="no fitted statistics"):
        nz.scaler("min_max").inverse(empty, grid, "t2m", "hr")
    with pytest.raises(ValueError, match="unknown normalisation"):
        nz.scaler("robust")
    with pytest.warns(UserWarning, match="nothing loaded"):
        kept = nz.Stats.load(spark, scratch_path(spark, "nowhere"), empty)
    assert kept is empty


def test_refit_replaces_and_reset_forgets(spark, grid, make_grid):
    other = make_grid(LATS, LONS, 2, lambda d, y, x: 1.0 + d)
    first = nz.AnomalyScaler().fit_temperature(nz.Stats.empty(spark), grid, grid)
    second = nz.AnomalyScaler().fit_temperature(first, other, other)
    assert second.cells.where("data_name = 'hr_t2m'").count() == 63
    assert second.cells.where("data_name = 'hr_t2m'").first().mu == 1.5
    assert not second.reset().names


def test_join_works_beyond_the_broadcast_bound(spark, grid, as_values):
    spark.conf.set(BROADCAST_ROWS_CONF, "1")
    try:
        _, hr, stats = nz.normalize_temperature("standardized_anomalies", nz.Stats.empty(spark), grid, grid)
        back = as_values(nz.AnomalyScaler().inverse(stats, hr, "t2m", "hr"))
    finally:
        spark.conf.unset(BROADCAST_ROWS_CONF)
    assert back == pytest.approx(as_values(grid), abs=1e-9)


# -------------------------------------------------------- splits and batches


@pytest.mark.parametrize(("n", "size"), [(20, 0.11), (100, 0.11), (9, 0.3), (20, 3)])
def test_split_sizes_and_order(make_grid, n, size):
    grid = make_grid([44.0], [8.0, 8.1], n, wave)
    parts = sp.split_dataset(grid, grid, size)
    n_test = math.ceil(size * n) if isinstance(size, float) else size
    n_val = math.ceil(size * (n - n_test)) if isinstance(size, float) else size
    times = {s: sorted(r.time for r in parts[f"hr_{s}"].select("time").distinct().collect()) for s in sp.SPLITS}
    assert [len(times[s]) for s in sp.SPLITS] == [n - n_test - n_val, n_val, n_test]
    assert times["train"][-1] < times["val"][0] and times["val"][-1] < times["test"][0]


def test_too_few_times_to_split(make_grid):
    with pytest.raises(ValueError, match="no training data"):
        sp.SplitCuts.of(make_grid([44.0], [8.0], 1, wave))


def test_batches_cover_every_time_once_per_epoch(grid):
    def order(seed):
        rows = sp.assign_batches(grid, 6, epochs=3, seed=seed).orderBy("epoch", "position").collect()
        return [(r.epoch, r.time, r.position, r.batch_id) for r in rows]

    rows = order(42)
    for epoch in range(3):
        mine = [r for r in rows if r[0] == epoch]
        assert [r[2] for r in mine] == list(range(20))
        assert len({r[1] for r in mine}) == 20
        assert [r[3] for r in mine] == [i // 6 for i in range(20)]
    assert rows == order(42)
    assert rows != order(43)
    assert [r[1] for r in rows[:20]] != [r[1] for r in rows[20:40]]


def test_dense_index_equals_sorted_rank(spark):
    keys = spark.range(5000).select((F.col("id") * 7919 % 100_003).alias("k"))
    out = ax.dense_index(keys, F.col("k"), F.floor(F.col("k") / 1000), "i").collect()
    assert [r.k for r in sorted(out, key=lambda r: r.i)] == sorted(r.k for r in out)
    assert sorted(r.i for r in out) == list(range(5000))


# ------------------------------------------------------------------- scores


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(280, 9, 4000)
    frame = pd.DataFrame({"y_true": y, "y_pred": y + rng.normal(0, 2, 4000)})
    return spark.createDataFrame(frame), frame


def test_metrics_against_numpy(pair):
    df, frame = pair
    e = frame.y_true - frame.y_pred
    got = ev.metrics(df).first()
    assert got.rmse == pytest.approx(np.sqrt((e**2).mean()))
    assert got.mae == pytest.approx(e.abs().mean())
    assert got.rmse_percentage_true == pytest.approx(got.rmse / np.ptp(frame.y_true) * 100)
    assert (got.true_min, got.pred_max) == (frame.y_true.min(), frame.y_pred.max())


def test_metrics_refuse_missing_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (3.0, float("nan"))], "y_true double, y_pred double")
    with pytest.raises(Exception, match="missing values"):
        ev.metrics(df).collect()
    assert ev.metrics(df, on_missing="skip").first().n == 1


def test_histogram_against_numpy(pair):
    df, frame = pair
    rows = ev.histogram(df, {"actual": "y_true", "predicted": "y_pred"}).orderBy("series", "bin").collect()
    for label, column in (("actual", "y_true"), ("predicted", "y_pred")):
        counts, edges = np.histogram(frame[column], bins=50)
        mine = [r for r in rows if r.series == label]
        assert [r.n for r in mine] == counts.tolist()
        assert [r.left_edge for r in mine] == pytest.approx(edges[:-1].tolist())


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "v double")
    rows = ev.histogram(df, {"v": "v"}).collect()
    assert len(rows) == 50 and sum(r.n for r in rows) == 5
    assert {r.bin for r in rows if r.n} == {int(np.histogram([2.0] * 5, bins=50)[0].argmax())}


def test_ticks_and_graticule(make_grid):
    grid = make_grid([42.5, 54.0], [6.5, 16.5], 1, wave)
    ticks = ev.axis_ticks(grid).orderBy("axis", "tick").collect()
    assert [(t.tick, t.label) for t in ticks if t.axis == "latitude"] == [(42.5, "42°N"), (47.5, "47°N"), (52.5, "52°N")]
    assert [t.label for t in ticks if t.axis == "longitude"] == ["6°E", "11°E"]
    lines = ev.graticule(grid).orderBy("i").collect()
    assert [r.latitude for r in lines] == pytest.approx(np.linspace(42.5, 54, 100).tolist())


# -------------------------------------------------------------------- tiles


def test_tiles_are_north_up_and_come_back(grid, as_values):
    axes = ax.GridAxes.of(grid)
    tiles = to_tiles(grid, ["t2m"], axes)
    assert as_values(from_tiles(tiles, axes)) == as_values(grid)
    first = tile_cells(tiles).where("row = 0 AND col = 0").orderBy("time").first()
    assert first.value == wave(0, LATS[-1], LONS[0])


def test_tile_scorer_sees_whole_timesteps(grid):
    out = score_tiles(grid, lambda tile: pd.Series(float(len(tile)), index=tile.index), ["t2m"], size=None)
    assert {r.t2m for r in out.collect()} == {63.0}


def test_small_tiles_come_back_whole(grid, as_values):
    axes = ax.GridAxes.of(grid)
    tiles = to_tiles(grid, ["t2m"], axes, size=4)
    assert {(r.tile_y, r.tile_x) for r in tiles.collect()} == {(y, x) for y in (0, 1) for x in (0, 1, 2)}
    assert as_values(from_tiles(tiles, axes, size=4)) == as_values(grid)


def test_tile_margins_are_seen_but_not_returned(grid):
    count = lambda tile: pd.Series(float(len(tile)), index=tile.index)
    out = ax.axis_positions(score_tiles(grid, count, ["t2m"], size=4, halo=1), ax.GridAxes.of(grid))
    assert out.count() == grid.count()
    at = {(r.lat_idx, r.lon_idx): r.t2m for r in out.collect()}
    # 5 x 5 cells at the corner, 4 x 6 in the middle of the other side.
    assert at[0, 0] == 25 and at[6, 5] == 24 and at[6, 8] == 4 * 2


# ------------------------------------------------------------------- raster


def dense(df, y, x, value, shape):
    a = np.full(shape, np.nan)
    for r in df.collect():
        a[r[y], r[x]] = r[value]
    return a


@pytest.mark.parametrize("band", [2, 64])
def test_convolution_against_numpy(make_grid, monkeypatch, band):
    monkeypatch.setattr(ra, "BAND_ROWS", band)
    grid = make_grid(LATS, LONS, 1, wave)
    k = np.arange(9.0).reshape(3, 3) - 3
    z = np.array([[wave(0, y, x) for x in LONS] for y in LATS])
    p = np.pad(z, 1)
    want = sum(k[i, j] * p[i : i + 7, j : j + 9] for i in range(3) for j in range(3))
    out = ax.axis_positions(ra.convolve(grid, {"t2m": k.tolist()}, bias=1.5), ax.GridAxes.of(grid))
    assert np.allclose(dense(out, "lat_idx", "lon_idx", "focal", (7, 9)), want + 1.5)


def test_identity_kernel(grid, as_values):
    out = ra.convolve(grid, {"t2m": [[0, 0, 0], [0, 1, 0], [0, 0, 0]]}, output="t2m")
    assert as_values(out) == pytest.approx(as_values(grid))


@pytest.mark.parametrize("band", [2, 64])
def test_upsampling_against_numpy(make_grid, monkeypatch, band):
    monkeypatch.setattr(ra, "BAND_ROWS", band)
    grid = make_grid(LATS, LONS, 1, wave)
    k = np.array(ra.BILINEAR)
    want = np.zeros((16, 20))
    for i, y in enumerate(LATS):
        for j, x in enumerate(LONS):
            want[2 * i : 2 * i + 3, 2 * j : 2 * j + 3] += k * wave(0, y, x)
    out = dense(ra.upsample(grid, interpolate=False), "out_y", "out_x", "t2m", (14, 18))
    assert np.allclose(out, want[:14, :18])


def test_bilinear_upsampling_keeps_a_constant(make_grid):
    out = ra.upsample(make_grid(LATS, LONS, 1, lambda d, y, x: 100.0))
    assert out.count() == 14 * 18 and {round(r.t2m, 9) for r in out.collect()} == {100.0}


@pytest.mark.parametrize("gap", ["null", "absent"])
def test_missing_cells_are_not_zero(make_grid, gap):
    grid = make_grid(LATS, LONS, 1, lambda d, y, x: 270.0)
    hole = (F.col("latitude") == LATS[3]) & (F.col("longitude") == LONS[4])
    grid = grid.withColumn("t2m", F.when(~hole, F.col("t2m"))) if gap == "null" else grid.where(~hole)
    axes, mean = ax.GridAxes.of(grid), {"t2m": [[1 / 9] * 3] * 3}

    def focal(how):
        out = ax.axis_positions(ra.convolve(grid, mean, axes=axes, on_missing=how), axes)
        return dense(out.where("focal IS NOT NULL"), "lat_idx", "lon_idx", "focal", (7, 9))

    assert np.isnan(focal("null")).sum() == 9
    assert np.allclose(focal("renormalise")[1:-1, 1:-1][~np.isnan(focal("renormalise")[1:-1, 1:-1])], 270)
    assert focal("zero")[2, 3] == pytest.approx(240)
    up = {r.t2m and round(r.t2m, 9) for r in ra.upsample(grid, axes=axes).collect()}
    assert up == {270.0, None}
    with pytest.raises(ValueError, match="on_missing"):
        ra.convolve(grid, mean, axes=axes, on_missing="skip")


def test_nearest_upsampling_repeats_cells(make_grid):
    grid = make_grid(LATS, LONS, 1, wave)
    out = dense(ra.upsample(grid, kernel=ra.NEAREST), "out_y", "out_x", "t2m", (14, 18))
    assert np.allclose(out[::2, ::2], out[1::2, 1::2])


def test_pool_drops_incomplete_blocks(make_grid):
    grid = make_grid(LATS, LONS, 1, wave)
    z = np.array([[wave(0, y, x) for x in LONS] for y in LATS])
    for origin, kept in (("south", z[:6, :8]), ("north", z[1:, :8])):
        out = dense(ra.block_pool(grid, origin=origin), "block_y", "block_x", "t2m", (3, 4))
        assert np.allclose(out, kept.reshape(3, 2, 4, 2).max(axis=(1, 3)))


def test_batch_norm(grid):
    got = ra.batch_norm(grid).agg(F.avg("t2m"), F.var_pop("t2m")).first()
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] == pytest.approx(1, abs=1e-3)
    with pytest.raises(ValueError, match="activation"):
        ra.activate(grid, activation="relu")


# ------------------------------------------------------------------- models


def test_cell_lines_recover_slopes(make_grid, as_values):
    x = make_grid(LATS[:2], LONS[:2], 12, wave)
    samples = x.withColumn("label", 3 * F.col("latitude") * F.col("t2m") - F.col("longitude"))
    lines = md.CellLines.fit(samples)
    assert as_values(lines.predict(x)) == pytest.approx(as_values(samples, "label"), abs=1e-6)


def test_cell_without_variation_predicts_its_mean(make_grid):
    x = make_grid([44.0], [8.0], 4, lambda d, y, x: 5.0)
    samples = x.withColumn("label", F.dayofmonth("time").cast("double"))
    assert md.cell_regression(samples).select("slope", "intercept").first() == (0.0, 2.5)


def test_global_linear_against_numpy(spark, make_grid):
    grid = make_grid(LATS, LONS, 6, wave).withColumn("z", F.sin("latitude") * 3 + F.col("longitude"))
    samples = grid.withColumn("label", 2 * F.col("t2m") - 4 * F.col("z") + 7)
    model = md.GlobalLinear.fit(samples, ["t2m", "z"])
    weights = {r.term: r.weight for r in model.coefficients(spark).collect()}
    assert weights == pytest.approx({"t2m": 2.0, "z": -4.0, "intercept": 7.0}, abs=1e-4)
    assert len(md.feature_arrays(samples, ["t2m", "z"]).first().features) == 2


def test_run_grid(spark):
    out = md.run_grid(spark, {"a": [1, 2, 3], "b": ["x", "y"]})
    assert out.distinct().count() == 6


def test_combine_static_uses_first_time_and_checks_cover(make_grid, as_values):
    grid = make_grid(LATS[:2], LONS[:2], 3, wave)
    static = make_grid(LATS[:2], LONS[:2], 2, lambda d, y, x: y + d).withColumnRenamed("t2m", "z")
    out = align.combine_static(grid, static, ["z"], strict=True)
    assert as_values(out, "z") == pytest.approx({k: k[1] for k in as_values(out, "z")})
    with pytest.raises(Exception, match="do not cover"):
        align.combine_static(grid, static.where("latitude < 44.01"), ["z"], strict=True).collect()


def test_concat_warns_about_different_variables(grid):
    with pytest.warns(UserWarning, match="different variables"):
        out = sel.concat_times(grid, grid.withColumn("z", F.lit(1.0)))
    assert out.count() == 2 * grid.count()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        sel.concat_times(grid, grid)


def test_unpaired_times(make_grid):
    long, short = make_grid([44.0], [8.0], 3, wave), make_grid([44.0], [8.0], 2, wave)
    assert [tuple(r) for r in align.unpaired_times(long, short).collect()] == [(datetime(2020, 1, 3, 12), "lr")]


def test_unmatched_cells_are_listed_or_raise(make_grid):
    whole = make_grid(LATS[:2], LONS[:2], 2, wave)
    part = make_grid(LATS[:2], LONS[:2], 2, wave, drop=lambda d, y, x: d == 1 and x > LONS[0])
    assert align.unpaired_cells(whole, part).count() == 2
    assert {r.only_in for r in align.unpaired_cells(part, whole).collect()} == {"hr"}
    assert align.pair_samples(whole, part).count() == 6
    assert align.pair_samples(whole, whole, strict=True).count() == 8
    with pytest.raises(ValueError, match="2 cells only left"):
        align.pair_samples(whole, part, strict=True)
    with pytest.raises(ValueError, match="2 cells only right"):
        align.pair_features(part, whole, ["t2m"], "label", strict=True)


def test_cells_without_line_or_statistics_stay(spark, make_grid):
    whole = make_grid(LATS[:2], LONS[:2], 3, wave)
    part = whole.where(F.col("longitude") < LONS[0] + 0.01)
    lines = md.CellLines.fit(part.withColumn("label", F.col("t2m") * 2))
    assert lines.predict(whole).count() == 12 and lines.predict(whole).where("t2m IS NULL").count() == 6
    with pytest.raises(Exception, match="lines do not cover"):
        lines.predict(whole, strict=True).collect()
    scaler = nz.AnomalyScaler()
    stats = scaler.fit_temperature(nz.Stats.empty(spark), part, part)
    back = scaler.inverse(stats, whole, "t2m", "lr")
    assert back.count() == 12 and back.where("t2m IS NULL").count() == 6
    with pytest.raises(Exception, match="statistics do not cover"):
        scaler.inverse(stats, whole, "t2m", "lr", strict=True).collect()
    assert scaler.inverse(stats, part, "t2m", "lr", strict=True).count() == 6
