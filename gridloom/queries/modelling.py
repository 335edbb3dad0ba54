"""Baseline models, scorers and configuration grids."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import model as md
from gridloom.operators.align import join_cells, keyed, pair_features
from gridloom.operators.axes import GridAxes
from gridloom.operators.evaluate import losses
from gridloom.operators.regrid import regrid
from gridloom.operators.select import at_times
from gridloom.operators.tiles import score_rows, score_tiles
from gridloom.queries.evaluation import _LOSSES
from gridloom.queries.registry import axes_ctes, hold, query, r6, regrid_ctes, with_ctes
from gridloom.sources import tables as tb

_SAMPLES = {
    **axes_ctes("hr_noon"),
    **regrid_ctes("lr_noon", "ax_lat", "ax_lon"),
    "samples": """SELECT h.time, h.latitude, h.longitude, r.t2m, h.t2m AS label FROM hr_noon h
        JOIN rg r ON h.time = r.time AND h.latitude = r.latitude AND h.longitude = r.longitude""",
    "lines": """SELECT latitude, longitude, n, r2, CASE WHEN vx > 0 THEN s ELSE 0e0 END AS slope,
          CASE WHEN vx > 0 THEN my - s * mx ELSE my END AS intercept FROM (
        SELECT latitude, longitude, count(*) AS n, var_pop(t2m) AS vx, avg(t2m) AS mx, avg(label) AS my,
          covar_pop(label, t2m) / nullif(var_pop(t2m), 0) AS s, regr_r2(label, t2m) AS r2
        FROM samples WHERE t2m IS NOT NULL GROUP BY 1, 2)""",
}


def _samples(spark, sf):
    fine = hold(at_times(tb.grid_hr(spark, sf)))
    coarse = regrid(at_times(tb.grid_lr(spark, sf)), GridAxes.of(fine), ["t2m"])
    return hold(pair_features(coarse, fine, ["t2m"], "label"))


@query(
    "cell_regression",
    with_ctes(
        f"SELECT latitude, longitude, {r6('slope')} AS slope, {r6('intercept')} AS intercept, {r6('r2')} AS r2, n FROM lines",
        "hr_noon",
        "lr_noon",
        **_SAMPLES,
    ),
)
def cell_regression(spark, sf):
    return md.cell_regression(_samples(spark, sf))


@query(
    "cell_regression_prediction",
    with_ctes(
        f"""SELECT s.time, s.latitude, s.longitude, {r6('slope * t2m + intercept')} AS t2m FROM samples s
            JOIN lines l ON s.latitude = l.latitude AND s.longitude = l.longitude""",
        "hr_noon",
        "lr_noon",
        **_SAMPLES,
    ),
)
def cell_regression_prediction(spark, sf):
    samples = _samples(spark, sf)
    return md.CellLines.fit(samples).predict(samples)


@query(
    "global_linear_model",
    with_ctes(
        f"""SELECT 't2m' AS term, {r6('regr_slope(label, t2m)')} AS weight FROM samples UNION ALL
            SELECT 'intercept', {r6('regr_intercept(label, t2m)')} FROM samples""",
        "hr_noon",
        "lr_noon",
        **_SAMPLES,
    ),
)
def global_linear_model(spark, sf):
    return md.GlobalLinear.fit(_samples(spark, sf), ["t2m"]).coefficients(spark)


def _terrain_samples(spark, sf):
    samples = _samples(spark, sf)
    static = hold(keyed(tb.static_hr(spark, sf), "lsm", "orog"))
    return join_cells(samples, static, static.count(), "inner")


# Normal equations of three features, solved by determinants.
_TERRAIN = {
    **_SAMPLES,
    "terrain": "SELECT s.*, h.lsm, h.orog FROM samples s JOIN static_hr h ON s.latitude = h.latitude AND s.longitude = h.longitude",
    "moments": """SELECT var_pop(t2m) AS aa, covar_pop(t2m, lsm) AS ab, covar_pop(t2m, orog) AS ac, var_pop(lsm) AS bb, covar_pop(lsm, orog) AS bc,
        var_pop(orog) AS cc, covar_pop(t2m, label) AS ay, covar_pop(lsm, label) AS yb, covar_pop(orog, label) AS cy,
        avg(t2m) AS ma, avg(lsm) AS mb, avg(orog) AS mc, avg(label) AS my
        FROM terrain WHERE t2m IS NOT NULL AND lsm IS NOT NULL AND orog IS NOT NULL AND label IS NOT NULL""",
    "weights": """SELECT *, (ay * (bb * cc - bc * bc) - ab * (yb * cc - bc * cy) + ac * (yb * bc - bb * cy)) / det AS wa,
          (aa * (yb * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - yb * ac)) / det AS wb,
          (aa * (bb * cy - yb * bc) - ab * (ab * cy - yb * ac) + ay * (ab * bc - bb * ac)) / det AS wc
        FROM (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM moments)""",
}


@query(
    "global_linear_with_terrain",
    with_ctes(
        f"""SELECT time, latitude, longitude, {r6('my + wa * (t2m - ma) + wb * (lsm - mb) + wc * (orog - mc)')} AS t2m
            FROM terrain CROSS JOIN weights""",
        "hr_noon",
        "lr_noon",
        "static_hr",
        **_TERRAIN,
    ),
)
def global_linear_with_terrain(spark, sf):
    samples = hold(_terrain_samples(spark, sf))
    model = md.GlobalLinear.fit(samples, ["t2m", "lsm", "orog"])
    return model.predict(samples)


@query("global_huber_model")
def global_huber_model(spark, sf):
    samples = hold(_terrain_samples(spark, sf))
    return md.GlobalLinear.fit(samples, ["t2m", "lsm", "orog"], loss="huber").coefficients(spark)


@query(
    "tile_scorer_whole",
    with_ctes(
        f"""SELECT time, latitude, longitude, {r6('t2m - max(t2m) OVER (PARTITION BY time)')} AS t2m FROM grid_hr""",
        "grid_hr",
    ),
)
def tile_scorer_whole(spark, sf):
    """The same for all timesteps of the grid."""
    return score_tiles(tb.grid_hr(spark, sf), lambda tile: tile["t2m"] - tile["t2m"].max(), ["t2m"], size=None)


def _above_neighbours(tile):
    """Departure of every cell from the mean of the present cells of its 3 x 3 neighbourhood."""
    y, x = (tile[c].to_numpy() - tile[c].min() + 1 for c in ("lat_idx", "lon_idx"))
    field = np.full((y.max() + 2, x.max() + 2), np.nan)
    field[y, x] = tile["t2m"]
    near = [field[y + dy, x + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    return tile["t2m"] - np.nanmean(near, axis=0)


@query(
    "tile_scorer_with_halo",
    with_ctes(
        f"""SELECT a.time, a.latitude, a.longitude, {r6('max(a.t2m) - avg(b.t2m)')} AS t2m FROM pos a JOIN pos b
              ON b.time = a.time AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY 1, 2, 3""",
        "grid_hr",
        pos="""SELECT time, latitude, longitude, t2m, dense_rank() OVER (ORDER BY latitude) AS y,
            dense_rank() OVER (ORDER BY longitude) AS x FROM grid_hr""",
    ),
)
def tile_scorer_with_halo(spark, sf):
    """A scorer of neighbourhoods, on tiles of 4 x 4 cells with one row and column of overlap."""
    return score_tiles(hold(tb.grid_hr(spark, sf)), _above_neighbours, ["t2m"], size=4, halo=1)


@query(
    "row_scorer_whole",
    with_ctes(f"SELECT time, latitude, longitude, {r6('0.5e0 * t2m + 140')} AS t2m FROM grid_hr", "grid_hr"),
)
def row_scorer_whole(spark, sf):
    """The same for all timesteps of the grid."""
    return score_rows(tb.grid_hr(spark, sf), lambda rows: 0.5 * rows["t2m"] + 140, ["t2m"])


@query(
    "run_grid_losses",
    with_ctes(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS loss_type, b.batch_size, {r6(expr)} AS loss,
                CAST(ceil(count(DISTINCT time) / CAST(b.batch_size AS DOUBLE)) AS BIGINT) AS steps
                FROM pair CROSS JOIN (SELECT unnest([2, 4, 8, 16, 32, 64]) AS batch_size) b GROUP BY b.batch_size"""
            for name, expr in _LOSSES.items()
        ),
        "pair",
    ),
)
def run_grid_losses(spark, sf):
    """Every loss type x batch size, with the loss of the predictor and the steps per epoch."""
    pair = hold(tb.pair(spark, sf))
    options = {"loss_type": list(_LOSSES), "batch_size": [2, 4, 8, 16, 32, 64]}
    scores = losses(pair)
    value = F.coalesce(*[F.when(F.col("loss_type") == n, scores.select(n).scalar()) for n in _LOSSES])
    n_times = pair.agg(F.countDistinct("time").alias("n")).scalar()
    return md.run_grid(spark, options).select(
        "loss_type", "batch_size", value.alias("loss"), F.ceil(n_times / F.col("batch_size")).alias("steps")
    )
