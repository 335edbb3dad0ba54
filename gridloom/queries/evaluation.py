"""Scores, maps and histograms over truth/prediction pairs."""

from pyspark.sql import functions as F

from gridloom.operators import evaluate as ev
from gridloom.operators.select import at_times
from gridloom.plans.overview import input_overview
from gridloom.queries.registry import axes_ctes, hold, query, r6, regrid_ctes, with_ctes
from gridloom.sources import tables as tb

_METRICS = ", ".join(
    f"{r6(expr)} AS {name}"
    for name, expr in {
        "true_min": "min(y_true)",
        "true_max": "max(y_true)",
        "pred_min": "min(y_pred)",
        "pred_max": "max(y_pred)",
        "rmse": "sqrt(avg((y_true - y_pred) * (y_true - y_pred)))",
        "mae": "avg(abs(y_true - y_pred))",
        "rmse_percentage_true": "100 * sqrt(avg((y_true - y_pred) * (y_true - y_pred))) / nullif(max(y_true) - min(y_true), 0)",
        "mae_percentage_true": "100 * avg(abs(y_true - y_pred)) / nullif(max(y_true) - min(y_true), 0)",
    }.items()
)


@query("metric_bundle", with_ctes(f"SELECT {_METRICS}, count(*) AS n FROM pair", "pair"))
def metric_bundle(spark, sf):
    return ev.metrics(tb.pair(spark, sf))


@query(
    "metrics_by_year",
    with_ctes(f"SELECT extract(year FROM time) AS year, {_METRICS}, count(*) AS n FROM pair GROUP BY 1", "pair"),
)
def metrics_by_year(spark, sf):
    return ev.metrics(tb.pair(spark, sf).withColumn("year", F.year("time")), ["year"])


@query(
    "metrics_by_cell",
    with_ctes(f"SELECT latitude, longitude, {_METRICS}, count(*) AS n FROM pair GROUP BY 1, 2", "pair"),
)
def metrics_by_cell(spark, sf):
    return ev.metrics(tb.pair(spark, sf), ["latitude", "longitude"])


_E = "(y_true - y_pred)"
_LOSSES = {
    "mse": f"avg({_E} * {_E})",
    "mae": f"avg(abs({_E}))",
    "huber_loss": f"avg(CASE WHEN abs({_E}) <= 1 THEN 0.5e0 * {_E} * {_E} ELSE abs({_E}) - 0.5e0 END)",
}


@query("training_losses", with_ctes(f"SELECT {', '.join(f'{r6(e)} AS {n}' for n, e in _LOSSES.items())} FROM pair", "pair"))
def training_losses(spark, sf):
    return ev.losses(tb.pair(spark, sf))


@query(
    "temporal_mean_map",
    with_ctes(f"SELECT latitude, longitude, {r6('avg(t2m)')} AS t2m FROM grid_hr GROUP BY 1, 2", "grid_hr"),
)
def temporal_mean_map(spark, sf):
    return ev.mean_map(tb.grid_hr(spark, sf))


_MEANS = {
    "rt": "SELECT time, latitude, longitude, t2m FROM rg",
    "mt": "SELECT latitude, longitude, avg(t2m) AS t2m FROM hr_noon GROUP BY 1, 2",
    "mp": "SELECT latitude, longitude, avg(t2m) AS t2m FROM rt GROUP BY 1, 2",
}
_NOON_REGRID = {**axes_ctes("hr_noon"), **regrid_ctes("lr_noon", "ax_lat", "ax_lon"), **_MEANS}


def _truth_and_regridded(spark, sf):
    from gridloom.operators.axes import GridAxes
    from gridloom.operators.regrid import regrid

    fine = hold(at_times(tb.grid_hr(spark, sf)))
    return fine, regrid(at_times(tb.grid_lr(spark, sf)), GridAxes.of(fine), ["t2m"])


@query(
    "difference_map",
    with_ctes(
        f"""SELECT mt.latitude, mt.longitude, {r6('mt.t2m - mp.t2m')} AS difference,
            {r6('greatest(least(mt.t2m - mp.t2m, 5e0), -5e0)')} AS shown
            FROM mt JOIN mp ON mt.latitude = mp.latitude AND mt.longitude = mp.longitude""",
        "hr_noon",
        "lr_noon",
        **_NOON_REGRID,
    ),
)
def difference_map(spark, sf):
    return ev.difference_map(*_truth_and_regridded(spark, sf))


@query(
    "spatial_comparison",
    with_ctes(
        f"""SELECT mt.latitude, mt.longitude, {r6('mt.t2m')} AS y_true_mean, {r6('mp.t2m')} AS y_pred_mean,
            (SELECT min(longitude) FROM hr_noon) AS lon_min, (SELECT min(latitude) FROM hr_noon) AS lat_min,
            (SELECT max(longitude) FROM hr_noon) AS lon_max, (SELECT max(latitude) FROM hr_noon) AS lat_max
            FROM mt JOIN mp ON mt.latitude = mp.latitude AND mt.longitude = mp.longitude""",
        "hr_noon",
        "lr_noon",
        **_NOON_REGRID,
    ),
)
def spatial_comparison(spark, sf):
    return ev.spatial_comparison(*_truth_and_regridded(spark, sf))


def _histogram_sql(series: dict[str, tuple[str, str]]) -> str:
    parts = []
    for label, (source, column) in series.items():
        step = "(hi - lo) / 50"
        guess = f"least(floor(({column} - lo) * 50 / (hi - lo)), 49)"
        parts.append(
            f"""SELECT '{label}' AS series, b.bin, {r6(f'lo + b.bin * (hi - lo) / 50')} AS left_edge,
                {r6(f'lo + (b.bin + 1) * (hi - lo) / 50')} AS right_edge, coalesce(c.n, 0) AS n
              FROM (SELECT unnest(range(50)) AS bin) b CROSS JOIN
                   (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}) e
              LEFT JOIN (SELECT CAST(g + CASE WHEN x < lo + g * {step} THEN -1 ELSE 0 END
                           + CASE WHEN g < 49 AND x >= lo + (g + 1) * {step} THEN 1 ELSE 0 END AS BIGINT) AS bin, count(*) AS n
                         FROM (SELECT {column} AS x, lo, hi, {guess} AS g FROM {source} CROSS JOIN
                               (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}))
                         GROUP BY 1) c ON c.bin = b.bin"""
        )
    return " UNION ALL ".join(parts)


@query(
    "comparison_histograms",
    with_ctes(_histogram_sql({"actual": ("pair", "y_true"), "predicted": ("pair", "y_pred")}), "pair"),
)
def comparison_histograms(spark, sf):
    return ev.histogram(hold(tb.pair(spark, sf)), {"actual": "y_true", "predicted": "y_pred"})


@query("single_histogram", with_ctes(_histogram_sql({"t2m": ("grid_hr", "t2m")}), "grid_hr"))
def single_histogram(spark, sf):
    return ev.histogram(hold(tb.grid_hr(spark, sf)), {"t2m": "t2m"})


@query(
    "axis_ticks",
    with_ctes(
        f"""SELECT axis, {r6('lo + i * 0.1e0')} AS tick, CAST(CAST(trunc(lo + i * 0.1e0) AS BIGINT) AS VARCHAR) || letter AS label
            FROM (SELECT axis, lo, letter, unnest(range(CAST(ceil((hi - lo) / 0.1e0) AS BIGINT))) AS i FROM (
              SELECT 'latitude' AS axis, min(latitude) AS lo, max(latitude) AS hi, '°N' AS letter FROM grid_hr UNION ALL
              SELECT 'longitude', min(longitude), max(longitude), '°E' FROM grid_hr))""",
        "grid_hr",
    ),
)
def axis_ticks(spark, sf):
    return ev.axis_ticks(tb.grid_hr(spark, sf), step=0.1)


@query(
    "graticule",
    with_ctes(
        f"""SELECT i, {r6('y0 + i * (y1 - y0) / 99')} AS latitude, {r6('x0 + i * (x1 - x0) / 99')} AS longitude FROM
            (SELECT unnest(range(100)) AS i) CROSS JOIN (SELECT min(latitude) AS y0, max(latitude) AS y1,
             min(longitude) AS x0, max(longitude) AS x1 FROM grid_hr)""",
        "grid_hr",
    ),
)
def graticule(spark, sf):
    return ev.graticule(tb.grid_hr(spark, sf))


@query(
    "input_overview",
    with_ctes(
        " UNION ALL ".join(
            f"""SELECT '{p}' AS product, '{v}' AS variable, latitude, longitude, {r6(v)} AS value FROM {g}
                WHERE time = (SELECT min(time) FROM {g})"""
            for p, g, v in (
                ("lr", "grid_lr", "t2m"),
                ("lr", "static_lr", "lsm"),
                ("lr", "static_lr", "z"),
                ("hr", "grid_hr", "t2m"),
                ("hr", "static_hr", "lsm"),
                ("hr", "static_hr", "orog"),
            )
        ),
        "grid_lr",
        "grid_hr",
        "static_lr",
        "static_hr",
    ),
)
def overview(spark, sf):
    grids = (tb.grid_lr(spark, sf), tb.static_lr(spark, sf), tb.grid_hr(spark, sf), tb.static_hr(spark, sf))
    return input_overview(*grids)
