"""Preprocessing and whole experiments."""

from gridloom.operators.model import CellLines
from gridloom.plans import experiment as ex
from gridloom.plans.preprocess import preprocess
from gridloom.queries.evaluation import _METRICS
from gridloom.queries.registry import (
    TEST_FACTOR,
    TEST_REGION,
    crop_ctes,
    hold,
    query,
    r6,
    regrid_ctes,
    split_ctes,
    with_ctes,
)
from gridloom.sources import tables as tb

SETUP = {"loss_type": "mae", "batch_size": 4, "num_epochs": 1, "activation_function": "linear"}


def _inputs(spark, sf):
    return (
        hold(tb.grid_lr(spark, sf)),
        hold(tb.grid_hr(spark, sf)),
        hold(tb.static_lr(spark, sf)),
        hold(tb.static_hr(spark, sf)),
    )


def _options():
    return {"region": TEST_REGION, "divisible_factor": TEST_FACTOR}


_ALIGNED = {
    **crop_ctes("hr_noon"),
    **crop_ctes("static_hr", prefix="s_"),
    "fine": """SELECT * FROM hr_noon WHERE latitude IN (SELECT latitude FROM ax_lat)
        AND longitude IN (SELECT longitude FROM ax_lon)""",
    **regrid_ctes("lr_noon", "ax_lat", "ax_lon"),
    **regrid_ctes("static_lr", "s_ax_lat", "s_ax_lon", "rl", "lsm"),
    **regrid_ctes("static_lr", "s_ax_lat", "s_ax_lon", "rz", "z"),
}


def _cells(name: str, where: str = "true") -> str:
    return f"SELECT latitude, longitude, avg(t2m) AS mu, stddev_pop(t2m) AS sigma FROM {name} WHERE {where} GROUP BY 1, 2"


def _standard(grid: str, stats: str) -> str:
    return f"""SELECT time, g.latitude, g.longitude, CASE WHEN sigma = 0 THEN NULL ELSE (t2m - mu) / sigma END AS t2m
        FROM {grid} g JOIN {stats} s ON g.latitude = s.latitude AND g.longitude = s.longitude"""


def _static(v: str, source: str) -> str:
    return f"({v} - (SELECT avg({v}) FROM {source})) / nullif((SELECT stddev_pop({v}) FROM {source}), 0)"


@query(
    "preprocessed_features",
    with_ctes(
        f"""SELECT g.time, g.latitude, g.longitude, {r6('g.t2m')} AS t2m, {r6('l.lsm')} AS lsm, {r6('z.z')} AS z FROM nl g
            LEFT JOIN (SELECT latitude, longitude, {_static('lsm', 'rl')} AS lsm FROM rl) l
              ON l.latitude = g.latitude AND l.longitude = g.longitude
            LEFT JOIN (SELECT latitude, longitude, {_static('z', 'rz')} AS z FROM rz) z
              ON z.latitude = g.latitude AND z.longitude = g.longitude""",
        "hr_noon",
        "lr_noon",
        "static_hr",
        "static_lr",
        **_ALIGNED,
        lstats=_cells("rg"),
        nl=_standard("rg", "lstats"),
    ),
)
def preprocessed_features(spark, sf):
    return preprocess(*_inputs(spark, sf), **_options()).lr


@query(
    "preprocessed_labels",
    with_ctes(
        f"SELECT time, latitude, longitude, {r6('t2m')} AS t2m FROM nh",
        "hr_noon",
        **crop_ctes("hr_noon"),
        fine=_ALIGNED["fine"],
        hstats=_cells("fine"),
        nh=_standard("fine", "hstats"),
    ),
)
def preprocessed_labels(spark, sf):
    return preprocess(*_inputs(spark, sf), **_options()).hr


@query(
    "preprocessed_min_max",
    with_ctes(
        f"""SELECT g.time, g.latitude, g.longitude,
            {r6('(g.t2m - (SELECT min(t2m) FROM rg)) / (SELECT max(t2m) - min(t2m) FROM rg)')} AS t2m,
            {r6('(l.lsm - (SELECT min(lsm) FROM rl)) / nullif((SELECT max(lsm) - min(lsm) FROM rl), 0)')} AS lsm,
            {r6('(z.z - (SELECT min(z) FROM rz)) / nullif((SELECT max(z) - min(z) FROM rz), 0)')} AS z
            FROM rg g LEFT JOIN rl l ON l.latitude = g.latitude AND l.longitude = g.longitude
            LEFT JOIN rz z ON z.latitude = g.latitude AND z.longitude = g.longitude""",
        "hr_noon",
        "lr_noon",
        "static_hr",
        "static_lr",
        **_ALIGNED,
    ),
)
def preprocessed_min_max(spark, sf):
    return preprocess(*_inputs(spark, sf), kind="min_max", **_options()).lr


def _experiment_ctes(restore: str) -> dict[str, str]:
    """Train-only statistics, per-cell lines, test predictions restored with ``restore`` stats."""
    train_l, train_h = "time < (SELECT first_val FROM lcuts)", "time < (SELECT first_val FROM cuts)"
    return {
        **split_ctes("grid_hr"),
        **split_ctes("grid_lr", "lcuts"),
        **_ALIGNED,
        "lstats": _cells("rg", train_l),
        "hstats": _cells("fine", train_h),
        "nl": _standard("rg", "lstats"),
        "nh": _standard("fine", "hstats"),
        "samples": f"""SELECT h.latitude, h.longitude, l.t2m AS x, h.t2m AS y FROM nh h JOIN nl l
            ON h.time = l.time AND h.latitude = l.latitude AND h.longitude = l.longitude
            WHERE l.{train_l} AND h.{train_h}""",
        "lines": """SELECT latitude, longitude, CASE WHEN vx > 0 THEN s ELSE 0e0 END AS slope,
              CASE WHEN vx > 0 THEN my - s * mx ELSE my END AS intercept FROM (
            SELECT latitude, longitude, var_pop(x) AS vx, avg(x) AS mx, avg(y) AS my,
              covar_pop(y, x) / nullif(var_pop(x), 0) AS s
            FROM (SELECT latitude, longitude, CASE WHEN y IS NOT NULL THEN x END AS x, CASE WHEN x IS NOT NULL THEN y END AS y
                  FROM samples) GROUP BY 1, 2)""",
        "predicted": f"""SELECT n.time, n.latitude, n.longitude, (slope * n.t2m + intercept) * s.sigma + s.mu AS t2m
            FROM nl n JOIN lines l ON n.latitude = l.latitude AND n.longitude = l.longitude
            JOIN {restore} s ON n.latitude = s.latitude AND n.longitude = s.longitude
            WHERE n.time >= (SELECT first_test FROM lcuts)""",
        "truth": """SELECT n.time, n.latitude, n.longitude, n.t2m * s.sigma + s.mu AS t2m FROM nh n
            JOIN hstats s ON n.latitude = s.latitude AND n.longitude = s.longitude
            WHERE n.time >= (SELECT first_test FROM cuts)""",
        "scored": """SELECT t.t2m AS y_true, p.t2m AS y_pred FROM truth t JOIN predicted p
            ON t.time = p.time AND t.latitude = p.latitude AND t.longitude = p.longitude
            WHERE t.t2m IS NOT NULL AND p.t2m IS NOT NULL""",
    }


_GRIDS = ("grid_hr", "grid_lr", "hr_noon", "lr_noon", "static_hr", "static_lr")


@query(
    "experiment_metrics",
    with_ctes(f"SELECT {_METRICS}, count(*) AS n FROM scored", *_GRIDS, **_experiment_ctes("lstats")),
)
def experiment_metrics(spark, sf):
    done = ex.run_experiment(*_inputs(spark, sf), setup=SETUP, run_id="coarse", on_missing="skip", **_options())
    return done.evaluation.metrics


@query(
    "experiment_metrics_target_stats",
    with_ctes(f"SELECT {_METRICS}, count(*) AS n FROM scored", *_GRIDS, **_experiment_ctes("hstats")),
)
def experiment_metrics_target_stats(spark, sf):
    done = ex.run_experiment(
        *_inputs(spark, sf), setup=SETUP, run_id="fine", stats_resolution="hr", on_missing="skip", **_options()
    )
    return done.evaluation.metrics


@query(
    "experiment_prediction",
    with_ctes(
        f"SELECT time, latitude, longitude, {r6('t2m')} AS t2m FROM predicted", *_GRIDS, **_experiment_ctes("lstats")
    ),
)
def experiment_prediction(spark, sf):
    done = ex.run_experiment(*_inputs(spark, sf), setup=SETUP, run_id="coarse", on_missing="skip", **_options())
    return done.prediction


@query(
    "restored_prediction",
    with_ctes(
        f"""SELECT n.time, n.latitude, n.longitude, {r6('n.t2m * s.sigma + s.mu')} AS t2m FROM nl n
            JOIN lstats s ON n.latitude = s.latitude AND n.longitude = s.longitude""",
        "hr_noon",
        "lr_noon",
        **{k: v for k, v in _ALIGNED.items() if not k.startswith(("s_", "rl", "rz"))},
        lstats=_cells("rg"),
        nl=_standard("rg", "lstats"),
    ),
)
def restored_prediction(spark, sf):
    """A model that passes its input through: features restored with the coarse statistics."""
    done = preprocess(*_inputs(spark, sf), **_options())
    identity = done.lr.select("latitude", "longitude").distinct().selectExpr(
        "latitude", "longitude", "1e0 AS slope", "0e0 AS intercept"
    )
    return ex.predict(CellLines(hold(identity)), done.lr, done.stats)
