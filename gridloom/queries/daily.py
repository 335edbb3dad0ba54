"""The heavy operators on the large daily grid (32 x 32 cells, one timestep per day)."""

from gridloom.operators import normalize as nz, raster as ra
from gridloom.operators.align import pair_samples
from gridloom.operators.axes import GridAxes
from gridloom.operators.evaluate import metrics
from gridloom.operators.regrid import regrid
from gridloom.operators.split import label_splits
from gridloom.queries.evaluation import _METRICS
from gridloom.queries.raster import _FULL, KERNEL, _taps
from gridloom.queries.registry import axes_ctes, hold, query, r6, regrid_ctes, split_ctes, with_ctes
from gridloom.sources import tables as tb

_REGRID = {**axes_ctes("daily_hr"), **regrid_ctes("daily_lr", "ax_lat", "ax_lon")}


def _regridded(spark, sf, fine):
    return regrid(tb.daily_lr(spark, sf), GridAxes.of(fine), ["t2m"])


@query(
    "daily_anomalies",
    with_ctes(
        f"""SELECT time, g.latitude, g.longitude, {r6('CASE WHEN sigma = 0 THEN NULL ELSE (t2m - mu) / sigma END')} AS t2m
            FROM daily_hr g JOIN (SELECT latitude, longitude, avg(t2m) AS mu, stddev_pop(t2m) AS sigma FROM daily_hr GROUP BY 1, 2) s
              ON g.latitude = s.latitude AND g.longitude = s.longitude""",
        "daily_hr",
    ),
)
def daily_anomalies(spark, sf):
    fine = hold(tb.daily_hr(spark, sf))
    stats = nz.Stats.empty(spark).with_cells(nz.cell_climatology(fine, "t2m", "hr_t2m"), "hr_t2m")
    return nz.AnomalyScaler().apply_temperature(stats, fine, "hr")


@query(
    "daily_regrid",
    with_ctes(f"SELECT time, latitude, longitude, {r6('t2m')} AS t2m FROM rg", "daily_hr", "daily_lr", **_REGRID),
)
def daily_regrid(spark, sf):
    return _regridded(spark, sf, tb.daily_hr(spark, sf))


@query(
    "daily_regrid_metrics",
    with_ctes(
        f"""SELECT {_METRICS}, count(*) AS n FROM (SELECT h.t2m AS y_true, r.t2m AS y_pred FROM daily_hr h JOIN rg r
              ON h.time = r.time AND h.latitude = r.latitude AND h.longitude = r.longitude
            WHERE h.t2m IS NOT NULL AND r.t2m IS NOT NULL)""",
        "daily_hr",
        "daily_lr",
        **_REGRID,
    ),
)
def daily_regrid_metrics(spark, sf):
    fine = hold(tb.daily_hr(spark, sf))
    return metrics(pair_samples(fine, _regridded(spark, sf, fine)), on_missing="skip")


@query(
    "daily_focal",
    with_ctes(
        f"""SELECT a.time, a.latitude, a.longitude, CASE WHEN count(b.t2m) = count(*) THEN {r6('sum(k.w * b.t2m)')} END AS focal FROM pos a CROSS JOIN taps k
            JOIN full_grid b ON b.time = a.time AND b.y = a.y + k.dy AND b.x = a.x + k.dx GROUP BY 1, 2, 3""",
        "daily_hr",
        **{k: v.replace("grid_hr", "daily_hr") for k, v in _FULL.items()},
        taps=_taps(KERNEL, 1),
    ),
)
def daily_focal(spark, sf):
    """NULL where a neighbour inside the grid is absent, as most are on days with few cells."""
    return ra.convolve(hold(tb.daily_hr(spark, sf)), {"t2m": KERNEL})


@query(
    "daily_split",
    with_ctes(
        f"""SELECT g.time, latitude, longitude, {r6('t2m')} AS t2m, CASE WHEN g.time < c.first_val THEN 'train'
              WHEN g.time < c.first_test THEN 'val' ELSE 'test' END AS split FROM daily_hr g CROSS JOIN cuts c""",
        "daily_hr",
        **split_ctes("daily_hr"),
    ),
)
def daily_split(spark, sf):
    return label_splits(hold(tb.daily_hr(spark, sf)))
