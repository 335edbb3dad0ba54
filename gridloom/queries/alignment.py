"""Reindexing, regridding and joins between grids."""

from pyspark.sql import functions as F

from gridloom.operators import align, regrid as rg, weights as wt
from gridloom.operators.axes import GridAxes
from gridloom.operators.select import at_times
from gridloom.queries.registry import axes_ctes, hold, query, r6, regrid_ctes, with_ctes
from gridloom.sources import tables as tb


def _noon_axes(spark, sf):
    return GridAxes.of(at_times(tb.grid_hr(spark, sf)))


def _dense(source: str, value: str = "t2m") -> str:
    return f"""SELECT t.time, a.latitude, o.longitude, {r6('g.' + value)} AS {value}
        FROM (SELECT DISTINCT time FROM {source}) t CROSS JOIN ax_lat a CROSS JOIN ax_lon o
        LEFT JOIN {source} g ON g.time = t.time AND g.latitude = a.latitude AND g.longitude = o.longitude"""


@query("reindex_coarse_to_fine", with_ctes(_dense("lr_noon"), "hr_noon", "lr_noon", **axes_ctes("hr_noon")))
def reindex_coarse_to_fine(spark, sf):
    return rg.reindex(at_times(tb.grid_lr(spark, sf)), _noon_axes(spark, sf), ["t2m"])


@query("densify_grid_whole", with_ctes(_dense("grid_hr"), "grid_hr", **axes_ctes("grid_hr")))
def densify_grid_whole(spark, sf):
    """All timesteps of the grid."""
    return rg.densify(hold(tb.grid_hr(spark, sf)), ["t2m"])


_REGRIDDED = f"SELECT time, latitude, longitude, {r6('t2m')} AS t2m FROM rg"


@query(
    "regrid_linear",
    with_ctes(_REGRIDDED, "hr_noon", "lr_noon", **axes_ctes("hr_noon"), **regrid_ctes("lr_noon", "ax_lat", "ax_lon")),
)
def regrid_linear(spark, sf):
    return rg.regrid(at_times(tb.grid_lr(spark, sf)), _noon_axes(spark, sf), ["t2m"])


@query(
    "regrid_by_lane",
    with_ctes(_REGRIDDED, "hr_noon", "lr_noon", **axes_ctes("hr_noon"), **regrid_ctes("lr_noon", "ax_lat", "ax_lon")),
)
def regrid_by_lane(spark, sf):
    return rg.regrid(at_times(tb.grid_lr(spark, sf)), _noon_axes(spark, sf), ["t2m"], cluster="lane")


@query(
    "regrid_with_gaps",
    with_ctes(
        _REGRIDDED,
        "hr_noon",
        "grid_lr_gap",
        gap_noon="SELECT * FROM grid_lr_gap WHERE extract(hour FROM time) = 12",
        **axes_ctes("hr_noon"),
        **regrid_ctes("gap_noon", "ax_lat", "ax_lon"),
    ),
)
def regrid_with_gaps(spark, sf):
    return rg.regrid(at_times(tb.grid_lr_gap(spark, sf)), _noon_axes(spark, sf), ["t2m"])


@query(
    "regrid_static_fields",
    with_ctes(
        f"""SELECT l.time, l.latitude, l.longitude, {r6('l.lsm')} AS lsm, {r6('z.z')} AS z FROM rl l JOIN rz z
            ON l.latitude = z.latitude AND l.longitude = z.longitude""",
        "static_hr",
        "static_lr",
        **axes_ctes("static_hr"),
        **regrid_ctes("static_lr", "ax_lat", "ax_lon", "rl", "lsm"),
        **regrid_ctes("static_lr", "ax_lat", "ax_lon", "rz", "z"),
    ),
)
def regrid_static_fields(spark, sf):
    axes = GridAxes.of(tb.static_hr(spark, sf))
    return rg.regrid(tb.static_lr(spark, sf), axes, ["lsm", "z"], cluster="lane")


def _nearest(source: str, lane: str, x: str, axis: str) -> str:
    """Nearest known point of a lane, the lower one of two equally near; a lone point stays where it is."""
    return f"""SELECT time, {lane}, {x}, v FROM (
        SELECT g.time, g.{lane}, h.{x}, g.v, g.n, g.{x} AS x0, row_number() OVER (PARTITION BY g.time, g.{lane}, h.{x}
          ORDER BY round(abs(g.{x} - h.{x}), 6), g.{x}) AS rn
        FROM (SELECT *, count(*) OVER (PARTITION BY time, {lane}) AS n FROM {source} WHERE v IS NOT NULL) g CROSS JOIN {axis} h)
      WHERE CASE WHEN n = 1 THEN {x} = x0 ELSE rn = 1 END"""


@query(
    "regrid_nearest",
    with_ctes(
        f"""SELECT t.time, a.latitude, o.longitude, {r6('p.v')} AS t2m
            FROM (SELECT DISTINCT time FROM grid_lr) t CROSS JOIN ax_lat a CROSS JOIN ax_lon o
            LEFT JOIN near2 p ON p.time = t.time AND p.latitude = a.latitude AND p.longitude = o.longitude""",
        "hr_noon",
        "grid_lr",
        **axes_ctes("hr_noon"),
        known="""SELECT time, latitude, longitude, t2m AS v FROM grid_lr
            WHERE latitude IN (SELECT latitude FROM ax_lat) AND longitude IN (SELECT longitude FROM ax_lon)""",
        near1=_nearest("known", "latitude", "longitude", "ax_lon"),
        near2=_nearest("near1", "longitude", "latitude", "ax_lat"),
    ),
)
def regrid_nearest(spark, sf):
    return rg.regrid(tb.grid_lr(spark, sf), _noon_axes(spark, sf), ["t2m"], method="nearest")


@query(
    "gap_fill_along_longitude_whole",
    with_ctes(
        f"""SELECT d.time, d.latitude, o.longitude, {r6('p.v')} AS t2m FROM
            (SELECT DISTINCT time, latitude FROM grid_hr) d CROSS JOIN ax_lon o LEFT JOIN rg_p1 p
            ON p.time = d.time AND p.latitude = d.latitude AND p.longitude = o.longitude""",
        "grid_hr",
        **axes_ctes("grid_hr"),
        **{k: v for k, v in regrid_ctes("grid_hr", "ax_lat", "ax_lon").items() if k in ("rg_on", "rg_k1", "rg_p1")},
    ),
)
def gap_fill_along_longitude_whole(spark, sf):
    """All timesteps of the grid."""
    return rg.interpolate_gaps(hold(tb.grid_hr(spark, sf)), "longitude", "t2m")


@query(
    "combine_static_features",
    with_ctes(
        f"""SELECT g.time, g.latitude, g.longitude, {r6('g.t2m')} AS t2m, {r6('s.lsm')} AS lsm, {r6('s.z')} AS z
            FROM grid_lr g LEFT JOIN static_lr s ON g.latitude = s.latitude AND g.longitude = s.longitude""",
        "grid_lr",
        "static_lr",
    ),
)
def combine_static_features(spark, sf):
    return align.combine_static(tb.grid_lr(spark, sf), tb.static_lr(spark, sf), ["lsm", "z"], strict=True)


@query(
    "paired_samples",
    with_ctes(
        f"""SELECT h.time, h.latitude, h.longitude, {r6('h.t2m')} AS y_true, {r6('r.t2m')} AS y_pred
            FROM hr_noon h JOIN rg r ON h.time = r.time AND h.latitude = r.latitude AND h.longitude = r.longitude""",
        "hr_noon",
        "lr_noon",
        **axes_ctes("hr_noon"),
        **regrid_ctes("lr_noon", "ax_lat", "ax_lon"),
    ),
)
def paired_samples(spark, sf):
    fine = hold(at_times(tb.grid_hr(spark, sf)))
    return align.pair_samples(fine, rg.regrid(at_times(tb.grid_lr(spark, sf)), GridAxes.of(fine), ["t2m"]))


@query(
    "unpaired_times",
    with_ctes(
        """SELECT coalesce(a.time, b.time) AS time, CASE WHEN b.time IS NULL THEN 'lr' ELSE 'hr' END AS only_in
           FROM (SELECT DISTINCT time FROM grid_lr) a FULL JOIN
                (SELECT DISTINCT time FROM daily_hr) b ON a.time = b.time
           WHERE a.time IS NULL OR b.time IS NULL""",
        "daily_hr",
        "grid_lr",
    ),
)
def unpaired_times(spark, sf):
    """Three-hourly times of the first days of the quarters against daily noons."""
    return align.unpaired_times(tb.grid_lr(spark, sf), tb.daily_hr(spark, sf))


@query(
    "unpaired_cells",
    with_ctes(
        """SELECT *, 'lr' AS only_in FROM (SELECT time, latitude, longitude FROM grid_lr EXCEPT SELECT time, latitude, longitude FROM grid_hr)
           UNION ALL
           SELECT *, 'hr' FROM (SELECT time, latitude, longitude FROM grid_hr EXCEPT SELECT time, latitude, longitude FROM grid_lr)""",
        "grid_hr",
        "grid_lr",
    ),
)
def unpaired_cells(spark, sf):
    return align.unpaired_cells(tb.grid_lr(spark, sf), tb.grid_hr(spark, sf))


@query(
    "regrid_lane_counts",
    with_ctes(
        f"""SELECT time, CAST(count(*) AS BIGINT) AS cells, CAST(count(t2m) AS BIGINT) AS filled, {r6('avg(t2m)')} AS mean_t2m
            FROM rg GROUP BY time""",
        "hr_noon",
        "grid_lr",
        **axes_ctes("hr_noon"),
        **regrid_ctes("grid_lr", "ax_lat", "ax_lon"),
    ),
)
def regrid_lane_counts(spark, sf):
    cells = rg.regrid(tb.grid_lr(spark, sf), _noon_axes(spark, sf), ["t2m"])
    return cells.groupBy("time").agg(
        F.count("*").alias("cells"), F.count("t2m").alias("filled"), F.avg("t2m").alias("mean_t2m")
    )


def _by_weights(source: str) -> str:
    # The small addend keeps exact halves of the last digit from rounding either way.
    return f"SELECT time, latitude, longitude, {r6('t2m + 1e-8')} AS t2m FROM {source}"


@query(
    "regrid_by_weights",
    with_ctes(_by_weights("rg"), "grid_hr", "grid_lr_gap", **axes_ctes("grid_hr"), **regrid_ctes("grid_lr_gap", "ax_lat", "ax_lon")),
)
def regrid_by_weights(spark, sf):
    """Whole timesteps by weights, those without the centre cell by the walk."""
    coarse = hold(tb.grid_lr_gap(spark, sf))
    table = wt.WeightTable.of(GridAxes.of(coarse), GridAxes.of(tb.grid_hr(spark, sf)))
    return wt.regrid_by_weights(coarse, table, ["t2m"]).withColumn("t2m", F.col("t2m") + 1e-8)


@query(
    "daily_regrid_by_weights",
    with_ctes(_by_weights("rg"), "daily_hr", "daily_lr", **axes_ctes("daily_hr"), **regrid_ctes("daily_lr", "ax_lat", "ax_lon")),
)
def daily_regrid_by_weights(spark, sf):
    """The daily grids: most days of small inputs lack some points, few of large ones."""
    coarse = hold(tb.daily_lr(spark, sf))
    table = wt.WeightTable.of(GridAxes.of(coarse), GridAxes.of(tb.daily_hr(spark, sf)))
    return wt.regrid_by_weights(coarse, table, ["t2m"]).withColumn("t2m", F.col("t2m") + 1e-8)


@query(
    "regrid_weight_sums",
    with_ctes(
        f"""SELECT 'latitude' AS dim, count(*) AS targets, {r6('count(*)')} AS weight FROM ax_lat UNION ALL
            SELECT 'longitude', count(*), {r6('count(*)')} FROM ax_lon""",
        "grid_hr",
        **axes_ctes("grid_hr"),
    ),
)
def regrid_weight_sums(spark, sf):
    """Every target position is covered and its weights add up to one."""
    table = wt.WeightTable.of(GridAxes.of(tb.grid_lr(spark, sf)), GridAxes.of(tb.grid_hr(spark, sf))).table
    return table.groupBy("dim").agg(F.countDistinct("idx").alias("targets"), F.sum("weight").alias("weight"))
