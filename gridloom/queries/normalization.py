"""Climatology fits, both normalisations and their inverses."""

from gridloom.operators import normalize as nz
from gridloom.operators.select import at_times
from gridloom.queries.registry import hold, query, r6, with_ctes
from gridloom.session import scratch_path
from gridloom.sources import tables as tb


def _cell_stats(grid: str) -> str:
    return f"SELECT latitude, longitude, avg(t2m) AS mu, stddev_pop(t2m) AS sigma FROM {grid} GROUP BY 1, 2"


def _anomalies(grid: str) -> str:
    value = r6("CASE WHEN sigma = 0 THEN NULL ELSE (t2m - mu) / sigma END")
    return f"""SELECT time, g.latitude, g.longitude, {value} AS t2m FROM {grid} g
        JOIN stats s ON g.latitude = s.latitude AND g.longitude = s.longitude"""


def _noon(spark, sf):
    return hold(at_times(tb.grid_lr(spark, sf))), hold(at_times(tb.grid_hr(spark, sf)))


@query(
    "cell_climatology",
    with_ctes(
        f"SELECT 'hr_t2m' AS data_name, latitude, longitude, {r6('mu')} AS mu, {r6('sigma')} AS sigma FROM stats",
        "hr_noon",
        stats=_cell_stats("hr_noon"),
    ),
)
def cell_climatology(spark, sf):
    return nz.cell_climatology(at_times(tb.grid_hr(spark, sf)), "t2m", "hr_t2m")


@query("standardized_anomalies_fine", with_ctes(_anomalies("hr_noon"), "hr_noon", stats=_cell_stats("hr_noon")))
def standardized_anomalies_fine(spark, sf):
    fine = hold(at_times(tb.grid_hr(spark, sf)))
    s = nz.AnomalyScaler()
    stats = nz.Stats.empty(spark).with_cells(nz.cell_climatology(fine, "t2m", "hr_t2m"), "hr_t2m")
    return s.apply_temperature(stats, fine, "hr")


@query("standardized_anomalies_coarse", with_ctes(_anomalies("lr_noon"), "lr_noon", "hr_noon", stats=_cell_stats("lr_noon")))
def standardized_anomalies_coarse(spark, sf):
    coarse, fine = _noon(spark, sf)
    return nz.normalize_temperature("standardized_anomalies", nz.Stats.empty(spark), coarse, fine)[0]


@query(
    "anomalies_from_training_years",
    with_ctes(_anomalies("hr_noon"), "hr_noon", stats=_cell_stats("(SELECT * FROM hr_noon WHERE time < TIMESTAMP '2000-01-01')")),
)
def anomalies_from_training_years(spark, sf):
    fine = hold(at_times(tb.grid_hr(spark, sf)))
    early = fine.where("time < timestamp_ntz'2000-01-01'")
    _, _, stats = nz.normalize_temperature("standardized_anomalies", nz.Stats.empty(spark), early, early)
    return nz.normalize_temperature("standardized_anomalies", stats, fine, fine, fit=False)[1]


@query(
    "anomalies_restored",
    with_ctes(
        f"""SELECT time, g.latitude, g.longitude, {r6('CASE WHEN sigma = 0 THEN NULL ELSE t2m END')} AS t2m FROM hr_noon g
            JOIN stats s ON g.latitude = s.latitude AND g.longitude = s.longitude""",
        "hr_noon",
        stats=_cell_stats("hr_noon"),
    ),
)
def anomalies_restored(spark, sf):
    fine = hold(at_times(tb.grid_hr(spark, sf)))
    _, normal, stats = nz.normalize_temperature("standardized_anomalies", nz.Stats.empty(spark), fine, fine)
    return nz.AnomalyScaler().inverse(stats, normal, "t2m", "hr")


def _global(centre: str, width: str) -> str:
    def scaled(v: str) -> str:
        c, w = (f"(SELECT {e.format(v=v)} FROM static_lr)" for e in (centre, width))
        return r6(f"({v} - {c}) / nullif({w}, 0)")

    return f"SELECT time, latitude, longitude, {scaled('lsm')} AS lsm, {scaled('z')} AS z FROM static_lr"


@query("normalized_features", with_ctes(_global("avg({v})", "stddev_pop({v})"), "static_lr"))
def normalized_features(spark, sf):
    static = hold(tb.static_lr(spark, sf))
    return nz.normalize_features("standardized_anomalies", nz.Stats.empty(spark), static, ["lsm", "z"])[0]


@query("min_max_features", with_ctes(_global("min({v})", "max({v}) - min({v})"), "static_lr"))
def min_max_features(spark, sf):
    static = hold(tb.static_lr(spark, sf))
    return nz.normalize_features("min_max", nz.Stats.empty(spark), static, ["lsm", "z"])[0]


@query(
    "global_feature_stats",
    with_ctes(
        " UNION ALL ".join(
            f"""SELECT 'lr_{v}' AS data_name, {r6(f'avg({v})')} AS mu, {r6(f'stddev_pop({v})')} AS sigma,
                {r6(f'min({v})')} AS xmin, {r6(f'max({v})')} AS xmax FROM static_lr"""
            for v in ("lsm", "z")
        ),
        "static_lr",
    ),
)
def global_feature_stats(spark, sf):
    return nz.global_stats(tb.static_lr(spark, sf), ["lsm", "z"], "lr_")


_SCALED = r6("(t2m - (SELECT min(t2m) FROM hr_noon)) / ((SELECT max(t2m) FROM hr_noon) - (SELECT min(t2m) FROM hr_noon))")


@query("min_max_temperature", with_ctes(f"SELECT time, latitude, longitude, {_SCALED} AS t2m FROM hr_noon", "hr_noon"))
def min_max_temperature(spark, sf):
    coarse, fine = _noon(spark, sf)
    return nz.normalize_temperature("min_max", nz.Stats.empty(spark), coarse, fine)[1]


@query("min_max_restored", with_ctes(f"SELECT time, latitude, longitude, {r6('t2m')} AS t2m FROM lr_noon", "lr_noon"))
def min_max_restored(spark, sf):
    coarse, fine = _noon(spark, sf)
    normal, _, stats = nz.normalize_temperature("min_max", nz.Stats.empty(spark), coarse, fine)
    return nz.MinMaxScaler().inverse(stats, normal, "t2m", "lr")


@query(
    "min_max_orography_restored",
    with_ctes(
        f"""SELECT time, latitude, longitude, {r6('lsm')} AS lsm,
            {r6('orog * ((SELECT max(z) FROM static_lr) - (SELECT min(z) FROM static_lr)) + (SELECT min(z) FROM static_lr)')} AS orog
            FROM static_hr""",
        "static_lr",
        "static_hr",
    ),
)
def min_max_orography_restored(spark, sf):
    _, stats = nz.normalize_features("min_max", nz.Stats.empty(spark), tb.static_lr(spark, sf), ["lsm", "z"])
    return nz.MinMaxScaler().inverse(stats, tb.static_hr(spark, sf), "orog", "lr")


@query(
    "stats_round_trip",
    with_ctes(
        f"""SELECT 'hr_t2m' AS data_name, latitude, longitude, {r6('avg(t2m)')} AS mu, {r6('stddev_pop(t2m)')} AS sigma
            FROM hr_noon GROUP BY 2, 3 UNION ALL
            SELECT 'lr_t2m', latitude, longitude, {r6('avg(t2m)')}, {r6('stddev_pop(t2m)')} FROM lr_noon GROUP BY 2, 3""",
        "hr_noon",
        "lr_noon",
    ),
)
def stats_round_trip(spark, sf):
    coarse, fine = _noon(spark, sf)
    stats = nz.AnomalyScaler().fit_temperature(nz.Stats.empty(spark), coarse, fine)
    path = scratch_path(spark, "stats")
    stats.save(path)
    return nz.Stats.load(spark, path).cells


@query(
    "denormalized_dataset",
    with_ctes(
        f"""SELECT time, g.latitude, g.longitude, {r6('CASE WHEN h.sigma = 0 THEN NULL ELSE (t2m - h.mu) / h.sigma * l.sigma + l.mu END')} AS t2m
            FROM hr_noon g JOIN h ON g.latitude = h.latitude AND g.longitude = h.longitude
            LEFT JOIN l ON g.latitude = l.latitude AND g.longitude = l.longitude""",
        "hr_noon",
        "lr_noon",
        h=_cell_stats("hr_noon"),
        l=_cell_stats("lr_noon"),
    ),
)
def denormalized_dataset(spark, sf):
    """Fine anomalies restored with the saved coarse statistics of the same cells; cells without them stay, as NULL."""
    coarse, fine = _noon(spark, sf)
    _, normal, stats = nz.normalize_temperature("standardized_anomalies", nz.Stats.empty(spark), coarse, fine)
    path = scratch_path(spark, "stats")
    stats.save(path)
    return nz.denormalize_dataset("standardized_anomalies", normal, "lr", path)
