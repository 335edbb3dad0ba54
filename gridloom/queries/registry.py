"""Named queries over the given tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.session import stage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NOON = "extract(hour FROM time) = 12"
# Crop used on the 12 x 12 test grid: leaves 8 x 8 cells.
TEST_REGION = (8.0, 44.05, 8.45, 44.5)
TEST_FACTOR = 4


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: doubles to 6 decimals, whole numbers as bigint."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind in ("double", "float"):
            col = F.round(col.cast("double"), 6)
        elif kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint")
        elif kind == "array<double>":
            col = F.transform(col, lambda x: F.round(x, 6))
        out.append(col.alias(name))
    return df.select(*out)


def hold(df: DataFrame) -> DataFrame:
    """Stage a derived grid that a query reads more than once."""
    return stage(df, "grid")


def r6(expr: str) -> str:
    """Rounded value without a negative zero."""
    return f"(round({expr}, 6) + 0e0)"


def _lineitem(time: str, step: str, n: int) -> str:
    return f"""SELECT CAST({time} AS TIMESTAMP) AS time,
       CAST(round(44 + {step}*(l_suppkey % {n}), 2) AS DOUBLE) AS latitude,
       CAST(round( 8 + {step}*(l_partkey % {n}), 2) AS DOUBLE) AS longitude,
       250 + sum(l_quantity)/count(*) AS t2m
     FROM lineitem GROUP BY 1, 2, 3"""


def _part(step: str, n: int, values: str) -> str:
    return f"""SELECT CAST('2018-01-01 12:00:00' AS TIMESTAMP) AS time,
       CAST(round(44 + {step}*(floor(p_partkey/{n}) % {n}), 2) AS DOUBLE) AS latitude,
       CAST(round( 8 + {step}*(p_partkey % {n}), 2) AS DOUBLE) AS longitude,
       sum(CASE WHEN p_size > 25 THEN 1e0 ELSE 0e0 END)/count(*) AS lsm, {values}
     FROM part GROUP BY 1, 2, 3"""


_QUARTER = "date_trunc('quarter', l_shipdate) + (l_linenumber % 8) * INTERVAL '3' HOUR"

GRIDS = {
    "grid_hr": _lineitem(_QUARTER, "0.05", 12),
    "grid_lr": _lineitem(_QUARTER, "0.20", 3),
    "static_hr": _part("0.05", 12, "sum(CAST(p_size AS DOUBLE))/count(*) AS orog"),
    "static_lr": _part("0.20", 3, "9.80665e0*sum(CAST(p_size AS DOUBLE))/count(*) AS z"),
    "daily_hr": _lineitem("date_trunc('day', l_shipdate) + INTERVAL '12' HOUR", "0.05", 32),
    "daily_lr": _lineitem("date_trunc('day', l_shipdate) + INTERVAL '12' HOUR", "0.25", 7),
    "grid_lr_gap": """SELECT time, latitude, longitude,
       CASE WHEN latitude = 44.2e0 AND longitude = 8.2e0 AND extract(month FROM time) IN (1, 7)
            THEN NULL ELSE t2m END AS t2m FROM grid_lr""",
    "hr_noon": f"SELECT * FROM grid_hr WHERE {NOON}",
    "lr_noon": f"SELECT * FROM grid_lr WHERE {NOON}",
    "pair": """SELECT h.time, h.latitude, h.longitude, h.t2m AS y_true, c.mu AS y_pred
     FROM hr_noon h JOIN (SELECT latitude, longitude, avg(t2m) AS mu FROM hr_noon GROUP BY 1, 2) c
       ON h.latitude = c.latitude AND h.longitude = c.longitude""",
}
_NEEDS = {
    "grid_lr_gap": ["grid_lr"],
    "hr_noon": ["grid_hr"],
    "lr_noon": ["grid_lr"],
    "pair": ["grid_hr", "hr_noon"],
}


def with_ctes(body: str, *names: str, **extra: str) -> str:
    """``WITH`` the named test grids (and what they build on) and extra CTEs, then ``body``."""
    wanted: list[str] = []
    for name in names:
        for n in [*_NEEDS.get(name, []), name]:
            if n not in wanted:
                wanted.append(n)
    parts = [f"{n} AS MATERIALIZED ({GRIDS[n]})" for n in wanted]
    parts += [f"{n} AS MATERIALIZED ({s})" for n, s in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def regrid_ctes(source: str, lat_axis: str, lon_axis: str, prefix: str = "rg", value: str = "t2m") -> dict[str, str]:
    """CTEs that put ``source`` on the axes; the result is ``<prefix>``.

    Two passes of lines through neighbouring known points, ends extended, lone points kept.
    """

    def known(src: str, lane: str, x: str) -> str:
        return f"""SELECT time, {lane}, {x} AS x0, v AS y0,
            lead({x}) OVER (PARTITION BY time, {lane} ORDER BY {x}) AS x1,
            lead(v) OVER (PARTITION BY time, {lane} ORDER BY {x}) AS y1,
            row_number() OVER (PARTITION BY time, {lane} ORDER BY {x}) AS rn,
            count(*) OVER (PARTITION BY time, {lane}) AS n
          FROM {src} WHERE v IS NOT NULL"""

    def fill(src: str, lane: str, x: str, axis: str) -> str:
        return f"""SELECT k.time, k.{lane}, h.{x},
            CASE WHEN h.{x} = x0 THEN y0 WHEN h.{x} = x1 THEN y1
                 ELSE y0 + (y1 - y0) * (h.{x} - x0) / (x1 - x0) END AS v
          FROM {src} k JOIN {axis} h
            ON (n = 1 AND h.{x} = x0)
            OR (n > 1 AND rn < n AND (rn = 1 OR h.{x} >= x0) AND (rn = n - 1 OR h.{x} < x1))"""

    on_axes = f"""SELECT time, latitude, longitude, {value} AS v FROM {source}
        WHERE latitude IN (SELECT latitude FROM {lat_axis})
          AND longitude IN (SELECT longitude FROM {lon_axis})"""
    return {
        f"{prefix}_on": on_axes,
        f"{prefix}_k1": known(f"{prefix}_on", "latitude", "longitude"),
        f"{prefix}_p1": fill(f"{prefix}_k1", "latitude", "longitude", lon_axis),
        f"{prefix}_k2": known(f"{prefix}_p1", "longitude", "latitude"),
        f"{prefix}_p2": fill(f"{prefix}_k2", "longitude", "latitude", lat_axis),
        prefix: f"""SELECT t.time, a.latitude, o.longitude, p.v AS {value}
          FROM (SELECT DISTINCT time FROM {source}) t CROSS JOIN {lat_axis} a CROSS JOIN {lon_axis} o
          LEFT JOIN {prefix}_p2 p
            ON p.time = t.time AND p.latitude = a.latitude AND p.longitude = o.longitude""",
    }


def axes_ctes(grid: str) -> dict[str, str]:
    return {
        "ax_lat": f"SELECT DISTINCT latitude FROM {grid}",
        "ax_lon": f"SELECT DISTINCT longitude FROM {grid}",
    }


def crop_ctes(grid: str, factor: int = TEST_FACTOR, region: tuple = TEST_REGION, prefix: str = "") -> dict[str, str]:
    """Axes <prefix>ax_lat / <prefix>ax_lon left by the region and the divisible crop."""
    lon0, lat0, lon1, lat1 = region

    def axis(dim: str, lo: float, hi: float) -> str:
        return f"""SELECT {dim} FROM (
            SELECT {dim}, row_number() OVER (ORDER BY {dim}) - 1 AS i, count(*) OVER () AS n
            FROM (SELECT DISTINCT {dim} FROM {grid}
                  WHERE latitude BETWEEN {lat0}e0 AND {lat1}e0 AND longitude BETWEEN {lon0}e0 AND {lon1}e0))
          WHERE i >= (n - (n // {factor}) * {factor}) // 2
            AND i < (n - (n // {factor}) * {factor}) // 2 + (n // {factor}) * {factor}"""

    return {
        f"{prefix}ax_lat": axis("latitude", lat0, lat1),
        f"{prefix}ax_lon": axis("longitude", lon0, lon1),
    }


def split_ctes(grid: str, name: str = "cuts") -> dict[str, str]:
    """(n, n_test, n_val, first_val, first_test) of a grid's distinct times."""
    return {
        f"{name}_t": f"""SELECT time, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n
            FROM (SELECT DISTINCT time FROM {grid})""",
        f"{name}_n": f"""SELECT n, n_test, CAST(ceil(0.11e0 * (n - n_test)) AS BIGINT) AS n_val
            FROM (SELECT DISTINCT n, CAST(ceil(0.11e0 * n) AS BIGINT) AS n_test FROM {name}_t)""",
        name: f"""SELECT min(CASE WHEN i >= c.n - n_test - n_val THEN time END) AS first_val,
                         min(CASE WHEN i >= c.n - n_test THEN time END) AS first_test
            FROM {name}_t t CROSS JOIN {name}_n c""",
    }
