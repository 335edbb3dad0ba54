"""Block and neighbourhood operators."""

from pyspark.sql import functions as F

from gridloom.operators import raster as ra
from gridloom.operators.axes import axis_positions
from gridloom.queries.registry import hold, query, r6, with_ctes
from gridloom.sources import tables as tb

KERNEL = [[0.5, 1.0, -0.25], [2.0, 3.0, 1.5], [-1.0, 0.75, 0.125]]

_POS = {
    "pos": """SELECT time, latitude, longitude, t2m, dense_rank() OVER (ORDER BY latitude) - 1 AS y,
        dense_rank() OVER (ORDER BY longitude) - 1 AS x FROM grid_hr"""
}
# Every position of every timestep, missing cells as NULL.
_FULL = {
    **_POS,
    "full_grid": """SELECT t.time, y.y, x.x, p.t2m FROM (SELECT DISTINCT time FROM pos) t CROSS JOIN (SELECT DISTINCT y FROM pos) y
        CROSS JOIN (SELECT DISTINCT x FROM pos) x LEFT JOIN pos p ON p.time = t.time AND p.y = y.y AND p.x = x.x""",
}


def _grid(spark, sf):
    return hold(tb.grid_hr(spark, sf))


def _pool_sql(agg: str) -> str:
    return f"""SELECT time, y // 2 AS block_y, x // 2 AS block_x, {r6(f'{agg}(t2m)')} AS t2m FROM pos
        WHERE y // 2 < (SELECT max(y) + 1 FROM pos) // 2 AND x // 2 < (SELECT max(x) + 1 FROM pos) // 2 GROUP BY 1, 2, 3"""


@query("block_max_pool", with_ctes(_pool_sql("max"), "grid_hr", **_POS))
def block_max_pool(spark, sf):
    return ra.block_pool(_grid(spark, sf))


@query("block_mean_pool", with_ctes(_pool_sql("avg"), "grid_hr", **_POS))
def block_mean_pool(spark, sf):
    return ra.block_pool(_grid(spark, sf), how="avg")


def _taps(kernel, origin: int) -> str:
    rows = [f"({r - origin}, {c - origin}, {w}e0)" for r, line in enumerate(kernel) for c, w in enumerate(line)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(dy, dx, w)"


@query(
    "focal_convolution",
    with_ctes(
        f"""SELECT a.time, a.latitude, a.longitude,
              CASE WHEN count(b.t2m) = count(*) THEN {r6('sum(k.w * b.t2m) + 0.5e0')} END AS focal FROM pos a CROSS JOIN taps k
            JOIN full_grid b ON b.time = a.time AND b.y = a.y + k.dy AND b.x = a.x + k.dx GROUP BY 1, 2, 3""",
        "grid_hr",
        **_FULL,
        taps=_taps(KERNEL, 1),
    ),
)
def focal_convolution(spark, sf):
    return ra.convolve(_grid(spark, sf), {"t2m": KERNEL}, bias=0.5)


@query(
    "upsample_bilinear",
    with_ctes(
        f"""SELECT time, 2 * y + dy AS out_y, 2 * x + dx AS out_x,
              CASE WHEN count(t2m) = count(*) THEN {r6('sum(w * t2m) / sum(w)')} END AS t2m FROM full_grid CROSS JOIN taps
            WHERE 2 * y + dy < 2 * (SELECT max(y) + 1 FROM pos) AND 2 * x + dx < 2 * (SELECT max(x) + 1 FROM pos)
            GROUP BY 1, 2, 3 HAVING count(t2m) > 0""",
        "grid_hr",
        **_FULL,
        taps=_taps(ra.BILINEAR, 0),
    ),
)
def upsample_bilinear(spark, sf):
    return ra.upsample(_grid(spark, sf))


@query(
    "channel_concat",
    with_ctes(
        f"""SELECT h.time, h.latitude, h.longitude, {r6('h.t2m')} AS t2m, {r6('2e0 * h.t2m - 500')} AS scaled FROM grid_hr h""",
        "grid_hr",
    ),
)
def channel_concat(spark, sf):
    grid = _grid(spark, sf)
    scaled = grid.select("time", "latitude", "longitude", ra.pointwise({"t2m": 2.0}, -500.0).alias("scaled"))
    return ra.join_channels(grid, scaled)


@query(
    "batch_norm",
    with_ctes(
        f"""SELECT time, latitude, longitude, {r6('(t2m - (SELECT avg(t2m) FROM grid_hr)) / sqrt((SELECT var_pop(t2m) FROM grid_hr) + 0.001e0)')}
            AS t2m FROM grid_hr""",
        "grid_hr",
    ),
)
def batch_norm(spark, sf):
    return ra.batch_norm(_grid(spark, sf))


@query(
    "tanh_activation",
    with_ctes(f"SELECT time, latitude, longitude, {r6('tanh((t2m - 275) / 10)')} AS t2m FROM grid_hr", "grid_hr"),
)
def tanh_activation(spark, sf):
    scaled = tb.grid_hr(spark, sf).withColumn("t2m", (F.col("t2m") - 275) / 10)
    return ra.activate(scaled)


@query(
    "focal_position_check",
    with_ctes(
        "SELECT y AS lat_idx, x AS lon_idx, CAST(count(*) AS BIGINT) AS n FROM pos GROUP BY 1, 2", "grid_hr", **_POS
    ),
)
def focal_position_check(spark, sf):
    return axis_positions(_grid(spark, sf)).groupBy("lat_idx", "lon_idx").agg(F.count("*").alias("n"))


_SMOOTH = [[0.0, 0.5, 0.0], [0.25, 1.0, -0.5], [0.0, 0.125, 0.0]]


def _focal_sql(cells: str, kernel: str, bias: str) -> str:
    """Sums over the present cells, absent ones as zero."""
    return f"""SELECT a.time, a.y, a.x, a.latitude, a.longitude, sum(k.w * coalesce(b.t2m, 0)) + {bias} AS t2m FROM {cells} a CROSS JOIN {kernel} k
        LEFT JOIN {cells} b ON b.time = a.time AND b.y = a.y + k.dy AND b.x = a.x + k.dx GROUP BY 1, 2, 3, 4, 5"""


@query(
    "focal_chain",
    with_ctes(
        f"SELECT time, latitude, longitude, {r6('t2m')} AS t2m FROM second",
        "grid_hr",
        **_POS,
        taps=_taps(KERNEL, 1),
        taps2=_taps(_SMOOTH, 1),
        first=_focal_sql("pos", "taps", "0.5e0"),
        second=_focal_sql("first", "taps2", "-2e0"),
    ),
)
def focal_chain(spark, sf):
    """Two neighbourhood sums in a row with one exchange of the cells."""
    steps = [ra.Stencil({"t2m": KERNEL}, 0.5), ra.Stencil({"t2m": _SMOOTH}, -2.0)]
    return ra.convolve_chain(_grid(spark, sf), steps, "t2m", on_missing="zero")
