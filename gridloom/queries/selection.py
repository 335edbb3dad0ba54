"""Filters, crops, projections, axes and sorts."""

from pyspark.sql import functions as F

from gridloom.functions import channels, hhmm
from gridloom.operators import axes as ax, select as sel
from gridloom.operators.tiles import from_tiles, tile_cells, to_tiles
from gridloom.queries.registry import (
    GRIDS,
    NOON,
    TEST_FACTOR,
    TEST_REGION,
    axes_ctes,
    crop_ctes,
    hold,
    query,
    r6,
    with_ctes,
)
from gridloom.schema import TEMPERATURE_ATTRS
from gridloom.sources import tables as tb

CELLS = f"time, latitude, longitude, {r6('t2m')} AS t2m"
IN_REGION = (
    f"longitude BETWEEN {TEST_REGION[0]}e0 AND {TEST_REGION[2]}e0 AND latitude BETWEEN {TEST_REGION[1]}e0 AND {TEST_REGION[3]}e0"
)


@query("region_crop", with_ctes(f"SELECT {CELLS} FROM grid_hr WHERE {IN_REGION}", "grid_hr"))
def region_crop(spark, sf):
    return sel.crop_to_region(tb.grid_hr(spark, sf), TEST_REGION)


@query(
    "divisible_crop",
    with_ctes(
        f"""SELECT {CELLS} FROM hr_noon WHERE latitude IN (SELECT latitude FROM ax_lat)
            AND longitude IN (SELECT longitude FROM ax_lon)""",
        "hr_noon",
        **crop_ctes("hr_noon"),
    ),
)
def divisible_crop(spark, sf):
    noon = hold(sel.at_times(tb.grid_hr(spark, sf)))
    return sel.crop_spatial(noon, TEST_REGION, TEST_FACTOR)


@query(
    "crop_coarse_to_fine",
    with_ctes(
        f"""SELECT {CELLS} FROM grid_lr WHERE latitude BETWEEN (SELECT min(latitude) FROM grid_hr WHERE {IN_REGION})
              AND (SELECT max(latitude) FROM grid_hr WHERE {IN_REGION})
            AND longitude BETWEEN (SELECT min(longitude) FROM grid_hr WHERE {IN_REGION})
              AND (SELECT max(longitude) FROM grid_hr WHERE {IN_REGION})""",
        "grid_hr",
        "grid_lr",
    ),
)
def crop_coarse_to_fine(spark, sf):
    fine = sel.crop_to_region(tb.grid_hr(spark, sf), TEST_REGION)
    return sel.crop_to_extent([tb.grid_lr(spark, sf)], fine)[0]


@query("noon_filter", with_ctes(f"SELECT {CELLS} FROM grid_hr WHERE {NOON}", "grid_hr"))
def noon_filter(spark, sf):
    return sel.at_times(tb.grid_hr(spark, sf))


@query(
    "several_times_filter",
    with_ctes(f"SELECT {CELLS} FROM grid_hr WHERE strftime(time, '%H:%M') IN ('06:00', '18:00')", "grid_hr"),
)
def several_times_filter(spark, sf):
    return sel.at_times(tb.grid_hr(spark, sf), ["06:00", "18:00"])


@query(
    "events_noon",
    "SELECT event_id, ts, value FROM events WHERE strftime(ts, '%H:%M') = '12:00'",
)
def events_noon(spark, sf):
    events = tb.table(spark, sf, "events").select("event_id", "ts", "value")
    return events.where(hhmm("ts") == "12:00")


@query(
    "time_of_day_labels",
    with_ctes("SELECT strftime(time, '%H:%M') AS hhmm, CAST(count(*) AS BIGINT) AS n FROM grid_hr GROUP BY 1", "grid_hr"),
)
def time_of_day_labels(spark, sf):
    return sel.time_labels(tb.grid_hr(spark, sf)).groupBy("hhmm").agg(F.count("*").alias("n"))


@query("first_time_slice", with_ctes(f"SELECT {CELLS} FROM grid_hr WHERE time = (SELECT min(time) FROM grid_hr)", "grid_hr"))
def first_time_slice(spark, sf):
    return sel.first_time(tb.grid_hr(spark, sf))


@query(
    "times_by_position",
    with_ctes(
        f"""SELECT {CELLS} FROM grid_hr WHERE time IN (SELECT time FROM
            (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM (SELECT DISTINCT time FROM grid_hr))
            WHERE i IN (0, 3, 17, 64))""",
        "grid_hr",
    ),
)
def times_by_position(spark, sf):
    return sel.take_times(hold(tb.grid_hr(spark, sf)), [0, 3, 17, 64])


@query(
    "times_by_label",
    with_ctes(f"SELECT {CELLS} FROM grid_hr WHERE time IN (SELECT time FROM grid_lr WHERE t2m > 279)", "grid_hr", "grid_lr"),
)
def times_by_label(spark, sf):
    warm = tb.grid_lr(spark, sf).where("t2m > 279").select("time").distinct()
    return sel.select_times(tb.grid_hr(spark, sf), hold(warm))


@query(
    "variable_projection",
    with_ctes(
        f"SELECT time, latitude, longitude, {r6('t2m - 273.15e0')} AS t2m, {r6('t2m * 1.8e0 - 459.67e0')} AS fahrenheit FROM grid_hr",
        "grid_hr",
    ),
)
def variable_projection(spark, sf):
    grid = sel.pick_variables(tb.grid_hr(spark, sf), ["t2m"])
    return sel.replace_variables(grid, t2m=F.col("t2m") - 273.15, fahrenheit=F.col("t2m") * 1.8 - 459.67)


@query(
    "flat_value_counts",
    with_ctes(f"SELECT {r6('t2m')} AS t2m, CAST(count(*) AS BIGINT) AS n FROM grid_hr GROUP BY t2m", "grid_hr"),
)
def flat_value_counts(spark, sf):
    grid = tb.grid_hr(spark, sf).select(sel.with_attrs(None, "t2m", TEMPERATURE_ATTRS))
    return sel.flat_values(grid, "t2m").groupBy("t2m").agg(F.count("*").alias("n"))


@query(
    "channel_stack",
    with_ctes(
        f"""SELECT g.time, g.latitude, g.longitude, [{r6('g.t2m')}, {r6('s.lsm')}, {r6('s.z')}] AS features
            FROM grid_lr g JOIN static_lr s ON g.latitude = s.latitude AND g.longitude = s.longitude""",
        "grid_lr",
        "static_lr",
    ),
)
def channel_stack(spark, sf):
    from gridloom.operators.align import combine_static

    data = combine_static(tb.grid_lr(spark, sf), tb.static_lr(spark, sf), ["lsm", "z"])
    return data.select("time", "latitude", "longitude", channels("t2m", "lsm", "z").alias("features"))


_TILE_SQL = """SELECT t.time, a.i AS row, o.i AS col, {v} AS value
    FROM (SELECT DISTINCT time FROM hr_noon) t
    CROSS JOIN (SELECT latitude, row_number() OVER (ORDER BY latitude DESC) - 1 AS i FROM ax_lat) a
    CROSS JOIN (SELECT longitude, row_number() OVER (ORDER BY longitude) - 1 AS i FROM ax_lon) o
    LEFT JOIN hr_noon h ON h.time = t.time AND h.latitude = a.latitude AND h.longitude = o.longitude"""


@query(
    "tile_layout_whole", with_ctes(_TILE_SQL.format(v=r6("h.t2m")).replace("hr_noon", "grid_hr"), "grid_hr", **axes_ctes("grid_hr"))
)
def tile_layout_whole(spark, sf):
    """All timesteps of the grid."""
    return tile_cells(to_tiles(hold(tb.grid_hr(spark, sf)), ["t2m"]))


@query(
    "tile_round_trip_small_tiles",
    with_ctes(
        f"""SELECT t.time, a.latitude, o.longitude, {r6('h.t2m')} AS t2m
            FROM (SELECT DISTINCT time FROM grid_hr) t CROSS JOIN ax_lat a CROSS JOIN ax_lon o
            LEFT JOIN grid_hr h ON h.time = t.time AND h.latitude = a.latitude AND h.longitude = o.longitude""",
        "grid_hr",
        **axes_ctes("grid_hr"),
    ),
)
def tile_round_trip_small_tiles(spark, sf):
    """Tiles of 5 x 5 cells, which do not divide the axes."""
    grid = hold(tb.grid_hr(spark, sf))
    axes = ax.GridAxes.of(grid)
    return from_tiles(to_tiles(grid, ["t2m"], axes, size=5), axes, size=5)


@query(
    "tile_round_trip_whole",
    with_ctes(
        f"""SELECT t.time, a.latitude, o.longitude, {r6('h.t2m')} AS t2m
            FROM (SELECT DISTINCT time FROM grid_hr) t CROSS JOIN ax_lat a CROSS JOIN ax_lon o
            LEFT JOIN grid_hr h ON h.time = t.time AND h.latitude = a.latitude AND h.longitude = o.longitude""",
        "grid_hr",
        **axes_ctes("grid_hr"),
    ),
)
def tile_round_trip_whole(spark, sf):
    """All timesteps of the grid."""
    grid = hold(tb.grid_hr(spark, sf))
    axes = ax.GridAxes.of(grid)
    return from_tiles(to_tiles(grid, ["t2m"], axes), axes)


@query(
    "axis_position_columns",
    with_ctes(
        f"""SELECT time, latitude, longitude, {r6('t2m')} AS t2m, dense_rank() OVER (ORDER BY latitude) - 1 AS lat_idx,
            dense_rank() OVER (ORDER BY longitude) - 1 AS lon_idx FROM grid_hr""",
        "grid_hr",
    ),
)
def axis_position_columns(spark, sf):
    return ax.axis_positions(hold(tb.grid_hr(spark, sf)))


@query(
    "chronological_time_axis",
    with_ctes(
        "SELECT time, row_number() OVER (ORDER BY time) - 1 AS time_idx FROM (SELECT DISTINCT time FROM grid_hr)", "grid_hr"
    ),
)
def chronological_time_axis(spark, sf):
    return ax.time_axis(tb.grid_hr(spark, sf))


@query(
    "spatial_extent",
    with_ctes(
        """SELECT min(longitude) AS lon_min, min(latitude) AS lat_min, max(longitude) AS lon_max,
           max(latitude) AS lat_max FROM grid_hr""",
        "grid_hr",
    ),
)
def spatial_extent(spark, sf):
    return ax.bounding_box(tb.grid_hr(spark, sf))


@query(
    "input_shape",
    with_ctes(
        """SELECT count(DISTINCT latitude) AS n_lat, count(DISTINCT longitude) AS n_lon, CAST(1 AS BIGINT) AS n_vars
           FROM grid_hr""",
        "grid_hr",
    ),
)
def input_shape(spark, sf):
    return ax.input_shape(tb.grid_hr(spark, sf), ["t2m"])


@query("sorted_axes", with_ctes(f"SELECT {CELLS} FROM grid_lr ORDER BY time, latitude, longitude", "grid_lr"))
def sorted_axes(spark, sf):
    return sel.sort_axes(tb.grid_lr(spark, sf))


@query("north_up_order", with_ctes(f"SELECT {CELLS} FROM grid_lr ORDER BY time, latitude DESC, longitude", "grid_lr"))
def north_up_order(spark, sf):
    return sel.sort_axes(tb.grid_lr(spark, sf), north_up=True)


@query(
    "concat_along_time_whole",
    with_ctes(
        f"""SELECT {CELLS} FROM grid_hr WHERE extract(hour FROM time) <= 12 UNION ALL SELECT {CELLS} FROM grid_hr
            WHERE extract(hour FROM time) >= 6""",
        "grid_hr",
    ),
)
def concat_along_time_whole(spark, sf):
    """Two overlapping pieces that together cover the grid."""
    grid = tb.grid_hr(spark, sf)
    return sel.concat_times(grid.where(F.hour("time") <= 12), grid.where(F.hour("time") >= 6))


@query(
    "dataset_size_report",
    with_ctes(
        f"""SELECT 'lsm' AS variable, count(*) AS n_rows, count(lsm) AS n_values, {r6('count(*) * 8e0 / 1073741824e0')} AS size_gib
            FROM static_lr UNION ALL SELECT 'z', count(*), count(z), {r6('count(*) * 8e0 / 1073741824e0')} FROM static_lr""",
        "static_lr",
    ),
)
def dataset_size_report(spark, sf):
    return ax.dataset_size(tb.static_lr(spark, sf), ["lsm", "z"])


@query(
    "value_peek",
    with_ctes(
        f"SELECT 't2m' AS variable, {r6('max(t2m)')} AS max_value, {r6('min(t2m)')} AS min_value FROM grid_hr", "grid_hr"
    ),
)
def value_peek(spark, sf):
    return ax.value_peek(tb.grid_hr(spark, sf), ["t2m"])


__all__ = ["GRIDS"]
