"""Archives that grow: months published again, climatologies merged from stored moments."""

from datetime import datetime

from pyspark.sql import functions as F

from gridloom.operators.moments import ClimatologyStore
from gridloom.queries.registry import query, r6, with_ctes
from gridloom.session import scratch_path
from gridloom.sources import tables as tb
from gridloom.sources.grids import month_index
from gridloom.sources.regions import RegionArchive
from gridloom.sources.snapshots import SnapshotTable
from gridloom.streaming import land_latest_months

_MONTH = "((extract(year FROM time) * 12 + extract(month FROM time)) - (2006 * 12 + 1))"
_FIXED = {"fixed": f"SELECT time, latitude, longitude, t2m + CASE WHEN {_MONTH} % 2 = 0 THEN 5 ELSE 0 END AS t2m FROM grid_hr"}


def _publish(grid, folder: str) -> None:
    """One file a month."""
    months = grid.withColumn("month", F.date_format("time", "yyyyMM"))
    months.repartition("month").write.partitionBy("month").parquet(folder)


def _landed(spark, sf):
    """All months, then every other one again with corrected values; landed after each."""
    root, target, checkpoint = (scratch_path(spark, n) for n in ("published", "landed", "landing"))
    store = ClimatologyStore(spark, scratch_path(spark, "moments"))
    grid = tb.grid_hr(spark, sf)
    _publish(grid, f"{root}/first")
    land_latest_months(spark, root, target, checkpoint, climatology=store)
    _publish(grid.where(month_index() % 2 == 0).withColumn("t2m", F.col("t2m") + 5), f"{root}/second")
    land_latest_months(spark, root, target, checkpoint, climatology=store)
    return target, store


@query(
    "stream_republished_months",
    with_ctes(f"SELECT time, latitude, longitude, {r6('t2m')} AS t2m, {_MONTH} AS part_idx FROM fixed", "grid_hr", **_FIXED),
)
def stream_republished_months(spark, sf):
    """Corrected months replace the first ones; every row is there once."""
    return spark.read.parquet(_landed(spark, sf)[0])


@query(
    "climatology_of_landed_months",
    with_ctes(
        f"SELECT 'hr_t2m' AS data_name, latitude, longitude, {r6('avg(t2m)')} AS mu, {r6('stddev_pop(t2m)')} AS sigma FROM fixed GROUP BY 2, 3",
        "grid_hr",
        **_FIXED,
    ),
)
def climatology_of_landed_months(spark, sf):
    return _landed(spark, sf)[1].cells("t2m", "hr_t2m")


@query(
    "climatology_without_months",
    with_ctes(
        f"""SELECT 't2m' AS data_name, {r6('avg(t2m)')} AS mu, {r6('stddev_pop(t2m)')} AS sigma, {r6('min(t2m)')} AS xmin, {r6('max(t2m)')} AS xmax
            FROM grid_hr WHERE {_MONTH} NOT IN (-129, -100)""",
        "grid_hr",
    ),
)
def climatology_without_months(spark, sf):
    """Two months taken out again; minimum and maximum follow, which running totals could not."""
    store = ClimatologyStore(spark, scratch_path(spark, "moments"))
    store.land(tb.grid_hr(spark, sf), ["t2m"])
    store.remove([-129, -100])
    return store.scalars(["t2m"])


@query(
    "snapshot_overwrite",
    with_ctes(f"SELECT time, latitude, longitude, {r6('CASE WHEN t2m > 270 THEN t2m - 1 ELSE t2m END')} AS t2m FROM grid_hr", "grid_hr"),
)
def snapshot_overwrite(spark, sf):
    """A dataset overwritten from itself, then cleaned up."""
    table = SnapshotTable(spark, scratch_path(spark, "snapshots"))
    table.write(tb.grid_hr(spark, sf))
    table.write(table.read().withColumn("t2m", F.expr("CASE WHEN t2m > 270 THEN t2m - 1 ELSE t2m END")))
    table.clean(keep=1)
    return table.read()


@query(
    "region_archive_crop",
    with_ctes(
        f"""SELECT time, latitude, longitude, {r6('t2m')} AS t2m FROM daily_hr WHERE latitude BETWEEN 44.2e0 AND 44.6e0
            AND longitude BETWEEN 8.3e0 AND 8.9e0 AND time BETWEEN TIMESTAMP '1994-03-01 00:00:00' AND TIMESTAMP '1996-12-31 23:00:00'""",
        "daily_hr",
    ),
)
def region_archive_crop(spark, sf):
    """A box over some years, out of the files whose ranges touch it."""
    archive = RegionArchive(spark, scratch_path(spark, "regions"), rows_a_file=2000)
    archive.write(tb.daily_hr(spark, sf))
    return archive.read((8.3, 44.2, 8.9, 44.6), datetime(1994, 3, 1), datetime(1996, 12, 31, 23))


@query("region_archive_grown", with_ctes(f"SELECT time, latitude, longitude, {r6('t2m + 1')} AS t2m FROM grid_hr", "grid_hr"))
def region_archive_grown(spark, sf):
    """Every other month, then the rest beside it, then all of it rewritten from itself."""
    archive = RegionArchive(spark, scratch_path(spark, "regions"), rows_a_file=5000)
    grid, even = tb.grid_hr(spark, sf), month_index() % 2 == 0
    archive.write(grid.where(even))
    archive.write(grid.where(~even), append=True)
    archive.write(archive.read().withColumn("t2m", F.col("t2m") + 1), staged=False)
    return archive.read()


@query(
    "region_archive_ranges",
    with_ctes(
        """SELECT count(*) AS n, min(time) AS first, max(time) AS last, min(latitude) AS south, max(latitude) AS north,
                  min(longitude) AS west, max(longitude) AS east FROM grid_hr""",
        "grid_hr",
    ),
)
def region_archive_ranges(spark, sf):
    """Extent of an archive from its manifest alone."""
    archive = RegionArchive(spark, scratch_path(spark, "regions"), rows_a_file=500)
    archive.write(tb.grid_hr(spark, sf))
    ends = [("time", "first", "last"), ("lat", "south", "north"), ("lon", "west", "east")]
    spans = [f for name, low, high in ends for f in (F.min(f"{name}_min").alias(low), F.max(f"{name}_max").alias(high))]
    return archive.manifest().agg(F.sum("n").alias("n"), *spans)
