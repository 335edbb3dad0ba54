"""Reading, writing, catalogues, streaming landing and run summaries."""

from pyspark.sql import functions as F

from gridloom.operators import evaluate as ev
from gridloom.operators.select import at_times
from gridloom.queries.evaluation import _METRICS
from gridloom.queries.registry import hold, query, r6, with_ctes
from gridloom.session import scratch_path
from gridloom.sources import catalog as cat, grids as gr, runs as rn, tables as tb
from gridloom.streaming import land_months

_ALL = f"SELECT time, latitude, longitude, {r6('t2m')} AS t2m FROM grid_hr"


def _month_dirs(spark, grid) -> tuple[str, list[str]]:
    """Write one directory per calendar month; the month list is as short as the archive."""
    root = scratch_path(spark, "months")
    months = grid.withColumn("yyyymm", F.date_format("time", "yyyyMM"))
    months.hint("rebalance", "yyyymm").write.partitionBy("yyyymm").parquet(root)
    listed = spark.read.parquet(root).select("yyyymm").distinct()
    return root, sorted(f"{root}/yyyymm={r.yyyymm}" for r in listed.toLocalIterator())


@query("month_file_concat", with_ctes(_ALL, "grid_hr"))
def month_file_concat(spark, sf):
    return gr.read_months(spark, _month_dirs(spark, tb.grid_hr(spark, sf))[1])


@query(
    "mixed_file_concat",
    with_ctes(
        f"""SELECT time, latitude, longitude, {r6('lsm')} AS lsm, {r6('z')} AS z, CAST(NULL AS DOUBLE) AS orog FROM static_lr
            UNION ALL SELECT time, latitude, longitude, {r6('lsm')}, NULL, {r6('orog')} FROM static_hr""",
        "static_lr",
        "static_hr",
    ),
)
def mixed_file_concat(spark, sf):
    paths = [gr.store_dataset(g(spark, sf), "static", scratch_path(spark, "mixed")) for g in (tb.static_lr, tb.static_hr)]
    return gr.read_mixed(spark, paths).drop("hhmm", "year")


def _catalog(spark, sf):
    """File names of the months that the daily fine grid and the quarterly coarse one cover."""
    parts = []
    for product, grid in (("cerra", tb.daily_hr(spark, sf)), ("era5", tb.grid_lr(spark, sf))):
        month = grid.select(F.date_format("time", "yyyyMM").alias("m")).distinct()
        name = F.concat(F.lit(f"t2m_{product}_"), "m", F.lit(f"_{cat.RESOLUTION_CODE[product]}deg.parquet"))
        parts.append(month.select(name.alias("url")))
    return cat.parse_catalog(parts[0].union(parts[1]))


_CATALOG = {
    "files": """SELECT DISTINCT 'cerra' AS product, strftime(time, '%Y%m') AS yyyymm, 0.05e0 AS resolution,
          't2m_cerra_' || strftime(time, '%Y%m') || '_005deg.parquet' AS url FROM daily_hr
        UNION ALL SELECT DISTINCT 'era5', strftime(time, '%Y%m'), 0.25e0,
          't2m_era5_' || strftime(time, '%Y%m') || '_025deg.parquet' FROM grid_lr"""
}


@query(
    "catalog_parse",
    with_ctes("SELECT product, 't2m' AS kind, yyyymm, resolution, url FROM files", "daily_hr", "grid_lr", **_CATALOG),
)
def catalog_parse(spark, sf):
    return _catalog(spark, sf)


@query(
    "catalog_month_subset",
    with_ctes(
        """SELECT product, 't2m' AS kind, yyyymm, resolution, url, row_number() OVER (PARTITION BY product ORDER BY yyyymm) - 1
           AS part_idx FROM files WHERE yyyymm IN ('199604', '199607', '199704', '199707')""",
        "daily_hr",
        "grid_lr",
        **_CATALOG,
    ),
)
def catalog_month_subset(spark, sf):
    return cat.index_months(cat.select_months(_catalog(spark, sf), ["199604", "199607", "199704", "199707"]))


@query(
    "catalog_missing_months",
    with_ctes(
        """SELECT product, strftime(m, '%Y%m') AS yyyymm FROM (
             SELECT product, unnest(generate_series(min(strptime(yyyymm, '%Y%m')), max(strptime(yyyymm, '%Y%m')),
                    INTERVAL '1' MONTH)) AS m FROM files GROUP BY product)
           WHERE (product, strftime(m, '%Y%m')) NOT IN (SELECT (product, yyyymm) FROM files)""",
        "daily_hr",
        "grid_lr",
        **_CATALOG,
    ),
)
def catalog_missing_months(spark, sf):
    return cat.missing_months(_catalog(spark, sf))


@query(
    "paired_inputs",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT '{n}' AS dataset, count(*) AS n, {r6(f'sum({v})')} AS total FROM {g}"
            for n, g, v in (
                ("hr_t2m", "grid_hr", "t2m"),
                ("hr_static", "static_hr", "orog"),
                ("lr_t2m", "grid_lr", "t2m"),
                ("lr_static", "static_lr", "z"),
            )
        ),
        "grid_hr",
        "grid_lr",
        "static_hr",
        "static_lr",
    ),
)
def paired_inputs(spark, sf):
    """Both products with their static fields, written as files and loaded together."""
    written = {}
    for name, grid in (
        ("hr", tb.grid_hr(spark, sf)),
        ("hr_static", tb.static_hr(spark, sf)),
        ("lr", tb.grid_lr(spark, sf)),
        ("lr_static", tb.static_lr(spark, sf)),
    ):
        written[name] = scratch_path(spark, name)
        grid.write.parquet(written[name])
    loaded = gr.load_inputs(spark, [written["hr"]], written["hr_static"], [written["lr"]], written["lr_static"])
    names = (("hr_t2m", "t2m"), ("hr_static", "orog"), ("lr_t2m", "t2m"), ("lr_static", "z"))
    rows = [
        g.agg(F.lit(n).alias("dataset"), F.count("*").alias("n"), F.sum(v).alias("total"))
        for g, (n, v) in zip(loaded, names, strict=True)
    ]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query(
    "dataset_round_trip",
    with_ctes(f"SELECT time, latitude, longitude, {r6('t2m')} AS t2m FROM hr_noon", "hr_noon"),
)
def dataset_round_trip(spark, sf):
    """Store the fine grid, load it back and keep noon: only noon directories are read."""
    path = scratch_path(spark, "datasets")
    gr.store_dataset(tb.grid_hr(spark, sf), "fine", path)
    return at_times(gr.load_dataset(spark, "fine", path))


@query(
    "indexed_part_scan",
    with_ctes(
        f"""SELECT time, latitude, longitude, {r6('t2m')} AS t2m FROM grid_hr
            WHERE (extract(year FROM time) * 12 + extract(month FROM time)) - (2006 * 12 + 1) BETWEEN -100 AND -61""",
        "grid_hr",
    ),
)
def indexed_part_scan(spark, sf):
    path = gr.store_parts(tb.grid_hr(spark, sf), scratch_path(spark, "parts"))
    return gr.read_parts(spark, path, -100, -60)


@query(
    "stream_month_landing",
    with_ctes(
        f"""SELECT time, latitude, longitude, {r6('t2m')} AS t2m,
            (extract(year FROM time) * 12 + extract(month FROM time)) - (2006 * 12 + 1) AS part_idx FROM grid_hr""",
        "grid_hr",
    ),
)
def stream_month_landing(spark, sf):
    root, _ = _month_dirs(spark, tb.grid_hr(spark, sf))
    target, checkpoint = scratch_path(spark, "landed"), scratch_path(spark, "landing")
    land_months(spark, root, target, checkpoint)
    return spark.read.parquet(target)


def _yearly_runs(spark, sf):
    """One run record per year: losses by month, metrics over the year; saved and loaded."""
    pair = hold(tb.pair(spark, sf)).withColumns({"year": F.year("time"), "month": F.month("time")})
    monthly = ev.losses(pair, ["year", "month"]).groupBy("year").agg(
        F.sort_array(F.collect_list(F.struct("month", "mse", "mae"))).alias("_m")
    )
    scored = ev.metrics(pair, ["year"]).join(monthly, "year")
    runs = rn.run_records(
        scored,
        F.concat(F.lit("year_"), "year"),
        {"loss_type": "mse", "batch_size": 4, "num_epochs": 12},
        F.col("_m.mse"),
        F.col("_m.mae"),
    )
    path = scratch_path(spark, "runs")
    rn.save_runs(runs, path)
    return rn.load_runs(spark, path)


@query(
    "run_leaderboard",
    with_ctes(
        f"""SELECT 'year_' || year AS run_id, {r6('rmse')} AS rmse, {r6('rmse_percentage_true')} AS rmse_percentage_true,
            {r6('mae')} AS mae, {r6('mae_percentage_true')} AS mae_percentage_true
            FROM (SELECT extract(year FROM time) AS year, {_METRICS} FROM pair GROUP BY 1) ORDER BY rmse, run_id LIMIT 5""",
        "pair",
    ),
)
def run_leaderboard(spark, sf):
    return rn.leaderboard(_yearly_runs(spark, sf), 5)


_EPOCHS = """SELECT 'year_' || year AS run_id, row_number() OVER (PARTITION BY year ORDER BY month) AS epoch, loss, val_loss FROM (
    SELECT extract(year FROM time) AS year, extract(month FROM time) AS month, avg((y_true - y_pred) * (y_true - y_pred)) AS loss,
           avg(abs(y_true - y_pred)) AS val_loss FROM pair GROUP BY 1, 2)"""


@query(
    "training_history",
    with_ctes(f"SELECT run_id, epoch, {r6('loss')} AS loss, {r6('val_loss')} AS val_loss FROM ({_EPOCHS})", "pair"),
)
def training_history(spark, sf):
    return rn.training_history(_yearly_runs(spark, sf))


@query(
    "best_epochs",
    with_ctes(
        f"""SELECT run_id, epoch AS best_epoch, {r6('val_loss')} AS best_val_loss FROM (
            SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_loss, epoch) AS rn FROM ({_EPOCHS})) WHERE rn = 1""",
        "pair",
    ),
)
def best_epochs(spark, sf):
    return rn.best_epochs(_yearly_runs(spark, sf))
