"""Chronological splits, ratios and batches."""

from pyspark.sql import functions as F

from gridloom.operators import split as sp
from gridloom.operators.align import pair_features
from gridloom.operators.axes import GridAxes
from gridloom.queries.registry import hold, query, r6, split_ctes, with_ctes
from gridloom.session import scratch_path
from gridloom.sources import tables as tb
from gridloom.sources.shards import BatchShards

_LABEL = """CASE WHEN g.time < c.first_val THEN 'train' WHEN g.time < c.first_test THEN 'val' ELSE 'test' END"""


@query(
    "split_labels",
    with_ctes(
        f"""SELECT g.time, latitude, longitude, {r6('t2m')} AS t2m, {_LABEL} AS split FROM grid_hr g CROSS JOIN cuts c""",
        "grid_hr",
        **split_ctes("grid_hr"),
    ),
)
def split_labels(spark, sf):
    return sp.label_splits(hold(tb.grid_hr(spark, sf)))


@query(
    "split_row_counts",
    with_ctes(
        f"""SELECT 'lr_' || {_LABEL} AS part, CAST(count(*) AS BIGINT) AS n, min(g.time) AS first_time, max(g.time) AS last_time
              FROM grid_lr g CROSS JOIN lcuts c GROUP BY 1 UNION ALL
            SELECT 'hr_' || {_LABEL}, CAST(count(*) AS BIGINT), min(g.time), max(g.time)
              FROM grid_hr g CROSS JOIN cuts c GROUP BY 1""",
        "grid_hr",
        "grid_lr",
        **split_ctes("grid_hr"),
        **split_ctes("grid_lr", "lcuts"),
    ),
)
def split_row_counts(spark, sf):
    parts = sp.split_dataset(hold(tb.grid_lr(spark, sf)), hold(tb.grid_hr(spark, sf)))
    rows = None
    for name, grid in parts.items():
        row = grid.agg(
            F.lit(name).alias("part"),
            F.count("*").alias("n"),
            F.min("time").alias("first_time"),
            F.max("time").alias("last_time"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query(
    "split_ratios",
    with_ctes(
        f"""SELECT split, n_times, {r6('n_times / CAST(sum(n_times) OVER () AS DOUBLE)')} AS ratio FROM (
            SELECT {_LABEL} AS split, count(DISTINCT g.time) AS n_times FROM grid_lr g CROSS JOIN cuts c GROUP BY 1)""",
        "grid_lr",
        **split_ctes("grid_lr"),
    ),
)
def split_ratios(spark, sf):
    return sp.split_ratios(sp.label_splits(hold(tb.grid_lr(spark, sf))))


@query(
    "batches_per_epoch",
    with_ctes(
        """SELECT count(DISTINCT time) AS n_samples, CAST(ceil(count(DISTINCT time) / 16e0) AS BIGINT) AS n_batches
           FROM grid_lr""",
        "grid_lr",
    ),
)
def batches_per_epoch(spark, sf):
    return sp.batches_per_epoch(tb.grid_lr(spark, sf), 16)


@query(
    "batches_in_order",
    with_ctes(
        """SELECT CAST(0 AS BIGINT) AS epoch, time, i AS position, i // 16 AS batch_id FROM
           (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM (SELECT DISTINCT time FROM grid_lr))""",
        "grid_lr",
    ),
)
def batches_in_order(spark, sf):
    return sp.assign_batches(tb.grid_lr(spark, sf), 16, shuffle=False)


@query("batches_shuffled")
def batches_shuffled(spark, sf):
    return sp.assign_batches(tb.grid_lr(spark, sf), 16, epochs=3, seed=42)


@query(
    "batch_coverage",
    with_ctes(
        """SELECT e.epoch, b.batch_id, least(16, n - b.batch_id * 16) AS n_times FROM
           (SELECT count(DISTINCT time) AS n FROM grid_lr) CROSS JOIN (SELECT unnest([0, 1, 2]) AS epoch) e
           CROSS JOIN (SELECT unnest(range((SELECT CAST(ceil(count(DISTINCT time) / 16e0) AS BIGINT) FROM grid_lr))) AS batch_id) b""",
        "grid_lr",
    ),
)
def batch_coverage(spark, sf):
    """Distinct timesteps per shuffled batch: every epoch covers every timestep once."""
    batches = sp.assign_batches(tb.grid_lr(spark, sf), 16, epochs=3, seed=7)
    return batches.groupBy("epoch", "batch_id").agg(F.countDistinct("time").alias("n_times"))


@query(
    "batch_sample_rows",
    with_ctes(
        f"""SELECT b.i // 16 AS batch_id, l.time, l.latitude, l.longitude, {r6('l.t2m')} AS t2m, {r6('h.t2m')} AS label
            FROM grid_lr l JOIN grid_hr h ON l.time = h.time AND l.latitude = h.latitude AND l.longitude = h.longitude
            JOIN (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM (SELECT DISTINCT time FROM grid_lr)) b
              ON b.time = l.time""",
        "grid_lr",
        "grid_hr",
    ),
)
def batch_sample_rows(spark, sf):
    coarse, fine = hold(tb.grid_lr(spark, sf)), hold(tb.grid_hr(spark, sf))
    batches = hold(sp.assign_batches(coarse, 16, shuffle=False))
    samples = pair_features(coarse, fine, ["t2m"], "label")
    rows = sp.batch_rows(samples, batches)
    return rows.select("batch_id", "time", "latitude", "longitude", "t2m", "label")


@query(
    "batch_shards",
    with_ctes(
        f"""SELECT b.i // 16 AS batch_id, b.i AS position, l.time, l.latitude, l.longitude, {r6('l.t2m')} AS t2m, {r6('h.t2m')} AS label
            FROM grid_lr l JOIN grid_hr h ON l.time = h.time AND l.latitude = h.latitude AND l.longitude = h.longitude
            JOIN (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM
                  (SELECT DISTINCT l.time FROM grid_lr l JOIN grid_hr h
                   ON l.time = h.time AND l.latitude = h.latitude AND l.longitude = h.longitude)) b ON b.time = l.time""",
        "grid_lr",
        "grid_hr",
    ),
)
def batch_shards(spark, sf):
    """Paired rows written as shards of 16 timesteps and read back."""
    samples = hold(pair_features(hold(tb.grid_lr(spark, sf)), hold(tb.grid_hr(spark, sf)), ["t2m"], "label"))
    axes, shards = GridAxes.of(samples), BatchShards(spark, scratch_path(spark, "shards"), size=4)
    shards.write(samples, ["t2m", "label"], 16, shuffle=False, axes=axes)
    return shards.cells(shards.read(0), ["t2m", "label"], axes)
