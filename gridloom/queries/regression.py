"""Per-cell, regional and swept regressions over all timesteps of the grids."""

from pyspark.sql import functions as F

from gridloom.operators import gram as gm
from gridloom.operators.align import combine_static, pair_features
from gridloom.operators.axes import GridAxes
from gridloom.operators.regrid import regrid
from gridloom.operators.split import SplitCuts
from gridloom.plans.experiment import run_experiment
from gridloom.queries.evaluation import _METRICS, _histogram_sql
from gridloom.queries.experiments import _experiment_ctes, _inputs
from gridloom.queries.registry import TEST_FACTOR, TEST_REGION, axes_ctes, hold, query, r6, regrid_ctes, split_ctes, with_ctes
from gridloom.sources import tables as tb

ROUNDS, LEAST, DELTA = 3, 0.25, 2.0
FEATURES = ("t2m", "lsm", "z")

_SAMPLES = {
    **axes_ctes("grid_hr"),
    **regrid_ctes("grid_lr", "ax_lat", "ax_lon"),
    "samples": """SELECT h.time, h.latitude, h.longitude, r.t2m AS x, h.t2m AS y FROM grid_hr h
        JOIN rg r ON h.time = r.time AND h.latitude = r.latitude AND h.longitude = r.longitude WHERE r.t2m IS NOT NULL""",
}
_GRIDS = ("grid_hr", "grid_lr")


def _samples(spark, sf):
    fine = hold(tb.grid_hr(spark, sf))
    axes = GridAxes.of(fine)
    return hold(pair_features(regrid(tb.grid_lr(spark, sf), axes, ["t2m"]), fine, ["t2m"], "label")), axes


def r4(expr: str) -> str:
    """Iterated fits agree to fewer digits than single sums."""
    return f"(round({expr}, 4) + 0e0)"


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 4) for n in names})


def _round(weights: str) -> str:
    """Weighted line of every cell, about its weighted means."""
    return f"""SELECT latitude, longitude, max(my) - sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) * max(mx) AS a,
          sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS b, count(*) AS n
        FROM (SELECT *, sum(w * x) OVER c / sum(w) OVER c AS mx, sum(w * y) OVER c / sum(w) OVER c AS my
              FROM ({weights}) WINDOW c AS (PARTITION BY latitude, longitude)) GROUP BY 1, 2"""


def _reweighted(weight: str) -> dict[str, str]:
    """Lines after ROUNDS rounds; ``weight`` of a residual r."""
    ctes = {"fit0": _round("SELECT *, 1e0 AS w FROM samples")}
    for i in range(ROUNDS):
        residuals = f"SELECT s.*, abs(y - a - b * x) AS r FROM samples s JOIN fit{i} f ON f.latitude = s.latitude AND f.longitude = s.longitude"
        ctes[f"fit{i + 1}"] = _round(f"SELECT *, {weight} AS w FROM ({residuals})")
    return ctes


def _cell_sql(weight: str) -> str:
    body = f"SELECT latitude, longitude, {r4('a')} AS intercept, {r4('b')} AS w_t2m, n FROM fit{ROUNDS}"
    return with_ctes(body, *_GRIDS, **_SAMPLES, **_reweighted(weight))


def _cell_fit(spark, sf, loss):
    samples, _ = _samples(spark, sf)
    model = gm.GroupLinear.fit(samples, loss=loss, delta=DELTA, rounds=ROUNDS, tolerance=0.0, least_residual=LEAST)
    found = model.coefficients().selectExpr("lat_key / 100000D AS latitude", "lon_key / 100000D AS longitude", "intercept", "w_t2m", "n")
    return _rounded(found, "intercept", "w_t2m")


@query("cell_regression_mae", _cell_sql(f"1e0 / greatest(r, {LEAST}e0)"))
def cell_regression_mae(spark, sf):
    """Lines of least absolute error, a fixed number of reweighting rounds."""
    return _cell_fit(spark, sf, "mae")


@query("cell_regression_huber", _cell_sql(f"CASE WHEN r <= {DELTA}e0 THEN 1e0 ELSE {DELTA}e0 / r END"))
def cell_regression_huber(spark, sf):
    return _cell_fit(spark, sf, "huber_loss")


def _terrain(spark, sf):
    samples, axes = _samples(spark, sf)
    static = regrid(tb.static_lr(spark, sf), axes, ["lsm", "z"], cluster="lane")
    return hold(combine_static(samples, static, ["lsm", "z"])), axes


_TERRAIN = {
    **_SAMPLES,
    **regrid_ctes("static_lr", "ax_lat", "ax_lon", "rl", "lsm"),
    **regrid_ctes("static_lr", "ax_lat", "ax_lon", "rz", "z"),
    "terrain": """SELECT s.time, s.latitude, s.longitude, s.x AS t2m, l.lsm, z.z, s.y AS label FROM samples s
        JOIN rl l ON l.latitude = s.latitude AND l.longitude = s.longitude JOIN rz z ON z.latitude = s.latitude AND z.longitude = s.longitude
        WHERE l.lsm IS NOT NULL AND z.z IS NOT NULL""",
}


def _moments(rows: str, by: str, ridge: str = "0e0") -> dict[str, str]:
    """Weights wa, wb, wc of three features by determinants; ``by``: group columns."""
    return {
        "moments": f"""SELECT {by}, count(*) AS n, var_pop(t2m) + {ridge} AS aa, covar_pop(t2m, lsm) AS ab, covar_pop(t2m, z) AS ac, var_pop(lsm) + {ridge} AS bb,
            covar_pop(lsm, z) AS bc, var_pop(z) + {ridge} AS cc, covar_pop(t2m, label) AS ay, covar_pop(lsm, label) AS yb, covar_pop(z, label) AS cy,
            avg(t2m) AS ma, avg(lsm) AS mb, avg(z) AS mc, avg(label) AS my FROM ({rows}) GROUP BY {by}""",
        "solved": """SELECT *, (ay * (bb * cc - bc * bc) - ab * (yb * cc - bc * cy) + ac * (yb * bc - bb * cy)) / det AS wa,
              (aa * (yb * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - yb * ac)) / det AS wb,
              (aa * (bb * cy - yb * bc) - ab * (ab * cy - yb * ac) + ay * (ab * bc - bb * ac)) / det AS wc
            FROM (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM moments)""",
    }


_BLOCKED = """SELECT *, (SELECT count(*) FROM ax_lat a WHERE a.latitude < t.latitude) // 4 AS block_lat,
    (SELECT count(*) FROM ax_lon o WHERE o.longitude < t.longitude) // 4 AS block_lon FROM terrain t"""


@query(
    "regional_regression",
    with_ctes(
        f"""SELECT block_lat, block_lon, n, {r4('my - wa * ma - wb * mb - wc * mc')} AS intercept, {r4('wa')} AS w_t2m, {r4('wb')} AS w_lsm, {r4('wc')} AS w_z
            FROM solved""",
        *_GRIDS,
        "static_lr",
        **_TERRAIN,
        blocked=_BLOCKED,
        **_moments("SELECT * FROM blocked", "block_lat, block_lon", "0.01e0"),
    ),
)
def regional_regression(spark, sf):
    """Temperature, land share and geopotential together, a model for each block of 4 x 4 cells."""
    samples, axes = _terrain(spark, sf)
    blocked = gm.cell_blocks(samples, axes, 4)
    model = gm.GroupLinear.fit(blocked, FEATURES, by=("block_lat", "block_lon"), ridge=0.01)
    return _rounded(model.coefficients().drop("rounds"), "intercept", "w_t2m", "w_lsm", "w_z")


def _ridge_line(x: str, ridge: float) -> str:
    slope = f"covar_pop(label, {x}) / (var_pop({x}) + {ridge}e0)"
    return f"SELECT '{x}|mse|{ridge:g}' AS config, avg(label) - {slope} * avg({x}) AS b, {slope} AS w, '{x}' AS f FROM train"


@query(
    "run_grid_fits",
    with_ctes(
        f"""SELECT config, count(*) AS n, {r4('avg(e * e)')} AS mse, {r4('avg(abs(e))')} AS mae,
            {r4('avg(CASE WHEN abs(e) <= 1 THEN 0.5e0 * e * e ELSE abs(e) - 0.5e0 END)')} AS huber_loss FROM errors GROUP BY config""",
        *_GRIDS,
        "static_lr",
        **_TERRAIN,
        **split_ctes("grid_hr"),
        train="SELECT * FROM terrain WHERE time < (SELECT first_val FROM cuts)",
        val="SELECT * FROM terrain WHERE time >= (SELECT first_val FROM cuts) AND time < (SELECT first_test FROM cuts)",
        lines=" UNION ALL ".join(_ridge_line(x, r) for x in FEATURES for r in (0.0, 0.5)),
        whole="SELECT 1 AS g, * FROM train",
        **_moments("SELECT * FROM whole", "g"),
        errors="""SELECT config, label - b - w * CASE f WHEN 't2m' THEN t2m WHEN 'lsm' THEN lsm ELSE z END AS e FROM val CROSS JOIN lines
            UNION ALL SELECT 't2m+lsm+z|mse|0', label - my - wa * (t2m - ma) - wb * (lsm - mb) - wc * (z - mc) FROM val CROSS JOIN solved""",
    ),
)
def run_grid_fits(spark, sf):
    """Seven configurations fitted from one scan of the training rows, scored in one of the validation rows."""
    samples, _ = _terrain(spark, sf)
    cuts = SplitCuts.of(hold(tb.grid_hr(spark, sf)))
    configs = gm.every_config([(f,) for f in FEATURES], ridges=(0.0, 0.5)) + [gm.FitConfig(FEATURES)]
    fits = gm.fit_grid(samples.where(cuts.where("train")), FEATURES, "label", configs)
    scores = gm.score_grid(samples.where(cuts.where("val")), fits, FEATURES, "label")
    return _rounded(scores, "mse", "mae", "huber_loss")


_EXPERIMENT = {"region": TEST_REGION, "divisible_factor": TEST_FACTOR, "on_missing": "skip"}
_NOON_GRIDS = ("grid_hr", "grid_lr", "hr_noon", "lr_noon", "static_hr", "static_lr")


def _with_lines(lines: dict[str, str]) -> dict[str, str]:
    """The experiment's tables with other lines in place of the squared ones."""
    out = {}
    for name, body in _experiment_ctes("lstats").items():
        out |= lines if name == "lines" else {name: body}
    return out


def _mae_lines() -> dict[str, str]:
    rounds = {k: v.replace("FROM samples s", "FROM known s").replace("FROM samples", "FROM known") for k, v in _reweighted(f"1e0 / greatest(r, {LEAST}e0)").items()}
    return {
        "known": "SELECT * FROM samples WHERE x IS NOT NULL AND y IS NOT NULL",
        **rounds,
        "lines": f"SELECT latitude, longitude, b AS slope, a AS intercept FROM fit{ROUNDS}",
    }


def _run(spark, sf, fitter, loss, **more):
    setup = {"loss_type": loss, "batch_size": 4, "num_epochs": 1}
    return run_experiment(*_inputs(spark, sf), setup=setup, run_id=loss, fitter=fitter, **_EXPERIMENT, **more).evaluation


@query("experiment_metrics_mae", with_ctes(f"SELECT {_METRICS}, count(*) AS n FROM scored", *_NOON_GRIDS, **_with_lines(_mae_lines())))
def experiment_metrics_mae(spark, sf):
    """The setup's absolute loss is what is fitted, a fixed number of rounds; coarse grid by weights."""
    return _run(spark, sf, gm.LossFitter(rounds=ROUNDS, tolerance=0.0, least_residual=LEAST), "mae", regridding="weights").metrics


def _terrain_experiment() -> dict[str, str]:
    ctes = _experiment_ctes("lstats")
    static = lambda v, src: f"({v} - (SELECT avg({v}) FROM {src})) / nullif((SELECT stddev_pop({v}) FROM {src}), 0)"
    ctes["nf"] = f"""SELECT n.time, n.latitude, n.longitude, n.t2m, l.lsm, z.z FROM nl n
        JOIN (SELECT latitude, longitude, {static('lsm', 'rl')} AS lsm FROM rl) l ON l.latitude = n.latitude AND l.longitude = n.longitude
        JOIN (SELECT latitude, longitude, {static('z', 'rz')} AS z FROM rz) z ON z.latitude = n.latitude AND z.longitude = n.longitude"""
    fit = _moments(
        """SELECT 1 AS g, f.t2m, f.lsm, f.z, h.t2m AS label FROM nf f JOIN nh h ON h.time = f.time AND h.latitude = f.latitude AND h.longitude = f.longitude
           WHERE f.time < (SELECT first_val FROM lcuts) AND h.time < (SELECT first_val FROM cuts)
             AND f.t2m IS NOT NULL AND f.lsm IS NOT NULL AND f.z IS NOT NULL AND h.t2m IS NOT NULL""",
        "g",
    )
    scores = {k: ctes.pop(k) for k in ("predicted", "truth", "scored")}
    scores["predicted"] = """SELECT n.time, n.latitude, n.longitude, (my + wa * (n.t2m - ma) + wb * (n.lsm - mb) + wc * (n.z - mc)) * s.sigma + s.mu AS t2m
        FROM nf n CROSS JOIN solved JOIN lstats s ON n.latitude = s.latitude AND n.longitude = s.longitude WHERE n.time >= (SELECT first_test FROM lcuts)"""
    return {**ctes, **fit, **scores}


@query("experiment_metrics_terrain", with_ctes(f"SELECT {_METRICS}, count(*) AS n FROM scored", *_NOON_GRIDS, **_terrain_experiment()))
def experiment_metrics_terrain(spark, sf):
    """One model of temperature, land share and geopotential for all cells, squared loss."""
    return _run(spark, sf, gm.LossFitter(FEATURES, by=()), "mse").metrics


@query(
    "experiment_histograms",
    with_ctes(_histogram_sql({"actual": ("truth", "t2m"), "predicted": ("predicted", "t2m")}), *_NOON_GRIDS, **_experiment_ctes("lstats")),
)
def experiment_histograms(spark, sf):
    """Each series on all its rows, those without a partner too."""
    return run_experiment(*_inputs(spark, sf), setup={"loss_type": "mse"}, run_id="h", **_EXPERIMENT).evaluation.histogram


@query(
    "experiment_extents",
    with_ctes(
        f"""SELECT t.latitude, t.longitude, {r6('t.v')} AS y_true_mean, {r6('p.v')} AS y_pred_mean,
            """
        + ", ".join(
            f"(SELECT {f}({c}itude) FROM {source}) AS {prefix}{c[:3]}_{f}"
            for prefix, source in (("", "truth"), ("pred_", "predicted"))
            for f in ("min", "max")
            for c in ("lat", "long")
        ).replace("long_", "lon_")
        + """ FROM (SELECT latitude, longitude, avg(t2m) AS v FROM truth GROUP BY 1, 2) t
            JOIN (SELECT latitude, longitude, avg(t2m) AS v FROM predicted GROUP BY 1, 2) p ON p.latitude = t.latitude AND p.longitude = t.longitude""",
        *_NOON_GRIDS,
        **_experiment_ctes("lstats"),
    ),
)
def experiment_extents(spark, sf):
    """Mean maps with the extents of truth and prediction."""
    return run_experiment(*_inputs(spark, sf), setup={"loss_type": "mse"}, run_id="x", **_EXPERIMENT).evaluation.spatial
