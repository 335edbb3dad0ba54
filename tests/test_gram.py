"""Regressions from Gram matrices against numpy."""

import numpy as np
import pytest
from gridloom.operators import gram as gm
from pyspark.sql import functions as F

FEATURES = ["a", "b", "c"]


def table(seed=0, n=240):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [3, 1, 10] + [280, 0, 500]
    y = x @ [1.5, -2, 0.1] + rng.standard_t(2, n)
    return x, y, np.arange(n) % 3


@pytest.fixture(scope="module")
def rows(spark):
    x, y, g = table()
    data = [(int(i), *map(float, v), float(w)) for i, v, w in zip(g, x, y, strict=True)]
    return spark.createDataFrame([*data, (0, None, 1.0, 1.0, 5.0), (0, 1.0, float("nan"), 1.0, 5.0), (1, 1.0, 1.0, 1.0, None), (9, None, 1.0, 1.0, 1.0)], "g int, a double, b double, c double, label double")


def ridge_fit(x, y, ridge=0.0, w=None):
    w = np.ones(len(y)) if w is None else w
    mx, my = (w @ x) / w.sum(), (w @ y) / w.sum()
    c = ((x - mx) * w[:, None]).T @ (x - mx) / w.sum() + ridge * np.eye(x.shape[1])
    b = np.linalg.solve(c, ((x - mx) * w[:, None]).T @ (y - my) / w.sum())
    return my - mx @ b, b


def reweighted(x, y, loss, rounds, least=1e-3, delta=1.0):
    a, b = ridge_fit(x, y)
    for _ in range(rounds):
        r = np.abs(y - a - x @ b)
        w = 1 / np.maximum(r, least) if loss == "mae" else np.where(r <= delta, 1, delta / r)
        a, b = ridge_fit(x, y, 0.0, w)
    return a, b


def test_all_configs_from_one_matrix(rows):
    x, y, g = table()
    configs = gm.every_config(gm.feature_subsets(FEATURES, 0), ridges=(0.0, 0.7))
    fits = {(r.g, r.config): r for r in gm.fit_grid(rows, FEATURES, "label", configs, ["g"]).collect()}
    assert len(configs) == 16 and len(fits) == 48
    for (group, name), fit in fits.items():
        config = next(c for c in configs if c.name == name)
        use = [FEATURES.index(f) for f in config.features]
        a, b = ridge_fit(x[g == group][:, use], y[g == group], config.ridge)
        assert fit.n == 80 and fit.intercept == pytest.approx(a, rel=1e-8, abs=1e-6)
        assert [w for w in fit.weights if w] == pytest.approx(list(b), rel=1e-8)


@pytest.mark.parametrize("loss", ["mae", "huber_loss"])
def test_reweighting_rounds(rows, loss):
    x, y, g = table()
    config = gm.FitConfig(tuple(FEATURES), loss)
    fits = gm.fit_grid(rows, FEATURES, "label", [config], ["g"], rounds=4, tolerance=0.0).collect()
    for fit in fits:
        a, b = reweighted(x[g == fit.g], y[g == fit.g], loss, 4)
        assert fit.rounds == 4 and fit.intercept == pytest.approx(a, rel=1e-7) and fit.weights == pytest.approx(list(b), rel=1e-7)


def test_converged_groups_leave(rows, spark):
    exact = rows.where("g <> 9").withColumn("label", F.when(F.col("g") == 1, 2 * F.col("a") + 1).otherwise(F.col("label")))
    fits = {r.g: r for r in gm.fit_grid(exact, FEATURES, "label", [gm.FitConfig(tuple(FEATURES), "mae")], ["g"], rounds=30, tolerance=1e-4).collect()}
    assert fits[1].rounds == 1 and fits[1].weights == pytest.approx([2, 0, 0], abs=1e-5)
    assert 1 < fits[0].rounds <= 30
    x, y, g = table()
    score = lambda a, b: np.abs(y[g == 0] - a - x[g == 0] @ b).mean()
    assert score(fits[0].intercept, np.array(fits[0].weights)) < score(*ridge_fit(x[g == 0], y[g == 0])) + 1e-9


def test_flat_and_tied_features_get_no_weight(spark):
    rows = spark.createDataFrame([(float(i), 7.0, 2.0 * i, 3.0 * i + 1) for i in range(20)], "a double, b double, c double, label double")
    fit = gm.fit_grid(rows, FEATURES, "label", [gm.FitConfig(tuple(FEATURES))]).first()
    assert fit.weights == pytest.approx([3, 0, 0], abs=1e-9) and fit.intercept == pytest.approx(1)
    one = gm.fit_grid(rows.limit(1), FEATURES, "label", [gm.FitConfig(tuple(FEATURES))]).first()
    assert one.weights == [0, 0, 0] and one.intercept == rows.limit(1).first().label
    assert gm.fit_grid(rows.limit(0), FEATURES, "label", [gm.FitConfig(tuple(FEATURES), "mae")]).count() == 0


def test_matrices_merge(rows):
    whole = gm.gram(rows, FEATURES, "label", []).first()
    parts = gm.merge(gm.gram(rows, FEATURES, "label", ["g"]), []).first()
    assert [parts[c] for c in whole.asDict()] == pytest.approx(list(whole), rel=1e-12)


def test_scores_of_a_sweep(rows):
    x, y, g = table()
    configs = gm.every_config([("a",), ("a", "b", "c")], losses=("mse", "huber_loss"))
    fits = gm.fit_grid(rows, FEATURES, "label", configs, ["g"])
    scores = {r.config: r for r in gm.score_grid(rows, fits, FEATURES, "label", ["g"]).collect()}
    error = np.concatenate([y[g == k] - (lambda f: f[0] + x[g == k] @ f[1])(ridge_fit(x[g == k], y[g == k])) for k in range(3)])
    found = scores["a+b+c|mse|0"]
    assert found.n == 240 and found.mse == pytest.approx((error**2).mean(), rel=1e-8) and found.mae == pytest.approx(np.abs(error).mean(), rel=1e-8)
    assert scores["a+b+c|huber_loss|0"].huber_loss < scores["a|huber_loss|0"].huber_loss
    with pytest.raises(ValueError, match="repeat or use unknown"):
        gm.fit_grid(rows, ["a"], "label", [gm.FitConfig(("a", "b"))])
    with pytest.raises(ValueError, match="unknown loss"):
        gm.FitConfig(("a",), "log_cosh")


def test_models_by_cell_and_for_all(make_grid):
    cells = make_grid([44.0, 44.05], [8.0, 8.05], 30, lambda d, y, x: float(d % 7) + y).withColumn("label", F.col("t2m") * 2 + F.col("longitude"))
    model = gm.GroupLinear.fit(cells)
    assert model.groups == 4
    worst = lambda m: m.predict(cells, "p", ["label"]).agg(F.max(F.abs(F.col("p") - F.col("label")))).first()[0]
    assert worst(model) < 1e-6
    assert worst(gm.GroupLinear.fit(cells, ["t2m", "longitude"], by=())) < 1e-5
    away = make_grid([50.0], [8.0], 1, lambda d, y, x: 1.0)
    assert model.predict(away).first().t2m is None
    with pytest.raises(Exception, match="do not cover"):
        model.predict(away, strict=True).collect()
