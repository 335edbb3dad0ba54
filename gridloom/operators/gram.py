"""Linear models of groups of cells from mergeable Gram matrices.

The products of all pairs among (1, features, label) are summed for each group: a packed Gram matrix, small
whatever the number of rows, that adds up over tasks, months and groups.  Every least-squares fit on a subset of
the features, with any ridge, comes from it without another look at the rows.  Absolute and Huber losses are
fitted by reweighting: each round sums weighted Gram matrices, for all groups that still move, in one pass.

The normal equations are solved in column expressions (LDL' factors, unrolled for the few features), so a fit per
cell is a narrow projection over the table of matrices.  A feature that does not vary in its group, or that
others determine, gets weight 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.operators.axes import GridAxes, axis_positions
from gridloom.schema import CELL_KEYS, LAT, LON, TEMPERATURE, TIME, with_cell_keys
from gridloom.session import broadcast_if_small, stage

LOSSES = ("mse", "mae", "huber_loss")
#: A pivot below these shares of the feature's mean square and of its own variance counts as zero.
FLAT, TIED = 1e-12, 1e-9
#: Residuals below this count as this large when absolute losses are reweighted.
LEAST_RESIDUAL = 1e-3


@dataclass(frozen=True)
class FitConfig:
    """One model to fit: which features, how much ridge, which loss."""

    features: tuple[str, ...]
    loss: str = "mse"
    ridge: float = 0.0
    delta: float = 1.0

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"unknown loss {self.loss!r}; use one of {LOSSES}")
        if self.ridge < 0:
            raise ValueError("a ridge is not negative")

    @property
    def name(self) -> str:
        return f"{'+'.join(self.features) or 'mean'}|{self.loss}|{self.ridge:g}"


def every_config(subsets: Iterable[Sequence[str]], losses: Sequence[str] = ("mse",), ridges: Sequence[float] = (0.0,)) -> list[FitConfig]:
    return [FitConfig(tuple(f), loss, float(r)) for f, loss, r in product(subsets, losses, ridges)]


def feature_subsets(features: Sequence[str], least: int = 1) -> list[tuple[str, ...]]:
    return [s for n in range(least, len(features) + 1) for s in combinations(features, n)]


def _pairs(k: int) -> list[tuple[int, int]]:
    """Places of the packed upper triangle over (1, k features, label)."""
    return [(i, j) for i in range(k + 2) for j in range(i, k + 2)]


def gram(rows: DataFrame, features: Sequence[str], label: str, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """(by, n, s_i_j): packed Gram matrices; rows that lack a feature or the label are left out."""
    values = [F.lit(1.0), *(F.col(f).cast("double") for f in features), F.col(label).cast("double")]
    known = rows.where(F.forall(F.array(*values), lambda v: v.isNotNull() & ~F.isnan(v)))
    w = F.lit(1.0) if weight is None else weight
    sums = [F.sum(w * values[i] * values[j]).alias(f"s_{i}_{j}") for i, j in _pairs(len(features))]
    return known.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def merge(grams: DataFrame, by: Sequence[str]) -> DataFrame:
    """Matrices of coarser groups (or of all, without ``by``): they add up."""
    sums = [c for c in grams.columns if c == "n" or c.startswith("s_")]
    return grams.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums))


def solve(grams: DataFrame, k: int, keep: Sequence[str]) -> DataFrame:
    """(keep, n, intercept, weights): the fit of every matrix, for its columns ``mask`` (0/1 a feature) and ``ridge``."""
    of = lambda name, i, j: F.col(f"{name}_{max(i, j)}_{min(i, j)}")
    mean = {i: F.col(f"_m_{i}") for i in range(1, k + 2)}
    out = grams.withColumns({f"_m_{i}": F.col(f"s_0_{i}") / F.col("s_0_0") for i in range(1, k + 2)})
    used = lambda i: F.col("mask")[i - 1] if i <= k else F.lit(1.0)
    centred = {
        f"_c_{j}_{i}": used(i) * used(j) * (F.col(f"s_{i}_{j}") / F.col("s_0_0") - mean[i] * mean[j]) + (used(i) * F.col("ridge") if i == j else F.lit(0.0))
        for i, j in _pairs(k)
        if i >= 1
    }
    out = out.withColumns(centred)
    # C = L D L'; the label's row of L times D is the transformed right side.
    for j in range(1, k + 1):
        before = [of("_l", j, t) * of("_l", j, t) * F.col(f"_d_{t}") for t in range(1, j)]
        out = out.withColumn(f"_d_{j}", of("_c", j, j) - sum(before, F.lit(0.0)))
        least = F.greatest(F.lit(FLAT) * F.col(f"s_{j}_{j}") / F.col("s_0_0"), F.lit(TIED) * of("_c", j, j))
        inverse = F.when((F.col(f"_d_{j}") > least) & (F.col(f"_d_{j}") > 0), 1 / F.col(f"_d_{j}")).otherwise(0.0)
        out = out.withColumn(f"_i_{j}", inverse)
        cross = {i: [of("_l", i, t) * of("_l", j, t) * F.col(f"_d_{t}") for t in range(1, j)] for i in range(j + 1, k + 2)}
        out = out.withColumns({f"_l_{i}_{j}": F.col(f"_i_{j}") * (of("_c", i, j) - sum(c, F.lit(0.0))) for i, c in cross.items()})
    # Backwards: the label's row of L is D^-1 L^-1 of the right side.
    for j in range(k, 0, -1):
        later = [of("_l", i, j) * F.col(f"_w_{i}") for i in range(j + 1, k + 1)]
        out = out.withColumn(f"_w_{j}", of("_l", k + 1, j) - sum(later, F.lit(0.0)))
    weights = [F.col(f"_w_{j}") for j in range(1, k + 1)]
    intercept = mean[k + 1] - sum((w * mean[j] for j, w in enumerate(weights, 1)), F.lit(0.0))
    found = F.array(*weights) if weights else F.array().cast("array<double>")
    return out.select(*keep, "n", intercept.alias("intercept"), found.alias("weights"))


def _options(configs: Sequence[FitConfig], features: Sequence[str]) -> Column:
    return F.array(
        *(
            F.struct(
                F.lit(c.name).alias("config"),
                F.lit(c.loss).alias("loss"),
                F.lit(c.delta).alias("delta"),
                F.lit(c.ridge).alias("ridge"),
                F.array(*(F.lit(float(f in c.features)) for f in features)).cast("array<double>").alias("mask"),
            )
            for c in configs
        )
    )


def _value(features: Sequence[str]) -> Column:
    """Prediction of a row from its columns ``intercept`` and ``weights``."""
    # Weight 0 leaves a feature out, whatever the row has there.
    terms = [F.when(F.col("weights")[i] == 0, 0.0).otherwise(F.col("weights")[i] * F.col(f)) for i, f in enumerate(features)]
    return sum(terms, F.col("intercept"))


_FIT = ["config", "loss", "delta", "ridge", "mask"]


def fit_grid(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    configs: Sequence[FitConfig],
    by: Sequence[str] = (),
    rounds: int = 20,
    tolerance: float = 1e-6,
    least_residual: float = LEAST_RESIDUAL,
) -> DataFrame:
    """(by, config, loss, delta, ridge, mask, n, intercept, weights, rounds): a fit for every config and group.

    One pass over ``rows`` sums the matrices that all configs start from, and is all that squared losses need.
    The others take up to ``rounds`` passes more; a fit that moved by no more than ``tolerance`` in a pass is
    done and asks for no row again.  ``rows`` without a group column are one group.
    """
    unknown = {f for c in configs for f in c.features} - set(features)
    if unknown or len({c.name for c in configs}) < len(configs):
        raise ValueError(f"configs repeat or use unknown features {sorted(unknown)}")
    k, by = len(features), list(by)
    option = F.explode(_options(configs, features)).alias("o")
    start = gram(rows, features, label, by).where("n > 0").select("*", option).select("*", "o.*")
    done = stage(solve(start, k, [*by, *_FIT]).withColumn("rounds", F.lit(0)), "fits")
    if all(c.loss == "mse" for c in configs):
        return done
    moving, parts = done.where("loss <> 'mse'"), [done.where("loss = 'mse'")]
    for step in range(1, rounds + 1):
        # The fits of a group beside its rows: as many as there are configs.
        fits = moving.groupBy(*by).agg(F.collect_list(F.struct(*_FIT, "intercept", "weights")).alias("fits"))
        beside = rows.join(broadcast_if_small(fits, moving.count()), by) if by else rows.withColumn("fits", fits.select("fits").scalar())
        each = beside.withColumn("f", F.explode("fits")).select(*by, *features, label, "f.*")
        size = F.abs(F.col(label) - _value(features))
        huber = F.when(size <= F.col("delta"), 1.0).otherwise(F.col("delta") / size)
        weight = F.when(F.col("loss") == "huber_loss", huber).otherwise(1 / F.greatest(size, F.lit(least_residual)))
        again = solve(gram(each, features, label, [*by, *_FIT], weight), k, [*by, *_FIT])
        last = moving.select(*by, "config", F.col("intercept").alias("_b"), F.col("weights").alias("_w"))
        moved = F.greatest(
            F.abs(F.col("intercept") - F.col("_b")),
            F.array_max(F.concat(F.zip_with("weights", "_w", lambda a, b: F.abs(a - b)), F.array(F.lit(0.0)))),
        )
        found = again.join(last, [*by, "config"]).withColumn("_moved", moved > tolerance).drop("_b", "_w")
        found = stage(found.withColumn("rounds", F.lit(step)), "fits")
        parts.append(found.where("NOT _moved").drop("_moved"))
        moving = found.where("_moved").drop("_moved")
        if moving.isEmpty():
            break
    else:
        parts.append(moving)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def score_grid(rows: DataFrame, fits: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = (), delta: float = 1.0) -> DataFrame:
    """(config, n, mse, mae, huber_loss) of every config over ``rows``, in one pass over them."""
    by = list(by)
    beside = fits.groupBy(*by).agg(F.collect_list(F.struct("config", "intercept", "weights")).alias("fits"))
    beside = stage(beside, "fits")
    each = rows.join(broadcast_if_small(beside, beside.count()), by) if by else rows.withColumn("fits", beside.select("fits").scalar())
    each = each.withColumn("f", F.explode("fits")).select(*features, label, "f.*")
    error = F.col(label) - _value(features)
    size = F.abs(error)
    huber = F.when(size <= delta, 0.5 * error * error).otherwise(delta * size - 0.5 * delta * delta)
    known = each.withColumns({"_e": error, "_h": huber}).where(F.col("_e").isNotNull() & ~F.isnan("_e"))
    return known.groupBy("config").agg(
        F.count("*").alias("n"), F.avg(F.col("_e") * F.col("_e")).alias("mse"), F.avg(F.abs("_e")).alias("mae"), F.avg("_h").alias("huber_loss")
    )


def cell_blocks(rows: DataFrame, axes: GridAxes, size: int) -> DataFrame:
    """``rows`` with block_lat and block_lon: squares of ``size`` x ``size`` cells, counted from the south-west."""
    placed = axis_positions(rows, axes)
    return placed.withColumns({f"block_{d}": F.floor(F.col(f"{d}_idx") / size) for d in ("lat", "lon")}).drop("lat_idx", "lon_idx")


@dataclass(frozen=True)
class GroupLinear:
    """One linear model for each group of rows: cells by default, blocks or any other columns."""

    table: DataFrame
    features: tuple[str, ...]
    by: tuple[str, ...]
    groups: int

    @classmethod
    def fit(
        cls,
        samples: DataFrame,
        features: Sequence[str] = (TEMPERATURE,),
        y: str = "label",
        by: Sequence[str] = CELL_KEYS,
        loss: str = "mse",
        ridge: float = 0.0,
        delta: float = 1.0,
        **options,
    ) -> GroupLinear:
        """``options`` as in ``fit_grid``."""
        rows = with_cell_keys(samples) if set(by) & set(CELL_KEYS) else samples
        config = FitConfig(tuple(features), loss, ridge, delta)
        table = fit_grid(rows, features, y, [config], by, **options)
        table = stage(table.select(*by, "n", "intercept", "weights", "rounds"), "fits")
        return cls(table, tuple(features), tuple(by), table.count())

    def coefficients(self) -> DataFrame:
        """(by, n, intercept, w_<feature>, rounds)."""
        weights = (F.col("weights")[i].alias(f"w_{f}") for i, f in enumerate(self.features))
        return self.table.select(*self.by, "n", "intercept", *weights, "rounds")

    def predict(self, rows: DataFrame, output: str = TEMPERATURE, keep: Sequence[str] = (), strict: bool = False) -> DataFrame:
        """One row for each row of ``rows``, NULL where no model was fitted; ``strict`` raises there."""
        side = broadcast_if_small(self.table.select(*self.by, "intercept", "weights"), self.groups)
        given = with_cell_keys(rows) if set(self.by) & set(CELL_KEYS) else rows
        if self.by:
            joined = given.join(side, list(self.by), "left")
        else:
            one = self.table.select(F.struct("intercept", "weights").alias("fit")).scalar()
            joined = given.withColumns({"intercept": one["intercept"], "weights": one["weights"]})
        value = _value(self.features)
        if strict:
            value = F.when(F.col("intercept").isNull(), F.raise_error(F.lit("models do not cover every cell of the grid"))).otherwise(value)
        return joined.select(TIME, LAT, LON, *keep, value.alias(output))


@dataclass(frozen=True)
class LossFitter:
    """Fits what an experiment's setup asks for: its ``loss_type`` (mae unless set) on all ``features``.

    ``by`` are cell keys (a model for each cell) or nothing (one for all cells, for features that vary
    between cells only).
    """

    features: tuple[str, ...] = (TEMPERATURE,)
    by: tuple[str, ...] = tuple(CELL_KEYS)
    ridge: float = 0.0
    delta: float = 1.0
    rounds: int = 20
    tolerance: float = 1e-6
    least_residual: float = LEAST_RESIDUAL

    def fit(self, samples: DataFrame, setup: Mapping) -> GroupLinear:
        loss = setup.get("loss_type") or "mae"
        options = {"rounds": self.rounds, "tolerance": self.tolerance, "least_residual": self.least_residual}
        return GroupLinear.fit(samples, self.features, by=self.by, loss=loss, ridge=self.ridge, delta=self.delta, **options)
