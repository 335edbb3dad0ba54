"""Baseline downscaling models and run configurations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators.align import join_cells, keyed, require_hit
from gridloom.schema import LAT, LON, TEMPERATURE, TIME, with_cell_keys
from gridloom.session import stage


def cell_regression(samples: DataFrame, x: str = TEMPERATURE, y: str = "label") -> DataFrame:
    """Least-squares line per cell; a cell whose input never varies predicts its mean."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    fitted = (
        with_cell_keys(samples)
        .groupBy("lat_key", "lon_key")
        .agg(
            F.min(LAT).alias(LAT),
            F.min(LON).alias(LON),
            F.regr_slope(y, x).alias("_s"),
            F.regr_intercept(y, x).alias("_i"),
            F.regr_r2(y, x).alias("r2"),
            F.avg(F.when(both, F.col(y))).alias("_mean"),
            F.regr_count(y, x).alias("n"),
        )
    )
    line = F.col("_s").isNotNull() & F.col("_i").isNotNull()
    return fitted.select(
        LAT,
        LON,
        F.when(line, F.col("_s")).otherwise(F.lit(0.0)).alias("slope"),
        F.when(line, F.col("_i")).otherwise(F.col("_mean")).alias("intercept"),
        "r2",
        "n",
    )


@dataclass(frozen=True)
class CellLines:
    """Fitted per-cell lines, staged and counted once."""

    table: DataFrame
    x: str = TEMPERATURE

    @classmethod
    def fit(cls, samples: DataFrame, x: str = TEMPERATURE, y: str = "label") -> CellLines:
        return cls(stage(cell_regression(samples, x, y), "cell_lines"), x)

    def predict(
        self, features: DataFrame, output: str = TEMPERATURE, keep: Sequence[str] = (), strict: bool = False
    ) -> DataFrame:
        """One row for each row of ``features``, NULL where no line was fitted; ``strict`` raises there."""
        lines = keyed(self.table, F.col("slope").alias("_slope"), F.col("intercept").alias("_intercept"), F.lit(True).alias("_hit"))
        joined = join_cells(features, lines, self.table.count(), "left")
        found = joined.select(TIME, LAT, LON, *keep, (F.col("_slope") * F.col(self.x) + F.col("_intercept")).alias(output), "_hit")
        return require_hit(found, output, strict, "lines")


@dataclass(frozen=True)
class LineFitter:
    """Least-squares lines per cell on the temperature, whatever loss a setup names."""

    features: tuple[str, ...] = (TEMPERATURE,)

    def fit(self, samples: DataFrame, setup: Mapping) -> CellLines:
        return CellLines.fit(samples)


@dataclass(frozen=True)
class GlobalLinear:
    """One linear model over all cells on a feature vector."""

    model: LinearRegressionModel
    features: tuple[str, ...]

    @classmethod
    def fit(cls, samples: DataFrame, features: Sequence[str], y: str = "label", loss: str = "squaredError") -> GlobalLinear:
        solver = {"solver": "normal"} if loss == "squaredError" else {}
        rows = _vectors(samples.where(F.col(y).isNotNull()), features)
        fitted = LinearRegression(featuresCol="_features", labelCol=y, loss=loss, **solver).fit(rows)
        return cls(fitted, tuple(features))

    def coefficients(self, spark: SparkSession) -> DataFrame:
        values = [*map(float, self.model.coefficients), float(self.model.intercept)]
        names = [*self.features, "intercept"]
        return spark.createDataFrame(list(zip(names, values, strict=True)), "term string, weight double")

    def predict(self, rows: DataFrame, output: str = TEMPERATURE) -> DataFrame:
        # A plain dot product: stays in generated code, no vector UDF at scoring time.
        score = F.lit(float(self.model.intercept))
        for name, weight in zip(self.features, self.model.coefficients, strict=True):
            score = score + F.col(name) * F.lit(float(weight))
        return rows.select(TIME, LAT, LON, score.alias(output))


def _vectors(samples: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip").transform(samples)


def feature_arrays(samples: DataFrame, features: Sequence[str]) -> DataFrame:
    """Assembled vectors as plain arrays."""
    return _vectors(samples, features).withColumn("features", vector_to_array("_features")).drop("_features")


def run_grid(spark: SparkSession, options: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the listed options, one row per run configuration."""
    grid = spark.range(1).select(*[F.lit(list(v)).alias(k) for k, v in options.items()])
    for name in options:
        grid = grid.withColumn(name, F.explode(name))
    return grid
