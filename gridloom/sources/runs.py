"""Run summaries as JSON: one record per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.schema import MODEL_SETUP, RUN


def metric_map(scored: DataFrame) -> DataFrame:
    """Columns of the metric bundle as the map stored in a run summary."""
    single = ["rmse", "rmse_percentage_true", "mae", "mae_percentage_true"]
    pairs = {"true_values_interval": ("true_min", "true_max"), "predictions_interval": ("pred_min", "pred_max")}
    entries = [(F.lit(k), F.array(*[F.col(c).cast("double") for c in cols])) for k, cols in pairs.items()]
    entries += [(F.lit(c), F.array(F.col(c).cast("double"))) for c in single]
    return scored.withColumn("evaluation_metrics", F.create_map(*[e for pair in entries for e in pair]))


def run_records(scored: DataFrame, run_id, setup: dict, training_loss, validation_loss) -> DataFrame:
    """Metric rows -> run records; ``run_id`` and the losses may be columns of ``scored``."""
    fields = [F.lit(setup.get(f.name)).cast(f.dataType).alias(f.name) for f in MODEL_SETUP.fields]
    history = F.struct(
        training_loss.cast("array<double>").alias("training_loss"),
        validation_loss.cast("array<double>").alias("validation_loss"),
    )
    return metric_map(scored).select(
        run_id.cast("string").alias("run_id"),
        F.struct(*fields).alias("model_setup"),
        history.alias("training_history"),
        "evaluation_metrics",
    )


def save_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def load_runs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read run summaries; pretty-printed single-run files need ``multi_line``.

    Files without a run_id take it from their name, model_and_results_<suffix>.json.
    """
    runs = spark.read.schema(RUN).option("multiLine", multi_line).json(path)
    from_name = F.nullif(F.regexp_extract(F.input_file_name(), r"model_and_results_(.+)\.json", 1), F.lit(""))
    return runs.withColumn("run_id", F.coalesce("run_id", from_name))


def leaderboard(runs: DataFrame, k: int = 10) -> DataFrame:
    """The k runs with the smallest RMSE."""
    value = lambda name: F.try_element_at("evaluation_metrics", F.lit(name))[0].alias(name)
    scores = runs.select("run_id", *map(value, ("rmse", "rmse_percentage_true", "mae", "mae_percentage_true")))
    return scores.orderBy("rmse", "run_id").limit(k)


def training_history(runs: DataFrame) -> DataFrame:
    """(run_id, epoch, loss, val_loss), epochs counted from 1."""
    both = F.arrays_zip("training_history.training_loss", "training_history.validation_loss")
    rows = runs.select("run_id", F.posexplode(both).alias("_i", "_e"))
    return rows.select(
        "run_id",
        (F.col("_i") + 1).alias("epoch"),
        F.col("_e.training_loss").alias("loss"),
        F.col("_e.validation_loss").alias("val_loss"),
    )


def best_epochs(runs: DataFrame) -> DataFrame:
    """Epoch with the smallest validation loss of every run."""
    return training_history(runs).groupBy("run_id").agg(
        F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"), F.min("val_loss").alias("best_val_loss")
    )
