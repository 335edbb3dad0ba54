"""Chronological splits and training batches."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.operators.axes import HASH_BUCKETS, dense_index, time_axis
from gridloom.schema import TIME
from gridloom.session import broadcast_if_small, stage

# Held-out fraction and split names.
TEST_SIZE = 0.11
SPLITS = ("train", "val", "test")


def held_out(n: int, size: float | int) -> int:
    """Number of samples put aside from ``n``: a fraction rounds up, a whole number counts."""
    k = math.ceil(size * n) if isinstance(size, float) else size
    if not 0 < k < n:
        raise ValueError(f"cannot hold out {k} of {n} timesteps: no training data would be left")
    return k


def _at(time: datetime) -> Column:
    return F.lit(time.isoformat(sep=" ")).cast("timestamp_ntz")


@dataclass(frozen=True)
class SplitCuts:
    """First validation and first test timestep.

    A split is then a range of time between two literals, so labelling needs no join and a
    filter on one split is a range predicate on the time column that reaches the scan.
    """

    n_times: int
    first_val: datetime
    first_test: datetime

    @classmethod
    def of(cls, grid: DataFrame, test_size: float | int = TEST_SIZE) -> SplitCuts:
        times = stage(grid.select(TIME).distinct(), "times")
        n = times.count()
        n_test = held_out(n, test_size)
        n_val = held_out(n - n_test, test_size)
        starts = [n - n_test - n_val, n - n_test]
        picked = time_axis(times, staged=False).where(F.col("time_idx").isin(*starts))
        val, test = sorted(r.time for r in picked.toLocalIterator())
        return cls(n, val, test)

    def label(self) -> Column:
        t = F.col(TIME)
        return F.when(t < _at(self.first_val), "train").when(t < _at(self.first_test), "val").otherwise("test")

    def where(self, split: str) -> Column:
        t = F.col(TIME)
        if split not in SPLITS:
            raise ValueError(f"split must be one of {SPLITS}")
        val, test = _at(self.first_val), _at(self.first_test)
        return {"train": t < val, "val": (t >= val) & (t < test), "test": t >= test}[split]


def label_splits(grid: DataFrame, test_size: float | int = TEST_SIZE, cuts: SplitCuts | None = None) -> DataFrame:
    cuts = cuts or SplitCuts.of(grid, test_size)
    return grid.withColumn("split", cuts.label())


def split_dataset(lr: DataFrame, hr: DataFrame, test_size: float | int = TEST_SIZE) -> dict[str, DataFrame]:
    """Six range-filtered grids; coarse and fine are cut on their own time axes."""
    out = {}
    for name, grid in (("lr", lr), ("hr", hr)):
        cuts = SplitCuts.of(grid, test_size)
        out |= {f"{name}_{s}": grid.where(cuts.where(s)) for s in SPLITS}
    return out


def split_ratios(labelled: DataFrame) -> DataFrame:
    """Timesteps per split and their share of the product's own timesteps."""
    per_split = labelled.select("split", TIME).distinct().groupBy("split").agg(F.count("*").alias("n_times"))
    total = per_split.agg(F.sum("n_times").alias("n")).scalar()
    return per_split.withColumn("ratio", F.col("n_times") / total)


def batches_per_epoch(grid: DataFrame, batch_size: int) -> DataFrame:
    counted = grid.select(TIME).distinct().agg(F.count("*").alias("n_samples"))
    return counted.withColumn("n_batches", F.ceil(F.col("n_samples") / batch_size).cast("bigint"))


def assign_batches(
    grid: DataFrame, batch_size: int, epochs: int = 1, seed: int = 42, shuffle: bool = True
) -> DataFrame:
    """(epoch, time, position, batch_id): every epoch visits every timestep once.

    The order is a hash of (seed, epoch, time), hence the same on every run and every cluster.
    """
    times = stage(grid.select(TIME).distinct(), "times")
    rows = times.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if shuffle:
        # A positive 52-bit hash; its top 12 bits are the bucket, so buckets rise with the order.
        mixed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "epoch", TIME), 12)
        bucket, order = F.floor(mixed / (2**52 // HASH_BUCKETS)), F.struct(mixed, F.col(TIME))
    else:
        bucket, order = F.year(TIME) * 12 + F.month(TIME), F.struct(F.lit(0), F.col(TIME))
    ranked = dense_index(rows, order, bucket, "position", within=["epoch"])
    return ranked.select("epoch", TIME, "position").withColumn(
        "batch_id", F.floor(F.col("position") / batch_size)
    )


def batch_rows(samples: DataFrame, assignment: DataFrame) -> DataFrame:
    """Paired feature/label rows with the batch they belong to."""
    return samples.join(broadcast_if_small(assignment, assignment.count()), TIME)
