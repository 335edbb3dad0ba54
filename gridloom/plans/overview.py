"""Tables behind the input maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridloom.operators.select import first_time
from gridloom.schema import HR_STATIC, LAT, LON, LR_STATIC, TEMPERATURE


def first_maps(grid: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(variable, latitude, longitude, value) of the earliest timestep."""
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])
    return first_time(grid).select(LAT, LON, F.inline(rows))


def input_overview(lr: DataFrame, lr_static: DataFrame, hr: DataFrame, hr_static: DataFrame) -> DataFrame:
    """First timestep of temperature and static fields of both products."""
    parts = [
        first_maps(g, v).withColumn("product", F.lit(p))
        for p, g, v in (
            ("lr", lr, [TEMPERATURE]),
            ("lr", lr_static, LR_STATIC),
            ("hr", hr, [TEMPERATURE]),
            ("hr", hr_static, HR_STATIC),
        )
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
