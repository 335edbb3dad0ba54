"""Long-table schemas for gridded data and the checks made at public entry points.

A grid is one row per (time, latitude, longitude) with one double column per
variable.  Row order carries no meaning; every operator works on the keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

TIME, LAT, LON = "time", "latitude", "longitude"
LAT_KEY, LON_KEY = "lat_key", "lon_key"
CELL_KEYS = [LAT_KEY, LON_KEY]

# Variable names and attributes that callers of the original API rely on.
TEMPERATURE = "t2m"
LR_STATIC = ["lsm", "z"]
HR_STATIC = ["lsm", "orog"]
TEMPERATURE_ATTRS = {"units": "K", "long_name": "2 metre temperature"}

# Coordinates meet as integers in units of 1e-5 degree, so 0.05*i and 0.25*j compare equal.
KEYS_PER_DEGREE = 100_000


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def grid_schema(*variables: str) -> T.StructType:
    return T.StructType(
        [T.StructField(TIME, T.TimestampNTZType()), *_fields(LAT, LON, *variables)]
    )


GRID = grid_schema(TEMPERATURE)
LR_STATIC_GRID = grid_schema(*LR_STATIC)
HR_STATIC_GRID = grid_schema(*HR_STATIC)

STATS_CELL = T.StructType(
    [T.StructField("data_name", T.StringType()), *_fields(LAT, LON, "mu", "sigma")]
)
STATS_GLOBAL = T.StructType(
    [
        T.StructField("data_name", T.StringType()),
        *_fields("mu", "sigma", "xmin", "xmax"),
    ]
)

MODEL_SETUP = T.StructType(
    [
        T.StructField("normalization_type", T.StringType()),
        T.StructField("scheduler_type", T.StringType()),
        T.StructField("learning_rate_value", T.DoubleType()),
        T.StructField("num_epochs", T.IntegerType()),
        T.StructField("batch_size", T.IntegerType()),
        T.StructField("loss_type", T.StringType()),
        T.StructField("filters", T.ArrayType(T.IntegerType())),
        T.StructField("activation_function", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)
RUN = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("model_setup", MODEL_SETUP),
        T.StructField(
            "training_history",
            T.StructType(
                [
                    T.StructField("training_loss", T.ArrayType(T.DoubleType())),
                    T.StructField("validation_loss", T.ArrayType(T.DoubleType())),
                ]
            ),
        ),
        T.StructField(
            "evaluation_metrics", T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))
        ),
    ]
)


@dataclass(frozen=True)
class Region:
    """Bounding box in the order lon_min, lat_min, lon_max, lat_max; bounds are inclusive."""

    lon_min: float
    lat_min: float
    lon_max: float
    lat_max: float

    @classmethod
    def of(cls, bounds: Region | Sequence[float] | None) -> Region | None:
        if bounds is None or isinstance(bounds, Region):
            return bounds
        return cls(*map(float, bounds))


# Default study area and the smaller area used for the headline experiments.
DEFAULT_REGION = Region(6.5, 42.5, 16.5, 54.0)
CROPPED_REGION = Region(8.3, 43.8, 14.5, 51.5)

# Coordinates this close have the same key.
HALF_KEY = 0.5 / KEYS_PER_DEGREE


def coord_key(name: str | Column) -> Column:
    col = F.col(name) if isinstance(name, str) else name
    return F.round(col * KEYS_PER_DEGREE).cast("bigint")


def with_cell_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({LAT_KEY: coord_key(LAT), LON_KEY: coord_key(LON)})


def nan_to_null(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Missing values arrive as NaN; every aggregate below relies on them being NULL."""
    return df.withColumns(
        {v: F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")) for v in variables}
    )


def assert_grid(df: DataFrame, variables: Sequence[str] = (), time: bool = True) -> DataFrame:
    """Raise early if key or variable columns are missing or have the wrong type."""
    types = dict(df.dtypes)
    wanted = {LAT: {"double"}, LON: {"double"}, **{v: {"double", "float"} for v in variables}}
    if time:
        wanted[TIME] = {"timestamp_ntz", "timestamp"}
    missing = [c for c in wanted if c not in types]
    if missing:
        raise ValueError(f"grid is missing columns {missing}; it has {df.columns}")
    wrong = {c: types[c] for c, ok in wanted.items() if types[c] not in ok}
    if wrong:
        raise TypeError(f"grid columns with unexpected types: {wrong}")
    return df
