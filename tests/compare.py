"""Order-insensitive comparison of a Spark result with the SQL run by DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def canonical(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if hasattr(value, "tolist") and not isinstance(value, pd.Timestamp):
        value = value.tolist()
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return str(value)


def rows(frame: pd.DataFrame) -> Counter:
    frame = frame[sorted(frame.columns)]
    return Counter(tuple(map(canonical, r)) for r in frame.itertuples(index=False, name=None))


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    # A column of NULLs only has no kind of its own.
    kinds = [
        (c, spark_frame[c].dtype.kind, sql_frame[c].dtype.kind)
        for c in spark_frame.columns
        if spark_frame[c].dtype.kind != sql_frame[c].dtype.kind and not (spark_frame[c].isna().all() and sql_frame[c].isna().all())
    ]
    if kinds:
        return f"column kinds differ: {kinds}"
    a, b = rows(spark_frame), rows(sql_frame)
    if a == b or close(spark_frame, sql_frame):
        return None
    return f"{len(spark_frame)} vs {len(sql_frame)} rows; only Spark {list((a - b))[:3]}; only SQL {list((b - a))[:3]}"


def close(a: pd.DataFrame, b: pd.DataFrame, tolerance: float = 1.5e-6) -> bool:
    """Equal keys, and floats apart by no more than the last rounded digit."""
    if len(a) != len(b):
        return False
    floats = [c for c in a.columns if a[c].dtype.kind == "f"]
    keys = sorted(c for c in a.columns if c not in floats)
    order = keys + [c for c in ("latitude", "longitude") if c in floats]
    if not order or any(isinstance(v, list | np.ndarray) for c in keys for v in a[c].head(1)):
        return False
    a, b = (f.sort_values(order, ignore_index=True)[sorted(a.columns)] for f in (a, b))
    same_keys = all((a[c].astype(str) == b[c].astype(str)).all() for c in keys)
    return same_keys and all(np.allclose(a[c], b[c], rtol=0, atol=tolerance, equal_nan=True) for c in floats)
