"""Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def anomaly(x: str | Column, mu: Column, sigma: Column) -> Column:
    """Standardised anomaly; NULL where the cell never varies (sigma = 0)."""
    return F.try_divide(_col(x) - mu, sigma)


def inverse_anomaly(a: str | Column, mu: Column, sigma: Column) -> Column:
    return _col(a) * sigma + mu


def min_max(x: str | Column, lo: Column, hi: Column) -> Column:
    return F.try_divide(_col(x) - lo, hi - lo)


def inverse_min_max(x: str | Column, lo: Column, hi: Column) -> Column:
    return _col(x) * (hi - lo) + lo


def minute_of_day(time: str | Column) -> Column:
    return F.hour(_col(time)) * 60 + F.minute(_col(time))


def hhmm(time: str | Column) -> Column:
    """'HH:MM' label of a timestamp, independent of the session time zone for NTZ input."""
    two = [F.lpad(part(_col(time)).cast("string"), 2, "0") for part in (F.hour, F.minute)]
    return F.concat(two[0], F.lit(":"), two[1])


def channels(*variables: str) -> Column:
    """Stack variables into one feature array, in the given order."""
    return F.array(*variables)


def residual(truth: str | Column, prediction: str | Column, clip: float | None = None) -> Column:
    diff = _col(truth) - _col(prediction)
    return diff if clip is None else F.greatest(F.least(diff, F.lit(clip)), F.lit(-clip))


def degree_label(value: str | Column, direction: str) -> Column:
    """Truncated degrees with a compass letter, e.g. 44.7 -> '44°N'."""
    v = _col(value)
    whole = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("bigint")
    return F.concat(whole.cast("string"), F.lit(f"°{direction}"))


def linear_between(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Point on the line through two known points; known points keep their exact value."""
    return (
        F.when(x == x0, y0)
        .when(x == x1, y1)
        .otherwise(y0 + F.try_divide((y1 - y0) * (x - x0), x1 - x0))
    )
