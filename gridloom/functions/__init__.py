from gridloom.functions.scalars import (
    anomaly,
    channels,
    degree_label,
    hhmm,
    inverse_anomaly,
    inverse_min_max,
    linear_between,
    min_max,
    minute_of_day,
    residual,
)

__all__ = [
    "anomaly",
    "channels",
    "degree_label",
    "hhmm",
    "inverse_anomaly",
    "inverse_min_max",
    "linear_between",
    "min_max",
    "minute_of_day",
    "residual",
]
