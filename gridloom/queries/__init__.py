from gridloom.queries import (  # noqa: F401  (importing registers the queries)
    alignment,
    daily,
    evaluation,
    experiments,
    growth,
    modelling,
    normalization,
    raster,
    regression,
    selection,
    sources,
    splitting,
)
from gridloom.queries.registry import QUERIES, SQL

#: Names that once stood for part of the table; now they are the same queries as those over all of it.
WHOLE = ("concat_along_time", "densify_grid", "gap_fill_along_longitude", "row_scorer", "tile_layout", "tile_round_trip", "tile_scorer")
for _name in WHOLE:
    QUERIES[_name], SQL[_name] = QUERIES[f"{_name}_whole"], SQL[f"{_name}_whole"]

__all__ = ["QUERIES", "SQL"]
