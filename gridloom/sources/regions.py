"""Grid archives whose files are chosen by time and place before the scan.

Rows are dealt to files by (period, place on a Hilbert curve, time), so a file holds a compact box of cells over a
month; a manifest keeps the ranges of time, latitude and longitude of every file.  Reading a region asks the manifest
which files touch it and opens only those; the row filters still reach the Parquet scan.

The curve has one fixed unit for the whole globe, so files written at different times are comparable.  A commit is
one small file that lists the parts (one a write) of the archive, put in place by a rename: readers see all of a write
or none of it, and keep the files they have resolved while the archive is appended to, replaced or rewritten from itself.

Rows with a NULL or NaN key are kept and come back when no range is asked for; a range leaves them out.  An empty grid
is an archive without files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gridloom.operators.select import crop_to_region
from gridloom.schema import HALF_KEY, LAT, LON, TIME, Region, assert_grid
from gridloom.session import Files, stage
from gridloom.sources.snapshots import ConcurrentWrite

#: The curve runs over 2^CURVE_BITS squares a side that cover longitudes from -180 to 360.
CURVE_BITS = 16
ROWS_A_FILE = 8_000_000
RANGES = "file string, n long, time_min timestamp_ntz, time_max timestamp_ntz, lat_min double, lat_max double, lon_min double, lon_max double"


def hilbert(x: Column, y: Column, bits: int = CURVE_BITS) -> Column:
    """Place of square (x, y) on the Hilbert curve over 2^bits squares a side, starting at (0, 0)."""
    side = 1 << bits

    def step(at: Column, s: Column) -> Column:
        east, north = (at["x"].bitwiseAND(s) > 0).cast("long"), (at["y"].bitwiseAND(s) > 0).cast("long")
        # The lower quarters are mirrored along a diagonal, so that the curve enters and leaves at neighbours.
        flip = (north == 0) & (east == 1)
        fx, fy = F.when(flip, side - 1 - at["x"]).otherwise(at["x"]), F.when(flip, side - 1 - at["y"]).otherwise(at["y"])
        turned = north == 0
        return F.struct(
            F.when(turned, fy).otherwise(fx).alias("x"),
            F.when(turned, fx).otherwise(fy).alias("y"),
            (at["d"] + s * s * (east * 3).bitwiseXOR(north)).alias("d"),
        )

    squares = F.array(*(F.lit(1 << b).cast("long") for b in reversed(range(bits))))
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(squares, start, step, lambda at: at["d"])


def curve_place(lat: str = LAT, lon: str = LON) -> Column:
    """Place of a cell on the globe's curve; -1 without coordinates."""
    last = (1 << CURVE_BITS) - 1

    def square(degrees: Column) -> Column:
        return F.least(F.greatest(F.floor(degrees / 540.0 * (last + 1)), F.lit(0)), F.lit(last))

    known = ~(F.isnan(lat) | F.isnan(lon))
    return F.when(known, hilbert(square(F.col(lon) + 180), square(F.col(lat) + 90))).otherwise(F.lit(-1))


@dataclass(frozen=True)
class RegionArchive:
    """An archive under ``path``, a folder that all executors reach."""

    spark: SparkSession
    path: str
    rows_a_file: int = ROWS_A_FILE

    def versions(self) -> list[int]:
        return sorted(int(n) for n in Files(self.spark).names(f"{self.path}/commits") if n.isdigit())

    def _commit(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"{self.path} has no version {'' if version is None else version}".rstrip())
        return json.loads(Files(self.spark).text(f"{self.path}/commits/{known[-1] if version is None else version:010d}"))

    def write(self, grid: DataFrame, append: bool = False, staged: bool = True) -> int:
        """Store ``grid`` in place of the archive's rows, or beside them; the number of the new version.

        The rows are counted and sampled before they are dealt out.  ``staged`` writes them to the scratch folder
        first, so that a long lineage runs once; say False for grids that are plain scans.
        """
        assert_grid(grid)
        files, before = Files(self.spark), self.versions()
        version, part = (before[-1] + 1 if before else 0), uuid.uuid4().hex
        held = self._commit(before[-1]) if append and before else {"parts": [], "schema": json.loads(grid.schema.json())}
        wanted = StructType.fromJson(held["schema"])
        if set(wanted.names) != set(grid.columns):
            raise ValueError(f"the archive has columns {wanted.names}, the grid {grid.columns}")
        rows = grid.select(*(F.col(f.name).cast(f.dataType) for f in wanted))
        self._write_part(rows, part, staged)
        text = json.dumps({"parts": [*held["parts"], part], "schema": held["schema"]})
        if not files.create_once(f"{self.path}/commits/{version:010d}", text):
            for kind in ("data", "manifest"):
                files.delete(f"{self.path}/{kind}/{part}")
            raise ConcurrentWrite(f"version {version} of {self.path} was committed by another writer")
        return version

    def _write_part(self, rows: DataFrame, part: str, staged: bool) -> None:
        rows = stage(rows, "grid") if staged else rows
        parts = max(1, -(-rows.count() // self.rows_a_file))
        rows = rows.withColumns({"_period": F.date_trunc("month", TIME), "_place": curve_place()})
        dealt = rows.repartitionByRange(parts, "_period", "_place", TIME).sortWithinPartitions("_period", "_place", TIME)
        folder = f"{self.path}/data/{part}"
        dealt.drop("_period", "_place").write.option("maxRecordsPerFile", 2 * self.rows_a_file).parquet(folder)
        stored = self.spark.read.schema(rows.drop("_period", "_place").schema).parquet(folder)
        ends = [(TIME, "time"), (LAT, "lat"), (LON, "lon")]
        ranges = [f(c).alias(f"{name}_{end}") for c, name in ends for f, end in ((F.min, "min"), (F.max, "max"))]
        # Partial aggregates: one row a file and task leaves the scan of the three key columns.
        listed = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), *ranges)
        casts = [F.col(f"time_{end}").cast("timestamp_ntz").alias(f"time_{end}") for end in ("min", "max")]
        places = ("lat_min", "lat_max", "lon_min", "lon_max")
        listed.select("file", "n", *casts, *places).write.parquet(f"{self.path}/manifest/{part}")

    def manifest(self, version: int | None = None) -> DataFrame:
        """(part, file, n, ranges) of every file of a version."""
        empty = self.spark.createDataFrame([], f"part string, {RANGES}")
        parts = self._commit(version)["parts"]
        if not parts:
            return empty
        found = self.spark.read.schema(RANGES).parquet(*(f"{self.path}/manifest/{p}" for p in parts))
        folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
        return found.select(folder.alias("part"), *found.columns)

    def files(
        self,
        region: Region | Sequence[float] | None = None,
        first: datetime | None = None,
        last: datetime | None = None,
        version: int | None = None,
    ) -> DataFrame:
        """The manifest's files that may hold rows of the region from ``first`` to ``last``, both included."""
        found, box = self.manifest(version), Region.of(region)
        if box is not None:
            for low, high, name in ((box.lat_min, box.lat_max, "lat"), (box.lon_min, box.lon_max, "lon")):
                found = found.where((F.col(f"{name}_min") <= high + HALF_KEY) & (F.col(f"{name}_max") >= low - HALF_KEY))
        if first is not None:
            found = found.where(F.col("time_max") >= _instant(first))
        if last is not None:
            found = found.where(F.col("time_min") <= _instant(last))
        return found

    def read(
        self,
        region: Region | Sequence[float] | None = None,
        first: datetime | None = None,
        last: datetime | None = None,
        version: int | None = None,
    ) -> DataFrame:
        """Rows of the region (all without one) from ``first`` to ``last``, out of the files that can hold them."""
        known = self.versions()
        version = known[-1] if version is None and known else version
        commit = self._commit(version)
        schema, parts = StructType.fromJson(commit["schema"]), commit["parts"]
        whole = region is None and first is None and last is None
        if whole:
            chosen = [f"{self.path}/data/{p}" for p in parts]
        else:
            # As many names as Spark's own file index would list for the rows to be read.
            listed = self.files(region, first, last, version).select("part", "file").orderBy("part", "file")
            chosen = [f"{self.path}/data/{r.part}/{r.file}" for r in listed.toLocalIterator()]
        if not chosen:
            return self.spark.createDataFrame([], schema)
        rows = crop_to_region(self.spark.read.schema(schema).parquet(*chosen), region)
        if first is not None:
            rows = rows.where(F.col(TIME) >= _instant(first))
        return rows if last is None else rows.where(F.col(TIME) <= _instant(last))

    def clean(self, keep: int = 2) -> list[int]:
        """Delete all versions but the newest ``keep`` and the parts that none of these holds; the deleted numbers.

        Call it when no one writes, and with ``keep`` as many as readers may still hold.
        """
        if keep < 1:
            raise ValueError("the current version is always kept")
        files, known = Files(self.spark), self.versions()
        used = {p for v in known[-keep:] for p in self._commit(v)["parts"]}
        for v in known[:-keep]:
            files.delete(f"{self.path}/commits/{v:010d}")
        for kind in ("data", "manifest"):
            for part in files.names(f"{self.path}/{kind}"):
                if part not in used:
                    files.delete(f"{self.path}/{kind}/{part}")
        return known[:-keep]


def _instant(at: datetime) -> Column:
    return F.lit(at).cast("timestamp_ntz")
