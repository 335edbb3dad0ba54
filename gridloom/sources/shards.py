"""Batches of an epoch as files: one folder a batch, features and labels as tiles, a manifest an epoch.

An epoch is written as one job: timesteps become tiles, meet their place in the order of ``assign_batches``
and go to the folder of their batch.  The manifest of an epoch is written last, so an epoch whose writer was
lost is not there and is written again from the start; batches of a finished epoch are read from any point on,
and the folders before it are pruned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators.axes import GridAxes
from gridloom.operators.split import assign_batches
from gridloom.operators.tiles import TILE_SIDE, to_tiles
from gridloom.schema import LAT, LON, TIME
from gridloom.session import Files, broadcast_if_small, stage


@dataclass(frozen=True)
class BatchShards:
    """Shards under ``path``, a folder that all executors reach; ``size`` is the side of a tile."""

    spark: SparkSession
    path: str
    size: int = TILE_SIDE

    def _epoch(self, kind: str, epoch: int) -> str:
        return f"{self.path.rstrip('/')}/{kind}/epoch-{epoch:06d}"

    def epochs(self) -> list[int]:
        """Finished epochs in ascending order."""
        files, root = Files(self.spark), f"{self.path.rstrip('/')}/manifest"
        return [int(n[6:]) for n in files.names(root) if n.startswith("epoch-") and "_SUCCESS" in files.names(f"{root}/{n}")]

    def write(
        self,
        samples: DataFrame,
        variables: Sequence[str],
        batch_size: int,
        epochs: int = 1,
        seed: int = 42,
        shuffle: bool = True,
        axes: GridAxes | None = None,
    ) -> list[int]:
        """Store ``variables`` (features and label) of the paired rows, epoch by epoch; the epochs written.

        Finished epochs are left as they are.  Tiles are made once and staged; an epoch then moves each
        tile once, by batch, and AQE cuts large batches into several files of the same folder.
        """
        missing = [e for e in range(epochs) if e not in self.epochs()]
        if not missing:
            return []
        tiles = stage(to_tiles(samples, variables, axes or GridAxes.of(samples), self.size), "tiles")
        order = stage(assign_batches(samples, batch_size, epochs, seed, shuffle), "order")
        for epoch in missing:
            places = order.where(F.col("epoch") == epoch).drop("epoch")
            rows = tiles.join(broadcast_if_small(places, places.count()), TIME)
            shards = rows.hint("rebalance", "batch_id").sortWithinPartitions("batch_id", "position", "tile_y", "tile_x")
            shards.write.mode("overwrite").partitionBy("batch_id").parquet(self._epoch("data", epoch))
            counts = self._tiles(epoch).groupBy("batch_id").agg(
                F.countDistinct("position").alias("n_times"), F.count("*").alias("n_tiles"), F.min("position").alias("first_position")
            )
            counts.write.mode("overwrite").parquet(self._epoch("manifest", epoch))
        return missing

    def _tiles(self, epoch: int) -> DataFrame:
        return self.spark.read.parquet(self._epoch("data", epoch)).withColumn("batch_id", F.col("batch_id").cast("long"))

    def manifest(self, epoch: int) -> DataFrame:
        """(batch_id, n_times, n_tiles, first_position) of a finished epoch."""
        if epoch not in self.epochs():
            raise ValueError(f"{self.path} has no finished epoch {epoch}")
        return self.spark.read.parquet(self._epoch("manifest", epoch))

    def read(self, epoch: int, first_batch: int = 0) -> DataFrame:
        """Tiles of an epoch from a batch on; ``position`` gives the order of the timesteps."""
        self.manifest(epoch)
        return self._tiles(epoch).where(F.col("batch_id") >= first_batch)

    def batches(self, epoch: int = 0, first_batch: int = 0) -> Iterator[tuple[int, int, DataFrame]]:
        """(epoch, batch, its tiles), one after the other, from (``epoch``, ``first_batch``) to the last finished epoch."""
        for e in (e for e in self.epochs() if e >= epoch):
            start = first_batch if e == epoch else 0
            # One small row a batch, fetched a partition at a time.
            listed = self.manifest(e).where(F.col("batch_id") >= start).select("batch_id").orderBy("batch_id")
            for row in listed.toLocalIterator():
                yield e, row.batch_id, self._tiles(e).where(F.col("batch_id") == row.batch_id)

    def cells(self, tiles: DataFrame, variables: Sequence[str], axes: GridAxes) -> DataFrame:
        """(batch_id, position, time, latitude, longitude, variables) of tiles; cells without any value are left out."""
        place = ["batch_id", "position", TIME, "tile_y", "tile_x"]
        rows = tiles.select(*place, F.posexplode(F.arrays_zip(*variables)).alias("_r", "_row"))
        line = F.arrays_zip(*(F.col("_row")[v].alias(v) for v in variables))
        found = rows.select(*place, "_r", F.posexplode(line).alias("_c", "_cell"))
        values = [F.col("_cell")[v].alias(v) for v in variables]
        north = F.lit(axes.size(LAT) - 1) - (F.col("tile_y") * self.size + F.col("_r"))
        east = F.col("tile_x") * self.size + F.col("_c")
        out = found.select(
            "batch_id", "position", TIME, F.get(axes.values(LAT), north).alias(LAT), F.get(axes.values(LON), east).alias(LON), *values
        )
        return out.where(F.coalesce(*variables).isNotNull())
