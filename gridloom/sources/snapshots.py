"""Datasets that are overwritten while others read them.

Every write is a new numbered snapshot in a folder of its own; a small manifest file, put in place by one rename,
makes it the current one.  A reader resolves the manifest once and keeps reading that snapshot, so a dataset may be
overwritten while it is read, also by a job that reads it.  Two writers who start from the same snapshot cannot
both commit: the second rename fails and its files are removed.  Old snapshots stay until ``clean``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gridloom.session import Files


class ConcurrentWrite(RuntimeError):
    """Another writer has committed since this one started."""


@dataclass(frozen=True)
class SnapshotTable:
    """Snapshots of one dataset under ``path``, a folder that all executors reach."""

    spark: SparkSession
    path: str

    def versions(self) -> list[int]:
        """Committed snapshots, oldest first."""
        return sorted(int(n) for n in Files(self.spark).names(f"{self.path}/manifest") if n.isdigit())

    def folder(self, version: int) -> str:
        return f"{self.path}/data/{Files(self.spark).text(f'{self.path}/manifest/{version:010d}')}"

    def write(self, rows: DataFrame, *partition_by: str) -> int:
        """Store ``rows`` as the next snapshot and make it the current one; its number."""
        files, before = Files(self.spark), self.versions()
        version = before[-1] + 1 if before else 0
        name = f"{version:010d}-{uuid.uuid4().hex}"
        rows.write.partitionBy(*partition_by).parquet(f"{self.path}/data/{name}")
        if not files.create_once(f"{self.path}/manifest/{version:010d}", name):
            files.delete(f"{self.path}/data/{name}")
            raise ConcurrentWrite(f"snapshot {version} of {self.path} was committed by another writer")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """The current snapshot, or an older one that still exists."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"{self.path} has no snapshot {'' if version is None else version}".rstrip())
        return self.spark.read.parquet(self.folder(known[-1] if version is None else version))

    def clean(self, keep: int = 2) -> list[int]:
        """Delete all but the newest ``keep`` snapshots, and what writers left that never committed.

        Call it when no one writes, and with ``keep`` as many as readers may still hold.  The deleted numbers.
        """
        if keep < 1:
            raise ValueError("the current snapshot is always kept")
        files, known = Files(self.spark), self.versions()
        gone, kept = known[:-keep], known[-keep:]
        named = {self.folder(v).rsplit("/", 1)[1] for v in kept}
        for v in gone:
            files.delete(f"{self.path}/manifest/{v:010d}")
        for name in files.names(f"{self.path}/data"):
            if name not in named:
                files.delete(f"{self.path}/data/{name}")
        return gone
