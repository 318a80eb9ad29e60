"""A keyed table that a stream writes in runs and a reader merges: what a batch writes grows with the batch alone.

A micro-batch becomes one run: its rows merged by key. ``fan`` runs of a tier are merged into one run of the next tier,
so a row is written once for each tier, of which there are log(batches) to the base ``fan``. A reader merges the runs
that no finished run of a higher tier covers.

A run's name says its tier and its range of batches, and it counts once its writer has finished it: a batch that is run
again after a failure writes the same run again, a merge that was cut off is not seen. Runs that are covered are deleted
when the merge that covers them is finished and another batch has come, so a reader that started before keeps its files.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession


class Run(NamedTuple):
    tier: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"tier={self.tier}-{self.first:09d}-{self.last:09d}"


class Runs:
    """``merged`` turns rows of several runs into one row a key; merging merged rows again must not change the result."""

    NAME = re.compile(r"tier=(\d+)-(\d+)-(\d+)$")

    def __init__(self, spark: SparkSession, path: str, merged: Callable[[DataFrame], DataFrame], fan: int = 8) -> None:
        if fan < 2:
            raise ValueError("fan: at least 2")
        self.spark, self.path, self.merged, self.fan = spark, path.rstrip("/"), merged, fan

    def _folder(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def runs(self) -> list[Run]:
        """All finished runs; there are at most ``2 * fan`` of each tier at a time."""
        files, top = self._folder()
        if not files.exists(top):
            return []
        names = [s.getPath().getName() for s in files.listStatus(top)]
        found = [Run(*map(int, m.groups())) for m in map(self.NAME.match, names) if m]
        return sorted(r for r in found if files.exists(self._folder(f"{r.name}/_SUCCESS")[1]))

    @staticmethod
    def live(runs: Sequence[Run]) -> list[Run]:
        """The runs that no run of a higher tier covers."""
        return [r for r in runs if not any(o.tier > r.tier and o.first <= r.first and r.last <= o.last for o in runs)]

    def write(self, rows: DataFrame, run: Run) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{run.name}")

    def add(self, batch: DataFrame, epoch: int) -> None:
        """Writes the run of a batch, merges tiers that are full; the same batch may come again. A function for foreachBatch."""
        self.sweep()
        self.write(self.merged(batch), Run(0, epoch, epoch))
        tier, span = 0, 1
        while (epoch + 1) % (span * self.fan) == 0:
            parts = [Run(tier, a, a + span - 1) for a in range(epoch + 1 - span * self.fan, epoch + 1, span)]
            there = set(self.runs())
            if not set(parts) <= there:
                break  # batches before the first one of this table
            self.write(self.merged(self.read(parts)), Run(tier + 1, parts[0].first, epoch))
            tier, span = tier + 1, span * self.fan

    def sweep(self) -> None:
        """Deletes the runs that were covered before this batch."""
        runs = self.runs()
        for run in set(runs) - set(self.live(runs)):
            files, folder = self._folder(run.name)
            files.delete(folder, True)

    def read(self, runs: Sequence[Run]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{r.name}" for r in runs])

    def current(self) -> DataFrame:
        """The merged table as of the last finished batch."""
        runs = self.live(self.runs())
        if not runs:
            raise ValueError(f"no finished batch in {self.path}")
        return self.merged(self.read(runs))


def by_key(keys: Sequence[str], **values: Column) -> Callable[[DataFrame], DataFrame]:
    """A merge by aggregates that have the name of the column they merge: partial ones shrink before the shuffle."""
    return lambda rows: rows.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()])
