"""A catalog's vectors built by id range: planned once, committed range by range, resumed where it was cut off.

The folder of a build holds its identity (configuration, fingerprint of the source, the encoder's answer to a probe), a plan
of ranges of equal size in the order of ids, and for each wave of ranges the vectors and then one commit record a range. A
record is written after its vectors are, in one commit, and has their number and fingerprint; vectors without a record do
not count and are made again. A source, configuration or encoder other than the build began with is an error on resume.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ids import build_sorted_ids

PROBE = "a text that tells encoders apart"


def fingerprint(*columns: Column | str) -> Column:
    """An aggregate that does not depend on the order of rows: two sums of hashes."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return F.concat_ws(":", *sums)


class EmbeddingBuild:
    """``encode`` turns (id, text) rows into (id, vec) rows of ``dimension`` floats; ``config`` names it and its version."""

    def __init__(self, spark: SparkSession, path: str, encode: Callable[[DataFrame], DataFrame], dimension: int, config: Mapping[str, Any] | None = None) -> None:
        self.spark, self.path, self.encode, self.dimension = spark, path.rstrip("/"), encode, dimension
        self.config = json.dumps({**(config or {}), "dimension": dimension}, sort_keys=True)

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _probe(self) -> list[float]:
        row = self.encode(self.spark.createDataFrame([("probe", PROBE)], "id string, text string")).first()
        return [float(x) for x in row.vec]

    def start(self, items: DataFrame, rows_a_range: int = 1_000_000) -> None:
        """items (id string, text): checks ids, writes identity and plan. An error where the folder has a build."""
        if self._exists("identity"):
            raise FileExistsError(f"{self.path} holds a build: resume it")
        facts = items.agg(F.count("*").alias("n"), F.count("id").alias("ids"), fingerprint("id", "text").alias("source")).first()
        repeated = not items.groupBy("id").count().where("count > 1").isEmpty()
        if not facts.n or facts.ids < facts.n or repeated or not items.where("id = ''").isEmpty():
            raise ValueError("the catalog needs rows, and ids that are unique, not null and not empty")
        placed = build_sorted_ids(items.select(F.col("id").alias("key")), "key")
        edges = placed.where(F.col("idx") % rows_a_range == 0).select((F.col("idx") / rows_a_range).cast("long").alias("range"), F.col("key").alias("low"))
        following = edges.select((F.col("range") - 1).alias("range"), F.col("low").alias("high"))
        left = F.least(F.lit(rows_a_range).cast("long"), F.lit(facts.n) - F.col("range") * rows_a_range)
        edges.join(following, "range", "left").withColumn("rows", left).write.mode("overwrite").parquet(f"{self.path}/plan")
        identity = [(self.config, facts.n, facts.source, self._probe())]
        self.spark.createDataFrame(identity, "config string, rows long, source string, probe array<double>").coalesce(1).write.parquet(f"{self.path}/identity")

    def check(self, items: DataFrame) -> None:
        """ValueError where source, configuration or encoder are not those of the build."""
        if not self._exists("identity"):
            raise FileNotFoundError(f"{self.path} holds no build to resume")
        known = self._read("identity").first()
        if known.config != self.config:
            raise ValueError("the configuration has changed since the build began")
        now = items.agg(F.count("*").alias("n"), fingerprint("id", "text").alias("source")).first()
        if (now.n, now.source) != (known.rows, known.source):
            raise ValueError("the source has changed since the build began")
        probe = self._probe()
        if len(probe) != len(known.probe) or any(abs(a - b) > 1e-5 + 1e-4 * abs(b) for a, b in zip(probe, known.probe)):
            raise ValueError("the encoder answers the probe in another way than when the build began")

    def commits(self) -> DataFrame:
        """(range, wave, rows, vectors): one record a range."""
        if not self._exists("commits"):
            return self.spark.createDataFrame([], "range long, wave string, rows long, vectors string")
        return self._read("commits")

    def run(self, items: DataFrame, ranges_a_wave: int = 8, waves: int | None = None) -> int:
        """Encodes what has no record yet, a wave of ranges a job; the number of ranges that are still open.

        Ranges are looked up by a join on their bounds, of which a wave has ``ranges_a_wave``.
        """
        self.check(items)
        open_ranges = self._read("plan").join(self.commits().select("range"), "range", "left_anti")
        todo = [r.range for r in open_ranges.select("range").orderBy("range").collect()]  # one number a range
        while todo and (waves is None or waves > 0):
            part, todo, waves = todo[:ranges_a_wave], todo[ranges_a_wave:], waves and waves - 1
            self.wave(items, part)
            if waves == 0:
                break
        return len(todo)

    def wave(self, items: DataFrame, ranges: list[int]) -> None:
        name, plan = uuid.uuid4().hex, self._read("plan").where(F.col("range").isin(ranges))
        bounds = F.broadcast(plan.select("range", "low", "high"))  # the ranges of one wave
        at = (F.col("id") >= F.col("low")) & (F.col("high").isNull() | (F.col("id") < F.col("high")))
        placed = items.select("id", "text").join(bounds, at)
        made = self.encode(placed.select("id", "text")).select("id", F.col("vec").cast("array<float>").alias("vec"))
        made.join(bounds, at).select("range", "id", "vec").write.partitionBy("range").parquet(f"{self.path}/vectors/wave={name}")
        odd = (F.size("vec") != self.dimension) | F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        there = self._read(f"vectors/wave={name}").groupBy(F.col("range").cast("long").alias("range"))
        records = there.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(odd, F.lit(True))).alias("odd"), F.count_distinct("id").alias("ids"), fingerprint("id", "vec").alias("vectors"))
        met = plan.select("range", F.col("rows").alias("planned")).join(records, "range", "left")
        bad = met.where("rows IS NULL OR rows <> planned OR ids <> planned OR odd > 0").select("range").limit(10).collect()
        if bad:
            raise ValueError(f"the encoder left out rows or gave odd vectors in ranges {[r.range for r in bad]}")
        met.select("range", F.lit(name).alias("wave"), "rows", "vectors").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def vectors(self) -> DataFrame:
        """(id, vec) of a complete build; ValueError while ranges are open or where vectors are not those of their records."""
        commits, total = self.commits(), self._read("identity").first().rows
        facts = commits.agg(F.count("*").alias("n"), F.count_distinct("range").alias("ranges"), F.sum("rows").alias("rows")).first()
        if facts.n != facts.ranges or facts.rows != total:
            raise ValueError(f"the build is not complete: {facts.rows or 0} of {total} rows")
        waves = [r.wave for r in commits.select("wave").distinct().collect()]  # one name a wave
        whole = self.spark.read.option("basePath", f"{self.path}/vectors").parquet(*[f"{self.path}/vectors/wave={w}" for w in waves])
        now = whole.groupBy(F.col("range").cast("long").alias("range")).agg(fingerprint("id", "vec").alias("now"))
        if not commits.join(now, "range", "left").where("NOT vectors <=> now").isEmpty():
            raise ValueError("vectors differ from their commit records")
        return whole.select("id", "vec")
