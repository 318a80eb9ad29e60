"""Shared helpers: reading inputs, tables in the shared folder, byte-hash kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or given to setCheckpointDir; a temporary one only on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = given.get() if given.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them can reach")
        path = "file://" + tempfile.mkdtemp(prefix="merrow-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: cuts the lineage and survives lost executors."""
    return write(df, f"{shared_folder(df.sparkSession)}/merrow-{label}-{uuid.uuid4().hex}")


class Tables:
    """The written tables of one job, in a folder of their own; ``result`` writes the outcome beside it and deletes them."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.made = spark, 0
        self.path = f"{shared_folder(spark)}/merrow-{label}-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        self.made += 1
        return write(df, f"{self.path}/{self.made}-{label}")

    def result(self, df: DataFrame) -> DataFrame:
        out = write(df, f"{self.path}-result")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
        return out


#: A key with more than one in so many of all rows is hot; there are no more hot keys than that, so they may be broadcast.
HOT_SHARE = 10_000


def join_dealt(rows: DataFrame, keyed: DataFrame, on: list[str], size: str, total: int, by: list[str], alike: bool = False) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, a written table with one row a key and the key's number of rows in ``size``.

    The rows of hot keys meet their partner by broadcast (at most ``HOT_SHARE`` keys) and are dealt by ``by`` in the
    shuffle of the others, so no task gets all rows of one key. ``alike``: the others are sorted and merged at every size, so
    that small inputs tell what large ones cost.
    """
    others, least = [c for c in keyed.columns if c not in on], max(total // HOT_SHARE, 512)
    alone = F.pmod(F.xxhash64(*on), F.lit(1))  # zero, but not a constant, which would fall out of the join's keys
    hot = keyed.where(F.col(size) > least).select(*on, F.struct(*others).alias("_hot"))
    cool = keyed.where(F.col(size) <= least).select(*on, alone.alias("_deal"), F.struct(*others).alias("_cool"))
    deal = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*by), F.lit(1024))).otherwise(alone)
    cool = cool.hint("merge") if alike else cool
    met = rows.join(F.broadcast(hot), on, "left").withColumn("_deal", deal).join(cool, [*on, "_deal"], "left")
    met = met.where("_hot IS NOT NULL OR _cool IS NOT NULL")
    return met.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cool.{c}")).alias(c) for c in others])


def salted(rows: DataFrame, wide: DataFrame, on: str, size: str, by: str, least: int = 512) -> DataFrame:
    """Inner join on ``on``: of the ``size`` rows of a key, a column of both tables, every ``least`` or so meet a copy of the key's wide row."""
    parts = F.ceil(F.col(size) / least).cast("long")
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), parts))
    copies = wide.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop(size)
    return dealt.join(copies, [on, "_part"]).drop("_part")


class Filter:
    """Bitmaps (_bucket, _map) over the keys of a table; eight bits a key or more up to ``BITS``, where it lets more through."""

    MAP_BITS, BITS = 1 << 15, 1 << 27  # of a bitmap of the built-in aggregate, and of the whole filter

    def __init__(self, tables: Tables, keys: DataFrame, key: str) -> None:
        n, self.key, self.bits = keys.count(), key, self.MAP_BITS
        while self.bits < min(8 * n, self.BITS):
            self.bits *= 2
        places = self.placed(keys).select("_bucket", "_bit").repartition("_bucket")
        self.maps = tables.stored(places.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map")), "filter")

    def placed(self, rows: DataFrame) -> DataFrame:
        place = F.pmod(F.xxhash64(F.lit(3), self.key), F.lit(self.bits))
        return rows.withColumn("_bucket", F.floor(place / self.MAP_BITS).cast("int")).withColumn("_bit", (place % self.MAP_BITS).cast("int"))

    def probe(self, rows: DataFrame) -> DataFrame:
        """The rows whose key may be in the filter (all that are, few others)."""
        hit = "(shiftright(cast(conv(hex(substring(_map, _bit div 8 + 1, 1)), 16, 10) as int), _bit % 8) & 1) = 1"
        # BITS / MAP_BITS bitmaps of 4 kB at most: 16 MB
        return self.placed(rows).join(F.broadcast(self.maps), "_bucket").where(hit).select(*rows.columns)


def plain_text(column: str = "text"):
    """Null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays (new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hashes modulo 2**64 of byte ranges, by prefix sums over an odd base."""

    BASE = 0xD6E8FEB86659FD93

    def __init__(self) -> None:
        self._grow(1 << 14)

    def _grow(self, n: int) -> None:
        inverse = pow(self.BASE, -1, 1 << 64)
        down = np.full(n + 1, inverse, np.uint64)
        up = np.full(n + 1, self.BASE, np.uint64)
        down[0] = up[0] = 1
        self.down, self.up = np.multiply.accumulate(down), np.multiply.accumulate(up)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of a uint8 array, one longer than it."""
        if len(data) + 1 > len(self.up):
            self._grow(2 * len(data) + 2)
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((sums[end] - sums[start]) * self.up[start])
