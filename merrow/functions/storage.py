"""Written tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


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


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside does not need its shuffle files afterwards: they go with the write, not with a collection of garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/merrow-{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` if it has all the columns, else ValueError."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


class Scratch:
    """The written tables of one job, in a folder of their own; ``result`` writes the outcome beside it and deletes them."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.made = spark, 0
        self.path = f"{shared_folder(spark)}/merrow-{label}-{uuid.uuid4().hex}"

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        self.made += 1
        path = f"{self.path}/{self.made}-{label}"
        with shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)

    def result(self, df: DataFrame) -> DataFrame:
        out = f"{self.path}-result"
        with shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(out)
        self.drop()
        return self.spark.read.schema(df.schema).parquet(out)
