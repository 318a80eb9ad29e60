"""Exact duplicates by a log-structured merge index of digests (DataFrame functions only).

Every task is a memtable: it sorts the digests of its rows and flushes them as a sorted run file. ``FANOUT`` runs of a
tier are compacted into one run of the next, and in the end all are; compaction merges by digest, keeps the smallest (or
largest) identifier and the number of rows. Each compacted run has a filter over the digests that are in it more than
once, or, for look-ups of other documents, over all: a bitmap with one position for each, of 16 MB at most, so it may be
broadcast. Look-ups probe the filter first, so only texts that may have a copy are shuffled. Every hit is then
verified byte by byte against the text of the row that stays. Rows that fail (two texts with one digest) are grouped
anew by their bytes. A group of any size is dealt to many tasks, each with a copy of the text that stays.

Defined cases: a null text is the empty text; texts of any length are compared whole; null identifiers never stay if the
group has another; a row that repeats identifier and text is kept with its twin; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, Tables, documents, join_dealt, plain_text, salted

FANOUT = 4


class DigestIndex:
    """Sorted runs by tier; ``keep`` is 'min' or 'max'."""

    def __init__(self, tables: Tables, keep: str = "min") -> None:
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        self.tables, self.keep = tables, keep
        self.tiers: dict[int, list[DataFrame]] = defaultdict(list)

    def best(self, column: str) -> Column:
        return (F.min if self.keep == "min" else F.max)(column)

    def flush(self, entries: DataFrame) -> None:
        """entries: (digest, id). A sorted run file from each task's memtable; full tiers are compacted."""
        run = entries.select("digest", "id", F.lit(1).cast("long").alias("n")).sortWithinPartitions("digest", "id")
        self.tiers[0].append(self.tables.stored(run, "run"))
        tier = 0
        while len(self.tiers[tier]) >= FANOUT:
            self.tiers[tier + 1].append(self.merged(self.tiers.pop(tier)))
            tier += 1

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        level = rows.groupBy("digest").agg(self.best("id").alias("id"), F.sum("n").alias("n"))
        return self.tables.stored(level.sortWithinPartitions("digest"), "level")

    def compact(self) -> DataFrame:
        """All runs in one: (digest, id, n) with one row a digest."""
        level = self.merged([run for runs in self.tiers.values() for run in runs])
        self.tiers = defaultdict(list, {max(self.tiers, default=0) + 1: [level]})
        return level

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows with a digest -> those with a copy in the index, with keep_id and n."""
        level = self.compact()
        found = Filter(self.tables, level, "digest").probe(rows)
        known = level.select("digest", F.col("id").alias("keep_id"), "n")
        return join_dealt(found, known, ["digest"], "n", level.agg(F.sum("n")).first()[0] or 0, ["digest"])


def exact_duplicates(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256."""
    tables = Tables(docs.sparkSession, "lsm")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), plain_text(text_col).alias("text")).withColumn("digest", F.sha2("text", 256))
    index = DigestIndex(tables, keep)
    index.flush(rows.select("digest", "id"))
    level = index.compact().withColumnRenamed("id", "keep_id")
    groups = tables.stored(level.where("n > 1"), "groups")
    total = level.agg(F.sum("n")).first()[0] or 0

    hits = join_dealt(Filter(tables, groups, "digest").probe(rows), groups, ["digest"], "n", total, ["id"])
    hits = tables.stored(hits, "hits")
    keepers = hits.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "n").agg(F.min("text").alias("keep_text"))
    met = salted(hits, tables.stored(keepers, "keepers"), "digest", "n", "id")
    clashes = tables.stored(met.where(F.col("text") != F.col("keep_text")).select("digest").distinct(), "clashes")
    columns = ["id", "keep_id", "n", "digest"]
    found = level.where("n = 1").select(F.col("keep_id").alias("id"), "keep_id", "n", "digest")
    if clashes.isEmpty():
        found = found.unionByName(hits.select(*columns))
    else:
        texts = hits.select("id", "digest", "text").join(clashes, "digest")
        anew = tables.stored(texts.groupBy("digest", "text").agg(index.best("id").alias("keep_id"), F.count("*").alias("n")), "anew")
        found = found.unionByName(hits.join(clashes, "digest", "left_anti").select(*columns))
        found = found.unionByName(texts.join(anew, ["digest", "text"]).select(*columns))
    return tables.result(
        found.select(
            F.col("id").alias(id_col),
            "keep_id",
            F.col("n").alias("group_size"),
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), keep="max")


OP3_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
