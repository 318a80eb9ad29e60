"""Search that leaves out the postings that cannot change the result.

What a posting adds to a score does not depend on the query, so the index holds it. Documents are dealt into blocks of
bounded size and similar length, and each token has a bound in each block: the most that it adds to a document there. With
a floor that a score has to reach, a block whose bounds together stay below it is skipped. In the other blocks the tokens of
the smallest bounds, as long as their sum stays below the floor, find no documents: only documents with one of the other
tokens can get there, and only for those that still may are the left-out tokens looked up. All results are exact.

Defined cases: an identifier is one document; postings or queries without identifier take no part; a query without any
known token has no rows; equal scores (rounded, so they are the same everywhere) are ordered by identifier.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merrow.functions.storage import Scratch

from .text import FLOOR, K1, B

BLOCK, SEEDS = 64, 8
SLACK = 2e-6  # scores are compared after rounding to six digits


@dataclass
class Index:
    """rows (token, block, id, impact), bounds (token, block, top)."""

    rows: DataFrame
    bounds: DataFrame


def block_index(job: Scratch, postings: DataFrame, visible: DataFrame | None = None, tokens: DataFrame | None = None, block: int = BLOCK) -> Index:
    """The index of all postings, or of those of ``tokens`` (token); ``visible`` (id) restricts documents and all statistics."""
    rows = postings.where(F.col("id").isNotNull())
    rows = rows if visible is None else rows.join(visible.select("id").distinct(), "id", "left_semi")
    lengths = rows.groupBy("id").agg(F.first("dl").alias("dl"))
    bands = job.stored(lengths.groupBy(_band().alias("band")).agg(F.count("*").alias("docs"), F.sum("dl").alias("words")), "bands")
    size = bands.agg(F.sum("docs").alias("docs"), (F.sum("words") / F.sum("docs")).alias("avgdl"))
    parts = bands.select("band", F.ceil(F.col("docs") / block).alias("parts"))  # two rows for each doubling of the length
    if tokens is not None:
        rows = rows.join(tokens.select("token").distinct(), "token", "left_semi")
    df = rows.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    placed = rows.withColumn("band", _band()).join(F.broadcast(parts), "band").join(df, "token").crossJoin(size)  # one row of statistics
    number = F.col("band") * F.lit(1 << 40) + F.pmod(F.xxhash64("id"), F.col("parts"))
    held = job.stored(placed.select("token", number.alias("block"), "id", impact.alias("impact")), "impacts")
    return Index(held, job.stored(held.groupBy("token", "block").agg(F.max("impact").alias("top")), "bounds"))


def _band():
    return F.floor(2 * F.log2(F.greatest("dl", F.lit(1))))


def asked_bounds(job: Scratch, index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, token, block, top) of each token of each query in each block that has it."""
    asked = queries.where(F.col("query_id").isNotNull()).select("query_id", "token").distinct()
    return job.stored(asked.join(index.bounds, "token").select("query_id", "token", "block", "top"), "asked")


def needed_tokens(met: DataFrame, floors: DataFrame) -> DataFrame:
    """The tokens in the blocks that may reach the query's floor; ``needed`` ones find documents, the others only add to them.

    floors (query_id, floor): a query without a floor needs all its tokens everywhere. ``below`` is the sum of the bounds
    up to this token, smallest first; a window sees one query's tokens in one block.
    """
    most = met.groupBy("query_id", "block").agg(F.sum("top").alias("most")).join(floors, "query_id", "left")
    reach = lambda total: F.col("floor").isNull() | (F.col(total) >= F.col("floor") - SLACK)
    order = Window.partitionBy("query_id", "block").orderBy("top", "token").rowsBetween(Window.unboundedPreceding, 0)
    alive = met.join(most.where(reach("most")).drop("most"), ["query_id", "block"])
    return alive.withColumn("below", F.sum("top").over(order)).withColumn("needed", reach("below"))


def scores_reaching(job: Scratch, index: Index, met: DataFrame, floors: DataFrame) -> DataFrame:
    """(query_id, id, score) of all documents whose score reaches the query's floor; a few more may come along."""
    split = job.stored(needed_tokens(met, floors), "split")
    found = index.rows.join(split.where("needed").select("query_id", "token", "block"), ["token", "block"])
    found = found.groupBy("query_id", "block", "id").agg(F.sum("impact").alias("impact"))
    rest = split.groupBy("query_id", "block").agg(F.max("floor").alias("floor"), F.coalesce(F.max(F.when(~F.col("needed"), F.col("below"))), F.lit(0.0)).alias("rest"))
    may = found.join(rest, ["query_id", "block"]).where(F.col("floor").isNull() | (F.col("impact") + F.col("rest") >= F.col("floor") - SLACK))
    may = job.stored(may.select("query_id", "block", "id", "impact"), "candidates")
    others = may.drop("impact").join(split.where(~F.col("needed")).select("query_id", "token", "block"), ["query_id", "block"])
    added = others.join(index.rows, ["token", "block", "id"]).select("query_id", "id", "impact")
    total = may.select("query_id", "id", "impact").unionByName(added).groupBy("query_id", "id").agg(F.sum("impact").alias("score"))
    return total.withColumn("score", F.round("score", 6))


def kth_of_best_blocks(index: Index, met: DataFrame, limit: int, seeds: int = SEEDS) -> DataFrame:
    """(query_id, floor): the score of rank ``limit`` within the blocks of the largest bounds; the true one is no smaller."""
    best = met.groupBy("query_id", "block").agg(F.sum("top").alias("most"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "block"))).where(F.col("n") <= seeds)
    hits = index.rows.join(met.join(best.select("query_id", "block"), ["query_id", "block"]).drop("top"), ["token", "block"])
    scores = hits.groupBy("query_id", "id").agg(F.sum("impact").alias("floor"))
    ranked = scores.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("floor"))))
    return ranked.where(F.col("n") == limit).select("query_id", "floor")


def search(postings: DataFrame, queries: DataFrame, limit: int, visible: DataFrame | None = None, block: int = BLOCK, seeds: int = SEEDS) -> DataFrame:
    """queries (query_id, token) -> the ``limit`` best documents of each: query_id, id, score, rank."""
    job = Scratch(postings.sparkSession, "search")
    index = block_index(job, postings, visible, queries, block)
    met = asked_bounds(job, index, queries)
    floors = job.stored(kth_of_best_blocks(index, met, limit, seeds), "floors")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = scores_reaching(job, index, met, floors).withColumn("rank", F.row_number().over(order))
    return job.result(ranked.where(F.col("rank") <= limit))


def rank_of(postings: DataFrame, queries: DataFrame, targets: DataFrame, shown: int = 25) -> DataFrame:
    """targets (query_id, id): place in the complete ranking, and what it says about the miss.

    The targets' own scores are the floors: whatever stays below is behind them. Those before a target are counted.
    """
    job = Scratch(postings.sparkSession, "rank-of")
    index = block_index(job, postings, tokens=queries)
    asked = queries.select("query_id", "token").distinct()
    wanted = targets.select("query_id", "id").distinct()
    own = index.rows.join(wanted, "id").join(asked, ["query_id", "token"]).groupBy("query_id", "id").agg(F.sum("impact").alias("score"))
    floors = job.stored(own.groupBy("query_id").agg(F.min("score").alias("floor")), "floors")
    met = asked_bounds(job, index, queries.join(floors, "query_id", "left_semi"))
    scores = job.stored(scores_reaching(job, index, met, floors), "scores")
    at = scores.join(wanted, ["query_id", "id"]).select("query_id", F.col("id").alias("_id"), F.col("score").alias("_score"))
    before = (F.col("score") > F.col("_score")) | (F.col("score") == F.col("_score")) & (F.col("id") <= F.col("_id"))
    ranks = scores.join(at, "query_id").groupBy("query_id", "_id").agg(F.count_if(before).cast("int").alias("rank"))
    found = targets.join(ranks.withColumnRenamed("_id", "id"), ["query_id", "id"], "left")
    return job.result(found.withColumn("place", F.when(F.col("rank").isNull(), "no_match").when(F.col("rank") <= shown, "inside").otherwise("outside")))
