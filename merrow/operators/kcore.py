"""k-core filters by frontier: degrees are state, and a round looks only at the neighbours of what the last one dropped.

Events become weighted edges once. A round takes the users and items that have fallen below k, sums what their edges took
from the nodes that are still there, and finds those that fall below k by that. What it writes grows with what is dropped,
not with the events; the events are read once more at the end, to leave out the dropped users and items. All counts of a
round come from one snapshot and both filters act at once, so a run that stops at the limit of rounds gives the same rows
as filtering the events themselves round by round.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merrow.functions.storage import Scratch

from .ids import build_sorted_ids

SIDES = ("u", "i")


class Peeling:
    """Rounds of dropping over edges (u, i, n); a node without a key goes in the first round."""

    def __init__(self, scratch: Scratch, edges: DataFrame, least: dict[str, int]) -> None:
        self.scratch, self.least = scratch, least
        self.edges = scratch.stored(edges, "edges")
        both = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("node")) for s in SIDES])).alias("x")
        self.degrees = scratch.stored(self.edges.select(both, "n").groupBy("x.side", "x.node").agg(F.sum("n").alias("n")), "degrees")
        self.taken: DataFrame | None = None  # (side, node, n) of every round
        self.dropped: DataFrame | None = None  # (side, node)
        self.rounds = 0

    def few(self, n: str = "n"):
        by_side = F.when(F.col("side") == "u", F.lit(self.least["u"])).otherwise(F.lit(self.least["i"]))
        return (F.col(n) < by_side) | F.col("node.key").isNull()

    def frontier(self) -> DataFrame:
        """The nodes of the next round: (side, node)."""
        if self.dropped is None:
            return self.scratch.stored(self.degrees.where(self.few()).select("side", "node"), "frontier")
        touched = self.last.select("side", "node").distinct()
        taken = self.taken.join(touched, ["side", "node"], "left_semi").groupBy("side", "node").agg(F.sum("n").alias("taken"))
        now = self.degrees.join(taken, ["side", "node"]).withColumn("left", F.col("n") - F.col("taken"))
        return self.scratch.stored(now.where(self.few("left")).select("side", "node"), "frontier")

    def drop(self, frontier: DataFrame) -> None:
        """Takes the edges of these nodes from their neighbours that are still there."""
        self.rounds += 1
        self.dropped = frontier if self.dropped is None else self.dropped.unionByName(frontier)
        parts = []
        for side, other in (SIDES, SIDES[::-1]):
            gone = frontier.where(F.col("side") == side).select(F.col("node").alias(side))
            lost = self.edges.join(gone, self.edges[side].eqNullSafe(gone[side]), "left_semi")
            parts.append(lost.select(F.lit(other).alias("side"), F.col(other).alias("node"), "n"))
        gone = self.dropped.select(F.col("side").alias("_side"), F.col("node").alias("_node"))
        # a node without a key is among the dropped ones after the first round
        lost = parts[0].unionByName(parts[1]).where(F.col("node.key").isNotNull())
        left = lost.join(gone, (F.col("side") == F.col("_side")) & (F.col("node") == F.col("_node")), "left_anti")
        self.last = self.scratch.stored(left.groupBy("side", "node").agg(F.sum("n").alias("n")), "taken")
        self.taken = self.last if self.taken is None else self.taken.unionByName(self.last)

    def run(self, most: int) -> bool:
        """Whether nothing was left to drop within ``most`` rounds."""
        for _ in range(most):
            frontier = self.frontier()
            if frontier.isEmpty():
                return True
            self.drop(frontier)
        return False

    def kept(self, rows: DataFrame, keys: dict[str, F.Column]) -> DataFrame:
        """Rows whose nodes are still there."""
        if self.dropped is None:
            return rows
        for side in SIDES:
            gone = self.dropped.where((F.col("side") == side) & F.col("node.key").isNotNull()).select(F.col("node").alias("_gone"))
            rows = rows.where(keys[side]["key"].isNotNull()).join(gone, keys[side] == F.col("_gone"), "left_anti")
        return rows


def _nodes(user: str, item: str, within: Sequence[str]) -> dict[str, F.Column]:
    parts = [F.col(c) for c in within]
    return {s: F.struct(F.col(c).alias("key"), *parts) for s, c in zip(SIDES, (user, item), strict=True)}


def k_core(df: DataFrame, k_user: int, k_item: int, most: int = 20, user: str = "user_id", item: str = "parent_asin", within: Sequence[str] = ()) -> DataFrame:
    """Event counts: both counts from one snapshot, both filters at once, until nothing drops; warns at the limit.

    ``within``: columns that part the events into cores of their own, all found in one run.
    """
    scratch, nodes = Scratch(df.sparkSession, "kcore"), _nodes(user, item, within)
    edges = df.select(*[c.alias(s) for s, c in nodes.items()]).groupBy("u", "i").agg(F.count("*").alias("n"))
    peeling = Peeling(scratch, edges, {"u": k_user, "i": k_item})
    if not peeling.run(most):
        warnings.warn(f"k-core not converged after {most} rounds", stacklevel=2)
    return scratch.result(peeling.kept(df, nodes))


def k_core_pairs(df: DataFrame, k_user: int, k_item: int, most: int = 20, user: str = "user_id", item: str = "parent_asin") -> DataFrame:
    """Distinct pairs: until the numbers of users and items stay; not converged at the limit is an error."""
    scratch, nodes = Scratch(df.sparkSession, "kcore"), _nodes(user, item, ())
    edges = df.select(*[c.alias(s) for s, c in nodes.items()]).distinct().withColumn("n", F.lit(1).cast("long"))
    peeling = Peeling(scratch, edges, {"u": k_user, "i": k_item})
    if not peeling.run(most):
        scratch.drop()
        raise RuntimeError(f"k-core not converged after {most} rounds")
    left = peeling.kept(peeling.edges, {s: F.col(s) for s in SIDES})
    return scratch.result(left.select(F.col("u.key").alias(user), F.col("i.key").alias(item)))


def prepare_train_core(train: DataFrame, k_user: int, k_item: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(core, user ids, item ids): the k-core of the training events and ids by sorted key."""
    core = k_core(train, k_user, k_item)
    return core, build_sorted_ids(core, "user_id"), build_sorted_ids(core, "parent_asin")


def cold_start_report(df: DataFrame, k_user: int, k_item: int, domains: list[str]) -> DataFrame:
    """Users in the k-core of each domain alone, in any of them, and in the k-core of all domains together."""
    alone = k_core(df.where(F.col("domain").isin(domains)), k_user, k_item, within=["domain"])
    single = alone.select("user_id").distinct().agg(F.count("*").alias("users_single_domain"))
    joint = k_core(df, k_user, k_item).agg(F.count_distinct("user_id").alias("users_combined"))
    return single.crossJoin(joint)  # one row each
