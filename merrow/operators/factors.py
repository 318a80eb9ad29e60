"""Matrix factors by Bayesian personalised ranking, in full batches; factor scores; model selection."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merrow.functions.draws import draw
from merrow.functions.storage import stored

from .ids import build_sorted_ids


def sample_triples(pairs: DataFrame, epoch: int, seed: int = 0, tries: int = 8) -> DataFrame:
    """(user_id, item, negative): for each positive pair the first of ``tries`` hash draws that the user has not seen.

    Draws are made one at a time, the next one only for pairs whose last one is seen, and compared by index. Pairs none
    of whose draws is free take the first unseen item in index order, by way of the positions that the user's history
    can cover; users who have seen everything are skipped.
    """
    items = stored(build_sorted_ids(pairs, "item"), "indices")
    n = items.count()
    held = stored(pairs.select("user_id", "item").distinct().join(items, "item"), "held")
    left, found = held.select("user_id", "item"), []
    seen = held.select("user_id", "idx")
    for t in range(tries):  # almost all pairs are done after the first draw
        drawn = left.withColumn("idx", draw(F.col("user_id"), F.col("item"), F.lit(t), F.lit(epoch), F.lit(seed)) % n)
        found.append(stored(drawn.join(seen, ["user_id", "idx"], "left_anti"), "free"))
        left = stored(drawn.join(seen, ["user_id", "idx"], "left_semi").select("user_id", "item"), "left")
        if left.isEmpty():
            break
    free = functools.reduce(DataFrame.unionByName, found) if found else held.where("false")
    named = free.join(items.select("idx", F.col("item").alias("negative")), "idx").select("user_id", "item", "negative")
    sizes = held.join(left.select("user_id").distinct(), "user_id", "left_semi")
    places = sizes.groupBy("user_id").agg(F.count("*").alias("h")).select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h"))).alias("idx"))
    lowest = places.join(seen, ["user_id", "idx"], "left_anti").groupBy("user_id").agg(F.min("idx").alias("idx")).join(items.select("idx", F.col("item").alias("negative")), "idx")
    return named.unionByName(left.join(lowest, "user_id").select("user_id", "item", "negative"))


def start(ids: DataFrame, key: str, dim: int, seed: int, scale: float = 0.1) -> DataFrame:
    """Factors from a hash of the key: roughly normal (a sum of four uniforms)."""
    uniform = lambda i, j: F.pmod(F.xxhash64(F.col(key), i, F.lit(j), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) - 0.5
    vec = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: scale * sum((uniform(i, j) for j in range(1, 4)), uniform(i, 0)))
    return ids.select(key, vec.alias("f"), F.lit(0.0).alias("bias"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def bpr_fit(pairs: DataFrame, dim: int = 8, rate: float = 0.05, reg: float = 0.01, epochs: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame, list[float]]:
    """(user factors, item factors, loss by epoch). An epoch is one batch: triples meet factors, gradients are summed by id.

    The batch sums as an accumulated update would; the rate is divided by the mean number of rows of an id. Every epoch
    writes the two factor tables, so no lineage grows.
    """
    users = stored(start(pairs.select("user_id").distinct(), "user_id", dim, seed), "bpr")
    items = stored(start(pairs.select("item").distinct(), "item", dim, seed + 1), "bpr")
    losses = []
    for epoch in range(epochs):
        triples = sample_triples(pairs, epoch, seed)
        rows = triples.join(users.select("user_id", F.col("f").alias("u")), "user_id")
        rows = rows.join(items.select("item", F.col("f").alias("p"), F.col("bias").alias("bp")), "item")
        rows = rows.join(items.select(F.col("item").alias("negative"), F.col("f").alias("q"), F.col("bias").alias("bq")), "negative")
        x = dot(F.col("u"), F.col("p")) - dot(F.col("u"), F.col("q")) + F.col("bp") - F.col("bq")
        rows = stored(rows.withColumn("x", x).withColumn("g", 1 / (1 + F.exp("x"))), "bpr")
        losses.append(rows.agg(F.avg(F.log(1 + F.exp(-F.col("x")))).alias("l")).first().l)
        scaled = lambda v, sign=1.0: F.transform(v, lambda y: sign * F.col("g") * y)
        diff = F.zip_with("p", "q", lambda a, b: a - b)
        for_user = rows.select("user_id", scaled(diff).alias("d"), F.lit(0.0).alias("db"))
        for_item = rows.select("item", scaled(F.col("u")).alias("d"), F.col("g").alias("db")).unionByName(rows.select(F.col("negative").alias("item"), scaled(F.col("u"), -1.0).alias("d"), (-F.col("g")).alias("db")))
        users = stored(step(users, for_user, "user_id", dim, rate, reg), "bpr")
        items = stored(step(items, for_item, "item", dim, rate, reg), "bpr")
    return users, items, losses


def step(factors: DataFrame, gradients: DataFrame, key: str, dim: int, rate: float, reg: float) -> DataFrame:
    sums = gradients.groupBy(key).agg(F.array(*[F.sum(F.col("d")[i]) for i in range(dim)]).alias("d"), F.sum("db").alias("db"))
    moved = F.when(F.col("d").isNull(), F.col("f")).otherwise(F.zip_with("f", "d", lambda f, d: f + rate * (d - reg * f)))
    return factors.join(sums, key, "left").select(key, moved.alias("f"), (F.col("bias") + F.coalesce(rate * (F.col("db") - reg * F.col("bias")), F.lit(0.0))).alias("bias"))


def factor_topk(users: DataFrame, items: DataFrame, seen: DataFrame, k: int, block: int = 65_536) -> DataFrame:
    """The k best unseen items by P * Q' + b. Item blocks meet users; each block keeps k plus the user's seen items.

    A user is sent to each block of items, not to each item: inside a block one matrix product scores a batch of users.
    """
    import math

    import numpy as np
    import pyarrow as pa
    from pyspark.sql import Window

    n_blocks = max(1, math.ceil(items.count() / block))
    n_users = max(1, math.ceil(users.count() / 4096))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    history = seen.groupBy("user_id").agg(F.collect_set(F.col("item").cast("long")).alias("seen"))
    none = F.array().cast("array<bigint>")
    asked = users.select("user_id", "f").join(history, "user_id", "left")
    left = asked.select("user_id", F.lit(None).cast("long").alias("item"), "f", F.lit(0.0).alias("bias"), F.coalesce("seen", none).alias("seen"), every(n_blocks).alias("ib"), F.pmod(F.xxhash64("user_id"), F.lit(n_users)).alias("ub"))
    right = items.select(F.lit(None).cast("string").alias("user_id"), F.col("item").cast("long").alias("item"), "f", "bias", none.alias("seen"), F.pmod(F.xxhash64("item"), F.lit(n_blocks)).alias("ib"), every(n_users).alias("ub"))
    schema = pa.schema([("user_id", pa.string()), ("item", pa.int64()), ("score", pa.float64())])

    def matrix(part: pa.Table) -> np.ndarray:
        return np.array(part["f"].combine_chunks().flatten()).reshape(part.num_rows, -1)

    def search(table: pa.Table) -> pa.Table:
        mine, asks = table.filter(table["item"].is_valid()), table.filter(table["item"].is_null())
        out = {"user_id": [], "item": [], "score": []}
        if mine.num_rows and asks.num_rows:
            ids, factors, bias = mine["item"].to_numpy(), matrix(mine), mine["bias"].to_numpy()
            users, wanted = asks["user_id"].to_pylist(), matrix(asks)
            for start in range(0, len(users), 256):
                rough = wanted[start : start + 256] @ factors.T + bias  # one product for a batch of users
                for u, scores in enumerate(rough, start):
                    free = np.flatnonzero(~np.isin(ids, np.array(asks["seen"][u].values)))
                    if len(free) > k:  # all that may be among the k best once scores are exact
                        free = free[scores[free] >= np.partition(scores[free], -k)[-k] - 1e-6]
                    exact = np.round((factors[free] * wanted[u]).sum(1) + bias[free], 9)
                    best = np.lexsort((ids[free], -exact))[:k]
                    out["user_id"] += [users[u]] * len(best)
                    out["item"] += ids[free[best]].tolist()
                    out["score"] += exact[best].tolist()
        return pa.Table.from_pydict(out, schema=schema)

    local = left.unionByName(right).groupBy("ib", "ub").applyInArrow(search, "user_id string, item long, score double")
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "item")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def grid(options: Mapping[str, Sequence]) -> list[dict]:
    """All combinations, in the order of the keys."""
    return [dict(zip(options, values, strict=True)) for values in itertools.product(*options.values())]


def tune(fit: Callable[[dict], DataFrame], settings: Sequence[dict], evaluate: Callable[[DataFrame], float]) -> tuple[dict, list[tuple[dict, float]]]:
    """The setting with the best validation metric (the first of equals), and all of them. Settings are few; data stays distributed."""
    scored = [(s, evaluate(fit(s))) for s in settings]
    return max(scored, key=lambda x: x[1])[0], scored
