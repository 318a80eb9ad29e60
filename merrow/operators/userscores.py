"""What is asked about users' scores, answered where a slice of users meets the neighbour lists of its items.

A user has many times more scores than it has items, so scores are not shuffled and, unless they are the result, not
written. Users with histories around the same items come into one slice; a neighbour list goes once, packed with others, to
each slice that has its item. There the scores are summed some thousand users at a time, and a ``work`` makes of them what
is wanted: the scores, the best unseen ones, those of given items, counts of ties or of what becomes of candidates.

Items are whole numbers; a user's items are distinct. Scores are exact sums at six digits, as ``cf.exact_sum`` has them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from merrow.functions.storage import stored

from .nearest import AT_ONCE, best_of, cut, numbered, pack, spread, unpack, weights

SLICE = 250_000
PACKED = "slice long, lists long, entries long, items binary, sizes binary, neighbors binary, sims binary, shown binary"


@dataclass
class Part:
    """Some users' scores: rows by user, then item. ``asked`` are rows too, of the items that were asked for."""

    ids: pa.Array  # of all users of the slice
    users: np.ndarray  # those of this part
    user: np.ndarray
    item: np.ndarray
    value: np.ndarray  # score in units of the sixth digit
    seen: np.ndarray
    shown: np.ndarray
    asked_user: np.ndarray
    asked_item: np.ndarray
    asked_shown: np.ndarray
    asked_seen: np.ndarray
    asked_at: np.ndarray  # row of the score, or -1

    def named(self, user: np.ndarray) -> pa.Array:
        return self.ids.take(pa.array(user))

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Users with scores, and the best score of each, seen items included."""
        first = np.flatnonzero(np.diff(self.user, prepend=-1))
        return self.user[first], np.maximum.reduceat(self.value, first) if len(first) else first

    def ranks(self, k: int) -> np.ndarray:
        """1 to k for the best unseen rows of each user, else 0."""
        unseen, out = np.flatnonzero(~self.seen), np.zeros(len(self.user), np.int64)
        at, rank = best_of(self.user[unseen], self.value[unseen], k)
        out[unseen[at]] = rank
        return out

    def ties(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Users of ``rows``, their pairs of equal scores, and whether the score at rank k goes on beyond it."""
        user, value = self.user[rows], self.value[rows]
        order = np.lexsort((-value, user))
        user, value = user[order], value[order]
        run = np.flatnonzero((np.diff(user, prepend=-1) != 0) | (np.diff(value, prepend=-1) != 0))
        n, owner = np.diff(np.append(run, len(user))), user[run]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        if not len(first):
            return first, first, first
        upto = np.cumsum(n)
        upto -= np.repeat((upto - n)[first], np.diff(np.append(first, len(owner))))
        crosses = (upto > k) & (upto - n < k)
        return owner[first], np.add.reduceat(n * (n - 1) // 2, first), np.maximum.reduceat(crosses.astype(np.int64), first)


def every(part: Part) -> dict:
    """user_id, item, score."""
    return {"user_id": part.named(part.user), "item": part.item, "score": part.value / 1e6}


def top(k: int) -> Callable[[Part], dict]:
    """user_id, item, score, rank of the best unseen items; and a row a user with its best score of all, without item."""

    def work(part: Part) -> dict:
        rank = part.ranks(k)
        rows, (users, best) = np.flatnonzero(rank), part.best()
        none = np.ones(len(users), bool)
        pad = lambda x: pa.array(np.concatenate([x, np.zeros(len(users), np.int64)]), mask=np.concatenate([np.zeros(len(x), bool), none]))
        value = np.concatenate([part.value[rows], best])
        return {"user_id": part.named(np.concatenate([part.user[rows], users])), "item": pad(part.item[rows]), "score": value / 1e6, "rank": pad(rank[rows])}

    return work


def looked_up(k: int) -> Callable[[Part], dict]:
    """user_id, item, score, best, seen, rank of the asked items that have a score; rank is null beyond k and for seen ones."""

    def work(part: Part) -> dict:
        rank, (users, best) = part.ranks(k), part.best()
        rows = part.asked_at[part.asked_at >= 0]
        most = best[np.searchsorted(users, part.user[rows])] if len(rows) else rows
        return {
            "user_id": part.named(part.user[rows]), "item": part.item[rows], "score": part.value[rows] / 1e6, "best": most / 1e6,
            "seen": part.seen[rows], "rank": pa.array(rank[rows], mask=rank[rows] == 0),
        }

    return work


def tied(k: int) -> Callable[[Part], dict]:
    """user_id, tie_pairs, boundary_tie over the unseen scores of each user that has any."""

    def work(part: Part) -> dict:
        users, pairs, boundary = part.ties(np.flatnonzero(~part.seen), k)
        return {"user_id": part.named(users), "tie_pairs": pairs, "boundary_tie": boundary > 0}

    return work


def outcomes(k: int) -> Callable[[Part], dict]:
    """By user: what becomes of the candidates, which are all scored items and the asked ones; see ``cf.rank_candidates``."""

    def work(part: Part) -> dict:
        count = lambda user, mask: np.bincount(np.searchsorted(part.users, user[mask]), minlength=len(part.users))
        other = part.asked_at < 0
        rest = lambda mask: count(part.asked_user, other & mask)
        kept = part.shown & ~part.seen
        n = count(part.user, kept)
        pairs, boundary = np.zeros(len(part.users), np.int64), np.zeros(len(part.users), np.int64)
        users, p, b = part.ties(np.flatnonzero(kept), k)
        pairs[np.searchsorted(part.users, users)], boundary[np.searchsorted(part.users, users)] = p, b
        return {
            "user_id": part.named(part.users), "candidates": count(part.user, np.ones(len(part.user), bool)) + rest(np.ones(len(other), bool)),
            "seen": count(part.user, part.shown & part.seen) + rest(part.asked_shown & part.asked_seen),
            "unscored": rest(part.asked_shown & ~part.asked_seen), "hidden": count(part.user, ~part.shown) + rest(~part.asked_shown),
            "returned": np.minimum(n, k), "kept": n, "tie_pairs": pairs, "boundary": boundary,
        }

    return work


def per_user(
    history: DataFrame, sim: DataFrame, work: Callable[[Part], dict], schema: str, asked: DataFrame | Callable[[Column], Column] | None = None,
    shown: Callable[[Column], Column] | None = None, slice_of: int = SLICE, at_once: int = AT_ONCE,
) -> DataFrame:
    """history (user_id, item), sim (item, neighbor, sim) -> what ``work`` makes of all users' scores: user_id and ``schema``.

    ``asked``: (user_id, item), distinct, or an expression of a user's items that gives distinct ones. ``shown``: an
    expression of an item, true if not given. ``slice_of``: items of histories in a slice, about.
    """
    visible = shown or (lambda x: F.lit(True))
    users = history.where("user_id IS NOT NULL AND item IS NOT NULL").repartition("user_id").groupBy("user_id").agg(F.sort_array(F.collect_list(F.col("item").cast("long"))).alias("items"))
    if isinstance(asked, DataFrame):
        lists = asked.groupBy("user_id").agg(F.collect_list(F.col("item").cast("long")).alias("asked"))
        users = users.join(lists, "user_id", "left").withColumn("asked", F.coalesce("asked", F.array().cast("array<bigint>")))
    else:
        users = users.withColumn("asked", asked(F.col("items")).cast("array<bigint>") if asked else F.array().cast("array<bigint>"))
    users = stored(users.withColumn("place", F.col("items")[F.floor(F.size("items") / 2).cast("int")]), "users")
    found, total = weights(stored(users.groupBy(F.col("place").alias("item")).agg(F.sum(F.size("items")).alias("n")), "places"))
    edges = cut(found, max(history.sparkSession.sparkContext.defaultParallelism, -(-total // slice_of)))
    load = np.bincount(np.searchsorted(edges, [x for x, _ in found], "right"), [n for _, n in found], len(edges) + 1)
    parts = np.maximum(1, -(-load // (2 * slice_of))).astype(np.int64)  # users around the same few items are dealt by hash
    before = np.cumsum(parts) - parts

    @F.pandas_udf("long")
    def placed(place: pd.Series, spot: pd.Series) -> pd.Series:
        r = np.searchsorted(edges, place.to_numpy(), "right")
        return pd.Series(before[r] + spot.to_numpy() % parts[r])

    users = users.withColumn("slice", placed("place", F.pmod(F.xxhash64("user_id"), F.lit(1 << 40))))
    where = users.select("slice", F.explode("items").alias("item")).repartition("item").groupBy("item").agg(F.collect_set("slice").alias("slices"))
    entry = F.struct(F.col("neighbor").cast("long").alias("neighbor"), F.round(F.col("sim") * 1e9).cast("long").alias("sim"), visible(F.col("neighbor")).cast("long").alias("shown"))
    rows = sim.select(F.col("item").cast("long").alias("item"), entry.alias("x")).repartition("item").groupBy("item").agg(F.collect_list("x").alias("held"))

    def deal(batches):
        for batch in batches:
            items, held, slices = (batch.column(c) for c in ("item", "held", "slices"))
            items, sizes = items.to_numpy(), np.diff(held.offsets.to_numpy()).astype(np.int64)
            neighbors, sims, visibles = (held.flatten().field(c).to_numpy() for c in ("neighbor", "sim", "shown"))
            starts = np.cumsum(sizes) - sizes
            place = slices.flatten().to_numpy()
            owner = np.repeat(np.arange(len(items)), np.diff(slices.offsets.to_numpy()))
            order = np.argsort(place, kind="stable")
            place, owner = place[order], owner[order]
            for first, last in zip(b := np.flatnonzero(np.diff(place, prepend=-1)), [*b[1:], len(place)], strict=True):
                own = owner[first:last]
                at = spread(starts[own], sizes[own])
                values = place[first], len(own), len(at), pack(np.diff(items[own], prepend=0)), pack(sizes[own]), pack(np.diff(neighbors[at], prepend=0)), pack(sims[at]), pack(visibles[at])
                yield pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in PACKED.split(", ")), values, strict=True))])

    lists = rows.join(where, "item").select("item", "held", "slices").mapInArrow(deal, PACKED)
    out = to_arrow_schema(StructType.fromDDL(schema).add("user_id", history.schema["user_id"].dataType))
    out = pa.schema([out.field("user_id"), *[f for f in out if f.name != "user_id"]])

    def answer(mine: pa.Table, others: pa.Table) -> pa.Table:
        made = [pa.Table.from_pydict({f.name: x if isinstance(x := done[f.name], pa.Array | pa.ChunkedArray) else pa.array(x) for f in out}).cast(out) for done in map(work, scored(mine, others, at_once))]
        return pa.concat_tables(made) if made else out.empty_table()

    asks = users.select("slice", "user_id", "items", "asked", F.transform("asked", lambda x: visible(x)).alias("asked_shown"))
    kind = StructType([history.schema["user_id"], *StructType.fromDDL(schema)])
    return asks.groupBy("slice").cogroup(lists.groupBy("slice")).applyInArrow(answer, kind)


def scored(mine: pa.Table, others: pa.Table, at_once: int):
    """The parts of a slice: users (user_id, items, asked, asked_shown) and packed lists."""
    flat = lambda c: mine[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes_of = lambda c: np.diff(mine[c].combine_chunks().offsets.to_numpy()).astype(np.int64)
    if not mine.num_rows:
        return
    held, held_size, asked, asked_size, asked_shown = flat("items"), sizes_of("items"), flat("asked"), sizes_of("asked"), flat("asked_shown").astype(bool)
    blobs = [
        (np.cumsum(unpack(r["items"], r["lists"])), unpack(r["sizes"], r["lists"]), np.cumsum(unpack(r["neighbors"], r["entries"])), unpack(r["sims"], r["entries"]), unpack(r["shown"], r["entries"]))
        for r in others.to_pylist()
    ]
    items, sizes, neighbors, sims, shown = (np.concatenate(x) for x in zip(*blobs, strict=True)) if blobs else [np.zeros(0, np.int64)] * 5
    names, codes = numbered(neighbors)
    visible = np.zeros(len(names), bool)
    visible[codes] = shown > 0
    starts, order = np.cumsum(sizes) - sizes, np.argsort(items)
    at = np.minimum(np.searchsorted(items, held, sorter=order), max(len(items) - 1, 0))
    at = order[at] if len(items) else at
    many = np.where(items[at] == held, sizes[at], 0) if len(items) else np.zeros(len(held), np.int64)

    def code(wanted: np.ndarray) -> np.ndarray:
        """Numbers of items, -1 for those that are nobody's neighbour here."""
        c = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        return np.where(names[c] == wanted, c, -1)

    held_code, asked_code = code(held), code(asked)
    ends, asked_ends = np.cumsum(held_size), np.cumsum(asked_size)
    upto = np.append(0, np.cumsum(many))[np.append(0, ends)]
    ids, low = mine["user_id"].combine_chunks(), 0
    while low < mine.num_rows:
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + at_once, "right")) - 1)
        own, ask = slice(ends[low] - held_size[low], ends[high - 1]), slice(asked_ends[low] - asked_size[low], asked_ends[high - 1])
        owner, asker = np.repeat(np.arange(high - low), held_size[low:high]), np.repeat(np.arange(high - low), asked_size[low:high])
        met = spread(starts[at[own]], many[own]) if len(items) else np.zeros(0, np.int64)
        key = np.repeat(owner, many[own]) * len(names) + codes[met]
        by = np.argsort(key, kind="stable")
        key = key[by]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        total = np.add.reduceat(sims[met][by], first) if len(first) else first
        key = key[first]
        known = np.sort((owner * len(names) + held_code[own])[held_code[own] >= 0])
        is_in = lambda keys: np.isin(keys, known, assume_unique=True)
        wanted = asker * len(names) + asked_code[ask]
        found = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
        there = (asked_code[ask] >= 0) & (key[found] == wanted if len(key) else np.zeros(len(wanted), bool))
        asked_seen = members(owner, held[own], asker, asked[ask])
        yield Part(
            ids, np.arange(low, high), key // len(names) + low, names[key % len(names)], (total + 500) // 1000, is_in(key), visible[key % len(names)],
            asker + low, asked[ask], asked_shown[ask], asked_seen, np.where(there, found, -1),
        )
        low = high


def members(rows: np.ndarray, values: np.ndarray, of: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which (of, wanted) are among (rows, values)."""
    names = np.unique(values)
    if not len(names) or not len(wanted):
        return np.zeros(len(wanted), bool)
    c = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return (names[c] == wanted) & np.isin(of * len(names) + c, rows * len(names) + np.searchsorted(names, values))
