"""The most similar items of each item, from histories that are sent to ranges of items.

Items are cut into ranges of about equal numbers of users. A history goes once to each range that it touches, packed with
others, so ranges of neighbouring items share it; there it meets the range's own items some million pairs at a time, and
no more than the k best of an item come out. There are as many ranges as keep what one task holds below a bound; a range
that is beyond it all the same (an item of very many users) is dealt into slices of users, whose counts are then added.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.functions.storage import stored

from .ids import build_sorted_ids

HELD, AT_ONCE, BUCKETS, DIGITS = 2_000_000, 1_000_000, 4096, 9
PACKED = "users long, entries long, sizes binary, items binary, n binary"


def pack(values: np.ndarray) -> bytes:
    """Numbers by planes of equally significant bytes, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * count, "zstd", asbytes=True), np.uint8).reshape(8, count)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def packed(sizes: np.ndarray, items: np.ndarray, n: np.ndarray) -> tuple:
    return len(sizes), len(items), pack(sizes), pack(np.diff(items, prepend=0)), pack(n)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpack(row["sizes"], row["users"]), np.cumsum(unpack(row["items"], row["entries"])), unpack(row["n"], row["entries"])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def rounded(sim: np.ndarray) -> np.ndarray:
    """Similarities in units of the last digit, halves up as in SQL: next to a half the decimal number decides."""
    scaled = sim * 10.0**DIGITS
    out = np.rint(scaled).astype(np.int64)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5):
        out[i] = int(Decimal(repr(float(sim[i]))).scaleb(DIGITS).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def best_of(rows: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k largest values of each row, best first, ties to the earlier one, and their ranks. ``rows`` ascend."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(rows, prepend=rows[0] - 1))
    sizes = np.diff(np.append(first, len(rows)))
    number, bits = np.repeat(np.arange(len(first)), sizes), int(values.max()).bit_length()
    ordered = np.sort(number << bits | values)
    kth = (ordered[np.maximum(first + sizes - k, first)] & ((1 << bits) - 1))[number]
    above, level = values > kth, values == kth
    room = k - np.add.reduceat(above.astype(np.int64), first)
    nth = np.cumsum(level)
    nth -= (nth[first] - level[first])[number]
    at = np.flatnonzero(above | level & (nth <= room[number]))
    at = at[np.lexsort((-values[at], number[at]))]
    chosen = number[at]
    return at, np.arange(len(at)) - np.searchsorted(chosen, chosen, "left") + 1


def numbered(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, numbers): items as small numbers in their order; where they lie close together, by their distance from the first."""
    low, high = (int(items.min()), int(items.max())) if len(items) else (0, 0)
    if high - low < max(len(items), 1 << 22):
        return np.arange(low, high + 1), items - low
    return np.unique(items, return_inverse=True)


def met_counts(sizes: np.ndarray, items: np.ndarray, n: np.ndarray, low: int | None, high: int | None):
    """Parts (item, neighbor, co, n_i, n_j) for the items from ``low`` to below ``high``, in order; an item is in one part."""
    names, codes = numbered(items)
    users_of = np.zeros(len(names), np.int64)
    users_of[codes] = n
    there = np.ones(len(items), bool) if low is None else items >= low
    own = np.flatnonzero(there if high is None else there & (items < high))
    own = own[np.argsort(codes[own], kind="stable")]
    starts = np.cumsum(sizes) - sizes
    owner = np.searchsorted(starts, own, "right") - 1
    cost = np.cumsum(sizes[owner])
    borders = np.append(np.flatnonzero(np.diff(codes[own], prepend=-1)), len(own))
    upto = np.append(0, cost)[borders]  # pairs before each item
    i = 0
    while i < len(borders) - 1:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + AT_ONCE, "right")) - 1)
        part = slice(borders[i], borders[j])
        i = j
        many = sizes[owner[part]]
        key = np.repeat(codes[own[part]], many) * len(names) + codes[spread(starts[owner[part]], many)]
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        co, key = np.diff(np.append(first, len(key))), key[first]
        a, b = key // len(names), key % len(names)
        other = a != b
        a, b, co = a[other], b[other], co[other]
        yield names[a], names[b], co, users_of[a], users_of[b]


def weights(counts: DataFrame) -> tuple[list[tuple[int, int]], int]:
    """counts (item, n), distinct -> the first item and the sum of n of at most ``BUCKETS`` runs of items, and the whole sum."""
    size = counts.agg(F.count("*").alias("items"), F.sum("n").alias("n")).first()
    width = -(-max(1, size["items"]) // BUCKETS)
    placed = counts.join(build_sorted_ids(counts, "item"), "item").groupBy(F.floor(F.col("idx") / width).alias("b"))
    return [(r.low, r.n) for r in placed.agg(F.min("item").alias("low"), F.sum("n").alias("n")).orderBy("b").collect()], size["n"] or 0


def cut(weights: list[tuple[int, int]], ranges: int) -> np.ndarray:
    """The first item of each range but the first: ranges of equal weight out of (first item, weight) in order."""
    ends = np.cumsum([w for _, w in weights])
    at = ((ends - [w for _, w in weights]) * ranges // max(1, ends[-1] if len(ends) else 1)).astype(int)
    return np.array([weights[i][0] for i in range(1, len(weights)) if at[i] != at[i - 1]], np.int64)


def touches(sizes: np.ndarray, items: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(history, range), each once; the items of a history ascend."""
    place, owner = np.searchsorted(edges, items, "right"), np.repeat(np.arange(len(sizes)), sizes)
    new = np.ones(len(items), bool)
    new[1:] = (np.diff(owner) > 0) | (np.diff(place) > 0)
    return owner[new], place[new]


def histories(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """All histories, some thousand in a row: sizes, items in order, and the items' numbers of users."""

    def fold(batches):
        for batch in batches:
            held = batch.column("held")
            sizes = np.diff(held.offsets.to_numpy()).astype(np.int64)
            items, n = (held.flatten().field(c).to_numpy() for c in ("item", "n"))
            order = np.lexsort((items, np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_pylist([dict(zip(("users", "entries", "sizes", "items", "n"), packed(sizes, items[order], n[order]), strict=True))])

    rows = pairs.join(counts, "item").select("user_id", F.struct(F.col("item").cast("long").alias("item"), "n").alias("x"))
    lists = rows.repartition("user_id").groupBy("user_id").agg(F.collect_list("x").alias("held"))
    return stored(lists.select("held").mapInArrow(fold, PACKED), "histories")


def loads(folded: DataFrame, choices: list[np.ndarray]) -> list[dict[int, int]]:
    """For each choice of edges: what each range would hold."""

    def measure(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes, items, _ = unpacked(row)
                out = []
                for c, edges in enumerate(choices):
                    owner, place = touches(sizes, items, edges)
                    held = np.bincount(place, sizes[owner], len(edges) + 1)
                    out += [{"choice": c, "range": r, "held": int(h)} for r, h in enumerate(held) if h]
                if out:
                    yield pa.RecordBatch.from_pylist(out)

    sums = folded.mapInArrow(measure, "choice long, range long, held long").groupBy("choice", "range").agg(F.sum("held").alias("held"))
    found: list[dict[int, int]] = [{} for _ in choices]
    for r in sums.collect():  # a row for each range of each choice
        found[r.choice][r["range"]] = r.held
    return found


def nearest(pairs: DataFrame, k: int, held: int = HELD) -> DataFrame:
    """pairs (user_id, item), distinct -> (item, neighbor, sim, rank): the k best by cosine, rounded, ties to the smaller neighbour.

    ``held``: items of histories that one task holds. Items that are not whole numbers are numbered in their order first.
    """
    spark, kind = pairs.sparkSession, pairs.schema["item"].dataType
    pairs = pairs.where(F.col("user_id").isNotNull() & F.col("item").isNotNull())
    if not isinstance(kind, T.IntegralType):
        ids = stored(build_sorted_ids(pairs, "item"), "items")
        found = nearest(pairs.join(ids, "item").select("user_id", F.col("idx").alias("item")), k, held)
        named = lambda c: ids.select(F.col("idx").alias(c), F.col("item").alias(f"_{c}"))
        return found.join(named("item"), "item").join(named("neighbor"), "neighbor").select(F.col("_item").alias("item"), F.col("_neighbor").alias("neighbor"), "sim", "rank")
    counts = stored(pairs.groupBy("item").agg(F.count("*").alias("n")), "counts")
    found, total = weights(counts)
    folded = histories(pairs, counts)
    choices = [cut(found, 2 * spark.sparkContext.defaultParallelism)]
    slices: dict[int, int] = {}
    if total > held:
        while len(choices[-1]) + 1 < BUCKETS and len(choices) < 12 and 2 * (len(choices[-1]) + 1) < len(found):
            choices.append(cut(found, 2 * (len(choices[-1]) + 1)))
        found = loads(folded, choices)
        fit = next((c for c, x in enumerate(found) if max(x.values()) <= held), len(choices) - 1)
        choices, slices = [choices[fit]], {r: -(-x // held) for r, x in found[fit].items() if x > held}
    edges = choices[0]

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes, items, n = unpacked(row)
                starts = np.cumsum(sizes) - sizes
                owner, place = touches(sizes, items, edges)
                for r in np.unique(place).tolist():
                    users = owner[place == r]
                    for s in range(slices.get(r, 1)):
                        some = users[users % slices.get(r, 1) == s]
                        if len(some):
                            at = spread(starts[some], sizes[some])
                            yield pa.RecordBatch.from_pylist([dict(zip(("range", "slice", "users", "entries", "sizes", "items", "n"), (r, s, *packed(sizes[some], items[at], n[at])), strict=True))])

    def best(table: pa.Table) -> pa.Table:
        r = table["range"][0].as_py()
        sizes, items, n = (np.concatenate(x) for x in zip(*map(unpacked, table.to_pylist()), strict=True))
        out = []
        for item, neighbor, co, n_i, n_j in met_counts(sizes, items, n, edges[r - 1] if r else None, edges[r] if r < len(edges) else None):
            if r in slices:
                out.append((item, neighbor, co, n_i, n_j, np.zeros(len(item), np.int64)))
            else:
                at, rank = best_of(item, rounded(co / (np.sqrt(n_i) * np.sqrt(n_j))), k)
                out.append((item[at], neighbor[at], co[at], n_i[at], n_j[at], rank))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "neighbor", "co", "n_i", "n_j", "rank"])

    dealt = folded.mapInArrow(deal, f"range long, slice long, {PACKED}").groupBy("range", "slice")
    rows = dealt.applyInArrow(best, "item long, neighbor long, co long, n_i long, n_j long, rank long")
    if slices:
        rows = stored(rows, "nearest")
    sim = F.round(F.col("co") / (F.sqrt("n_i") * F.sqrt("n_j")), DIGITS).alias("sim")
    whole = (rows.where("rank > 0") if slices else rows).select("item", "neighbor", sim, F.col("rank").cast("int").alias("rank"))
    if slices:
        added = rows.where("rank = 0").groupBy("item", "neighbor").agg(F.sum("co").alias("co"), F.max("n_i").alias("n_i"), F.max("n_j").alias("n_j"))
        order = Window.partitionBy("item").orderBy(F.desc("sim"), "neighbor")
        whole = whole.unionByName(added.select("item", "neighbor", sim).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return whole.select(F.col("item").cast(kind).alias("item"), F.col("neighbor").cast(kind).alias("neighbor"), "sim", "rank")
