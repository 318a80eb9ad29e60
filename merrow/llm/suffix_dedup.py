"""Repeated strings by a sparse suffix array over content-chosen places.

Every string of ``span`` bytes chooses one place inside it, an anchor, by the least hash of its grams (leftmost on
ties), so equal strings choose alike and a sparse set of suffixes, those at anchors, sees every repetition:

1. Anchors whose gram occurs once are dropped (counts by hash). The others keep the range of strings that chose them.
2. The bytes that those strings cover around an anchor, its segment, are compared by BLAKE2b of 128 bits: anchors with
   the same segment are repeated as a whole. One anchor of each segment goes on, whatever the number of its copies.
3. Sampled splitters deal these suffixes by their leading bytes into ranges; equal grams never straddle a boundary.
   A bucket sorts the suffixes by multikey quicksort, and the bytes before the anchors likewise, and compares
   neighbours. A string that starts d bytes before its anchor is repeated if another anchor shares its d bytes before
   and its span - d bytes from the anchor on, that is, if both lie in one run of either sorted order.
4. A gram with more than ``hot`` different segments would be too much for one bucket: its strings are counted by a
   BLAKE2b digest of their own, which spreads them evenly and gives the same.

Ranges found are gathered by document and the bytes cut out. Defined cases: a null or empty text, or one under
``span`` bytes, loses nothing; very long texts are read in windows of ``WINDOW`` bytes, so beyond a few copies of the text
memory is bounded; rows that share identifier and text count as repetitions of each other; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, Tables, documents, join_dealt, plain_text

GRAM, SPAN, HOT = 64, 200, 20_000
WINDOW, PLACE_BITS = 1 << 20, 31


def winnowed(data: np.ndarray, rolling: Rolling, gram: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a byte array: place, gram hash, farthest and nearest string start before it."""
    parts = []
    for start in range(0, len(data) - span + 1, WINDOW):  # the strings that start in a window
        place, *rest = winnowed_window(data[start : start + WINDOW + span - 1], rolling, gram, span)
        parts.append((place + start, *rest))
    place, h, far, near = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.concatenate([[True], place[1:] != place[:-1]])  # an anchor of strings on both sides of a window's end
    last = np.concatenate([first[1:], [True]])
    return place[first], h[first], far[first], near[last]


def winnowed_window(data: np.ndarray, rolling: Rolling, gram: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    reach = span - gram + 1
    sums = rolling.sums(data)
    start = np.arange(len(data) - gram + 1)
    h = rolling.ranges(sums, start, start + gram)
    key = h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | start.astype(np.uint64)
    pad = -len(key) % reach
    grid = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, reach)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(key) - reach + 1], ahead[reach - 1 : len(key)])
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    place = place[first]
    return place, h[place], place - first, place - last


def table(schema: pa.Schema, parts: list[tuple]) -> pa.RecordBatch:
    columns = zip(*parts, strict=True) if parts else [[np.zeros(0, np.int64)]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(c))) for c in columns], schema=schema)


LONGS = lambda *names: pa.schema([(n, pa.int64()) for n in names])
DDL = lambda *names: ", ".join(f"{n} long" for n in names)


def anchors_of(rows: DataFrame, gram: int, span: int) -> DataFrame:
    """(h, id, version, at): an anchor's gram hash and place; at packs place, farthest and nearest start."""
    names = "h", "id", "version", "at"

    def find(batches):
        rolling = Rolling()
        for batch in batches:
            parts = []
            for i, v, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.frombuffer(text.as_py().encode("utf-8"), np.uint8)
                if len(data) >= span:
                    place, h, far, near = winnowed(data, rolling, gram, span)
                    parts.append((h.view(np.int64), np.full(len(h), i), np.full(len(h), v), place << 16 | far << 8 | near))
            yield table(LONGS(*names), parts)

    return rows.select("id", "version", "text").mapInArrow(find, DDL(*names))


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 16, at >> 8 & 255, at & 255


def digests(strings: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b of 128 bits of each string, as two columns of integers."""
    both = np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in strings), np.int64)
    return both[::2], both[1::2]


def segments_of(candidates: DataFrame, span: int) -> DataFrame:
    """(h, id, version, at, s1, s2): the digest of the bytes that an anchor's strings cover."""
    names = "h", "id", "version", "at", "s1", "s2"

    def cut(batches):
        for batch in batches:
            parts = []
            for i, v, text, live in zip(*(batch.column(c) for c in range(4)), strict=True):
                data = text.as_py().encode("utf-8")
                flat = live.values.flatten()
                h, at = (x.to_numpy(zero_copy_only=False) for x in flat)
                place, far, near = unpacked(at)
                s1, s2 = digests(data[p - f : p - n + span] + bytes((f, n)) for p, f, n in zip(place.tolist(), far.tolist(), near.tolist(), strict=True))
                parts.append((h, np.full(len(h), i.as_py()), np.full(len(h), v.as_py()), at, s1, s2))
            yield table(LONGS(*names), parts)

    return candidates.select("id", "version", "text", "live").mapInArrow(cut, DDL(*names))


def multikey_order(words: np.ndarray, sizes: np.ndarray, few: int = 64) -> np.ndarray:
    """Multikey quicksort of byte strings held as rows of big-endian 8-byte words: order by words, then by size.

    A part of the rows is split three ways by a pivot of the word it has come to; the equal ones go on to the next
    word. Parts of ``few`` rows or less are sorted at once by the words that are left.
    """
    keys = np.column_stack([words, sizes.astype(np.uint64)])
    out, stack = [np.zeros(0, np.int64)], [(np.arange(len(keys)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 2 or depth == keys.shape[1]:
            out.append(rows)
        elif len(rows) <= few:
            out.append(rows[np.lexsort(keys[rows, depth:].T[::-1])])
        else:
            key = keys[rows, depth]
            pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
            stack += [(rows[key > pivot], depth), (rows[key == pivot], depth + 1), (rows[key < pivot], depth)]
    return np.concatenate(out)


def run_lengths(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order and, for each place in it, the prefix shared with the one before (-1 at the first)."""
    sizes = np.array([len(s) for s in strings])
    grid = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    order = multikey_order(grid.view(">u8").astype(np.uint64), sizes)
    shared = np.full(len(strings), -1)
    if len(strings) > 1:
        differ = grid[order[1:]] != grid[order[:-1]]
        first = np.where(differ.any(1), differ.argmax(1), width)
        shared[1:] = np.minimum(first, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    return order, shared


def repeated(left: list[bytes], right: list[bytes], far: np.ndarray, near: np.ndarray, span: int, reach: int) -> np.ndarray:
    """For each anchor and distance d: whether its string that starts d bytes before it is also at another anchor."""
    n = len(left)
    order_r, shared_r = run_lengths(right, -(-span // 8) * 8)
    order_l, shared_l = run_lengths([s[::-1] for s in left], max(8, -(-reach // 8) * 8))
    out = np.zeros((n, reach), bool)
    run_r, run_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(reach):
        mine = np.flatnonzero((near <= d) & (d <= far))
        if len(mine) < 2:
            continue
        run_r[order_r] = np.cumsum(shared_r < span - d)
        run_l[order_l] = np.cumsum(shared_l < d)
        _, back, count = np.unique(run_r[mine] * n + run_l[mine], return_inverse=True, return_counts=True)
        out[mine, d] = count[back] > 1
    return out


RANGES = "id", "version", "start", "stop"


def sorted_buckets(contexts: DataFrame, span: int, reach: int, batch_anchors: int = 20_000) -> DataFrame:
    """contexts (lead, id, version, at, left, right), dealt by range of lead and sorted -> repeated ranges."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        at = np.array([r[3] for r in rows], np.int64)
        place, far, near = unpacked(at)
        flags = repeated([r[4] for r in rows], [r[5] for r in rows], far, near, span, reach)
        edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        ids, versions = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        return table(LONGS(*RANGES), [(ids[i], versions[i], place[i] - (high - 1), place[i] - low + span)])

    def find(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if len(held) >= batch_anchors and row[0] != held[-1][0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return contexts.select("lead", "id", "version", "at", "left", "right").mapInArrow(find, DDL(*RANGES))


def contexts_of(rows: DataFrame, gram: int, span: int) -> DataFrame:
    """(id, version, text, places [at]) -> (lead, id, version, at, left, right)."""
    schema = pa.schema([("lead", pa.binary()), ("id", pa.int64()), ("version", pa.int64()), ("at", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])

    def cut(batches):
        for batch in batches:
            out = []
            for i, v, text, places in zip(*(batch.column(c) for c in range(4)), strict=True):
                data = text.as_py().encode("utf-8")
                for at in places.as_py():
                    place, far, near = at >> 16, at >> 8 & 255, at & 255
                    out.append((data[place : place + gram], i.as_py(), v.as_py(), at, data[place - far : place], data[place : place - near + span]))
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in out] for k, n in enumerate(schema.names)}, schema=schema)

    return rows.select("id", "version", "text", "places").mapInArrow(cut, "lead binary, id long, version long, at long, left binary, right binary")


def strings_of(rows: DataFrame, span: int) -> DataFrame:
    """Every string of the anchors given, by its digest: (w1, w2, id, version, start)."""
    names = "w1", "w2", "id", "version", "start"

    def cut(batches):
        for batch in batches:
            parts = []
            for i, v, text, places in zip(*(batch.column(c) for c in range(4)), strict=True):
                data = text.as_py().encode("utf-8")
                place, far, near = unpacked(np.array(places.as_py(), np.int64))
                start = np.concatenate([np.arange(p - f, p - n + 1) for p, f, n in zip(place, far, near, strict=True)])
                w1, w2 = digests(data[a : a + span] for a in start.tolist())
                parts.append((w1, w2, np.full(len(start), i.as_py()), np.full(len(start), v.as_py()), start))
            yield table(LONGS(*names), parts)

    return rows.select("id", "version", "text", "places").mapInArrow(cut, DDL(*names))


def cut_out(rows: DataFrame, with_text: bool) -> DataFrame:
    """(id, version, text, ranges) -> (id, version, n_removed, n_spans, kept_sha256[, kept])."""
    schema = pa.schema([*LONGS("id", "version", "n_removed", "n_spans"), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_text else [])])

    def cut(batches):
        for batch in batches:
            out = []
            for i, v, text, ranges in zip(*(batch.column(c) for c in range(4)), strict=True):
                data = text.as_py().encode("utf-8")
                kept, done, removed, spans = [], 0, 0, 0
                for a, b in sorted((r["start"], r["stop"]) for r in ranges.as_py()):
                    if a > done or spans == 0:
                        kept.append(data[done:a])
                        spans += 1
                        done = a
                    removed += max(0, b - done)
                    done = max(done, b)
                kept.append(data[done:])
                rest = b"".join(kept)
                out.append((i.as_py(), v.as_py(), removed, spans, hashlib.sha256(rest).hexdigest(), *([rest] if with_text else [])))
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in out] for k, n in enumerate(schema.names)}, schema=schema)

    ddl = "id long, version long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.select("id", "version", "text", "ranges").mapInArrow(cut, ddl)


def remove_repeats(
    docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256; ``with_text`` adds the bytes that stay."""
    reach, key = span - gram + 1, ["id", "version"]
    if not 8 <= gram < span or reach > 255:
        raise ValueError("8 <= gram < span, span - gram < 255")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), plain_text(text_col).alias("text"))
    rows = rows.select("doc", F.coalesce("doc", F.lit(-(2**63) + 1)).alias("id"), F.xxhash64("text").alias("version"), "text")

    tables = Tables(docs.sparkSession, "repeats")
    anchors = tables.stored(anchors_of(rows, gram, span), "anchors")
    shared = tables.stored(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    live = join_dealt(anchors, shared, ["h"], "n", anchors.count(), ["id", "at"]).groupBy(*key).agg(F.collect_set(F.struct("h", "at")).alias("live"))
    candidates = tables.stored(rows.select(*key, "text").join(live, key), "candidates")

    segments = tables.stored(segments_of(candidates, span), "segments")
    ranked = segments.groupBy("h", "s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct("id", "version", "at")).alias("one"))
    ranked, n_segments = tables.stored(ranked, "ranked"), segments.count()
    whole = join_dealt(segments, ranked.where("n > 1").select("h", "s1", "s2", "n"), ["h", "s1", "s2"], "n", n_segments, ["id", "at"])
    place, far, near = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(255)), F.col("at").bitwiseAND(F.lit(255))
    whole = whole.select(*key, (place - far).alias("start"), (place - near + span).alias("stop"))

    sizes = tables.stored(ranked.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    pool = tables.stored(join_dealt(ranked.select("h", "one.*"), sizes, ["h"], "size", n_segments, ["id", "at"]), "pool")
    texts = candidates.select(*key, "text").dropDuplicates(key)
    normal = pool.where(F.col("size") <= hot).groupBy(*key).agg(F.collect_list("at").alias("places"))
    contexts = contexts_of(texts.join(normal, key), gram, span)
    bucketed = sorted_buckets(contexts.repartitionByRange("lead").sortWithinPartitions("lead"), span, reach)

    crowded = pool.where(F.col("size") > hot).groupBy(*key).agg(F.collect_list("at").alias("places"))
    strings = strings_of(texts.join(crowded, key), span)
    often = tables.stored(strings.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1"), "often")
    counted = join_dealt(strings, often, ["w1", "w2"], "n", n_segments, ["id", "start"]).select(*key, "start", (F.col("start") + span).alias("stop"))

    found = whole.unionByName(bucketed).unionByName(counted)
    ranges = found.groupBy(*key).agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    cut = tables.result(cut_out(texts.join(ranges, key), with_text))
    facts = rows.select("doc", *key, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own_sha256"), *([F.col("text").cast("binary").alias("own")] if with_text else []))
    return facts.join(cut, key, "left").select(
        F.col("doc").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "own_sha256").alias("kept_sha256"),
        *([F.coalesce("kept", "own").alias("kept")] if with_text else []),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
