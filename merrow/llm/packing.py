"""Best-fit packing of token sequences by exact-complement hashing.

Documents are tokenised once, cut into pieces of at most ``capacity`` tokens (only documents longer than that; the
first piece takes the remainder) and stored with their length, their task and their rank in the task. What the
planner needs is the number of pieces of each length: at most ``capacity`` numbers, whatever the input. It goes
through the lengths from the longest on and fills the gap exactly by one, two or three lengths that are still
available; what has no exact complement is then packed best-fit, again closing exactly as soon as it can. This is done
in several orders (all ways together; single complements of all lengths first, then pairs, then triples; fewer ways), and
the plan with the fewest sequences is taken. The plan is a list of patterns with multiplicities (each one uses some length up, so there are a few thousand at most). A
piece's rank among all pieces of its length, from counts by task, places it in a pattern's slot.

Defined cases: a null or empty text is one piece, the end id alone; texts of any length are tokenised whole, runs of
thousands of equal characters included, with memory in proportion to one text; rows that share an identifier are packed
as separate documents, a null identifier stays; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, plain_text, stored

CAPACITY, END_ID = 1024, 2


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """Token ids of a byte-level vocabulary file; texts out of the common scripts or with long runs take the slower library."""

    UNUSUAL = re.compile("[^\x00-ɏ]")
    # the faster library's matching goes as deep as a run of white space is long, and words take it more than linear time
    SPACES, WORD, RUN = re.compile(r"\s{64,}"), re.compile(r"[^\s]{64,}"), 4096
    _made: dict[str, "ByteTokenizer"] = {}

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.specials}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> "ByteTokenizer":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def ids(self, text: str) -> list[int]:
        slow = any(s in text for s in self.specials) or not text.isascii() and self.UNUSUAL.search(text)
        if slow or len(text) > self.RUN and any(m.end() - m.start() > self.RUN for runs in (self.SPACES, self.WORD) for m in runs.finditer(text)):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())]
)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    schema = PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECES

    def cut(batches):
        tokens, task, seen = ByteTokenizer.of(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = defaultdict(list)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*tokens.ids(text.as_py()), end_id], "<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : start + (capacity if start else first)]
                    values = (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)])
                    seen[len(part)] += 1
                    for name, value in zip(PIECES.names, values, strict=True):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(part.astype(np.int32))
            yield pa.RecordBatch.from_pydict(out if out else {n: [] for n in schema.names}, schema=schema)

    from pyspark.sql.pandas.types import from_arrow_schema

    return docs.mapInArrow(cut, from_arrow_schema(schema))


class Planner:
    """Patterns of lengths that fill a sequence, under the number of pieces of each length."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.patterns: list[tuple[tuple[int, ...], int]] = []

    def single(self, gap: int, left: np.ndarray) -> tuple[int, ...] | None:
        return (gap,) if left[gap] > 0 else None

    def pair(self, gap: int, left: np.ndarray) -> tuple[int, ...] | None:
        large = np.arange(gap - 1, (gap - 1) // 2, -1)
        small = gap - large
        fits = (left[large] > 0) & (left[small] > (large == small))
        return (int(large[i]), int(small[i])) if len(fits) and fits[i := int(fits.argmax())] else None

    def triple(self, gap: int, left: np.ndarray) -> tuple[int, ...] | None:
        for first in range(gap - 2, (gap - 1) // 3, -1):
            if left[first] > 0:
                left[first] -= 1
                rest = self.pair(gap - first, left) if gap - first > 1 else None
                left[first] += 1
                if rest and rest[0] <= first:
                    return (first, *rest)
        return None

    def exact(self, gap: int, left: np.ndarray, ways: tuple[str, ...] = ("single", "pair", "triple")) -> tuple[int, ...] | None:
        if gap == 0:
            return ()
        return next((found for way in ways if (found := getattr(self, way)(gap, left))), None)

    def consume(self, pattern: tuple[int, ...]) -> None:
        need = Counter(pattern)
        times = int(min(self.left[length] // n for length, n in need.items()))
        for length, n in need.items():
            self.left[length] -= n * times
        self.patterns.append((pattern, times))

    def complements(self, ways: tuple[str, ...]) -> None:
        """From the longest length on: sequences that complements of these ways fill exactly."""
        for longest in range(self.capacity, 0, -1):
            while self.left[longest] > 0:
                self.left[longest] -= 1
                rest = self.exact(self.capacity - longest, self.left, ways)
                self.left[longest] += 1
                if rest is None:
                    break
                self.consume((longest, *rest))

    def best_fit(self, ways: tuple[str, ...]) -> None:
        """What is left: the largest piece that fits, or an exact complement as soon as there is one."""
        for longest in range(self.capacity, 0, -1):
            while self.left[longest] > 0:
                left, pattern, gap = self.left.copy(), [longest], self.capacity - longest
                left[longest] -= 1
                while gap:
                    rest = self.exact(gap, left, ways)
                    if rest is None:
                        some = np.flatnonzero(left[1 : gap + 1])
                        if not len(some):
                            break
                        rest = (int(some[-1]) + 1,)
                    for length in rest:
                        left[length] -= 1
                        gap -= length
                    pattern.extend(rest)
                self.consume(tuple(pattern))

    #: Orders of the exact phase, and the complements that the residual phase looks for.
    ORDERS = (
        ((("single", "pair", "triple"),), ("single", "pair", "triple")),
        ((("single",), ("pair",), ("triple",)), ("single", "pair", "triple")),
        ((("single",), ("pair",)), ("single", "pair", "triple")),
        ((("single",),), ("single", "pair", "triple")),
        ((("single",),), ("single", "pair")),
        ((("single",),), ("single",)),
    )

    def run(self) -> list[tuple[tuple[int, ...], int]]:
        """The plan with the fewest sequences among those of the orders; the number of pieces does not change their cost."""
        given, plans = self.left.copy(), []
        least = -(-int((given * np.arange(len(given))).sum()) // self.capacity)
        for phases, ways in self.ORDERS:
            self.left, self.patterns = given.copy(), []
            for phase in phases:
                self.complements(phase)
            self.best_fit(ways)
            plans.append(self.patterns)
            if sum(times for _, times in self.patterns) <= least:
                break  # no plan has fewer
        self.patterns = min(plans, key=lambda plan: sum(times for _, times in plan))
        return self.patterns


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row a piece with its sequence and offset; ``with_ids`` adds the token ids."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    pieces = stored(pieces_of(rows, tokenizer, capacity, end_id, with_ids), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # at most one row a length: `capacity` rows
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}

    slots, used, base = [], Counter(), 0
    for pattern, times in Planner(counts, capacity).run():
        offset = 0
        for length in pattern:
            slots.append((length, used[length], used[length] + times, base - used[length], offset))
            used[length] += times
            offset += length
        base += times
    plan = spark.createDataFrame(slots, "length long, low long, high long, shift long, offset long")
    at = F.col("rank") + F.col("before")
    # always shuffled, at every size alike: the table of earlier pieces has a row for each length and task
    placed = pieces.join(before.hint("shuffle_hash"), ["length", "task"]).withColumn("at", at).alias("p")
    # the plan has a few thousand rows at most, whatever the input
    met = placed.join(F.broadcast(plan).alias("s"), (F.col("p.length") == F.col("s.length")) & (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    columns = ["doc_id", "piece", "start", "p.length", "ids_crc32", (F.col("at") + F.col("shift")).alias("sequence_id"), "offset"]
    return met.select(*columns, *(["ids"] if with_ids else [])).withColumnRenamed("doc_id", id_col)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
