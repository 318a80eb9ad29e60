"""Ranked lexical search with range-maximum tables over posting lists.

Documents become postings (term, document, frequency) of the terms that some item asks for: a bitmap of the items' terms
of bounded size lets the others out where texts are read. Statistics are counted over all documents. Postings are dealt
by document into blocks, and each block meets each chunk of items.

A block keeps its posting lists one behind the other, each in the order of documents, with a sparse table of the places
of the largest impact in every span of 2**j postings. For an item, an interval of documents is bounded by the sum of its
terms' range maxima. The search takes the interval with the highest bound first: it scores the document with the largest
impact of the strongest term, splits the interval there and bounds both halves; an interval with few postings is scored
as a whole. It ends when no bound reaches the k-th best score so far. Each block gives its k best of an item, a window
function the k best of all. All scores are 64-bit integers, so ties are exact.

Defined cases: a null or empty text has no terms; documents without terms count nowhere; documents without an identifier
count in the statistics and are never found; documents that share an identifier are documents of their own; items that
share an identifier are one item with the terms of all, items without terms or hits have no rows; equal scores go to the
smaller identifier; further columns are ignored, whatever their names; an empty table on either side gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, documents, plain_text

# fixed values: what a term is, the formula's constants
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 10
FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

OP11_SQL = rf"""
WITH c AS (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents) GROUP BY 1, 2),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY 1),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM c, s GROUP BY 1),
m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM d, s),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN c USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= {K}
"""


class TermFilter:
    """A bitmap over the CRC-32 of terms: 64 bits a term or more up to ``BITS``, where it lets more through."""

    MAP_BITS, BITS = 1 << 15, 1 << 27  # of a bitmap of the built-in aggregate, and of the whole filter: 16 MB

    def __init__(self, terms: DataFrame) -> None:
        self.bits, n = self.MAP_BITS, terms.count()
        while self.bits < min(64 * n, self.BITS):
            self.bits *= 2
        place = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(self.bits))
        parts = terms.groupBy(F.floor(place / self.MAP_BITS).cast("int").alias("part")).agg(F.bitmap_construct_agg(place % self.MAP_BITS).alias("map"))
        self.map = bytearray(self.bits // 8)
        for r in parts.collect():  # 4 kB each, BITS / MAP_BITS of them at most
            self.map[r.part * self.MAP_BITS // 8 : (r.part + 1) * self.MAP_BITS // 8] = r.map


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))


def frequencies(docs: DataFrame, wanted: TermFilter) -> DataFrame:
    """doc_id, n (all terms) and the terms and frequencies that pass the filter, of each document with a term."""
    bits, mask = bytes(wanted.map), wanted.bits - 1
    low, term = bytes.maketrans(UPPER.encode(), LOWER.encode()), re.compile(rb"[0-9a-z\x80-\xff]+")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        known: dict[bytes, bool] = {}
        for batch in batches:
            out = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = term.findall(text.as_buffer().to_pybytes().translate(low))
                if not found:
                    continue
                passed = []
                for t, tf in Counter(found).items():
                    if (let := known.get(t)) is None:
                        if len(known) > 500_000:
                            known.clear()
                        place = crc32(t) & mask
                        known[t] = let = bool(bits[place >> 3] >> (place & 7) & 1)
                    if let:
                        passed.append((t, tf))
                for column, value in zip(out, (doc_id, len(found), [t.decode("utf-8") for t, _ in passed], [tf for _, tf in passed]), strict=True):
                    column.append(value)
            kinds = pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(count, "doc_id long, n long, terms array<string>, tfs array<long>")


class Block:
    """Posting lists of one block, with sparse tables of the places of range maxima."""

    LEAF = 4096  # postings of an interval that is scored as a whole

    def __init__(self, lists: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_lists: int, n_docs: int) -> None:
        order = np.lexsort((docs, lists))
        self.docs, self.impacts, self.n_docs = docs[order], impacts[order], n_docs
        self.starts = np.searchsorted(lists[order], np.arange(n_lists + 1))
        self.keys = lists[order] * n_docs + self.docs
        longest = int(np.diff(self.starts).max(initial=1))
        levels = [np.arange(len(order), dtype=np.int32)]
        while 2 ** len(levels) <= longest:
            half, last = 2 ** (len(levels) - 1), levels[-1]
            wide = last.copy()
            # the list's own spans only are read, so it doesn't matter where one reaches into the next list
            a, b = last[:-half], last[half:]
            wide[:-half] = np.where(self.impacts[a] >= self.impacts[b], a, b)
            levels.append(wide)
        self.table = np.array(levels)
        self.log = np.zeros(longest + 1, np.int64)
        for j in range(1, len(levels)):
            self.log[2**j :] = j
        self.scored = self.bounded = 0  # postings that were scored, intervals that were bounded

    def maxima(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and impact of the largest in each range; impact 0 for an empty one."""
        some = high > low
        j = self.log[np.where(some, high - low, 1)]
        a, b = self.table[j, np.where(some, low, 0)], self.table[j, np.where(some, high - (1 << j), 0)]
        at = np.where(self.impacts[a] >= self.impacts[b], a, b)
        return at, np.where(some, self.impacts[at], 0)

    def search(self, lists: np.ndarray, times: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, document) of the k best for an item that holds each list's term so many times."""
        best: list[tuple[int, int]] = []  # a heap of (score, -document)
        waiting: list[tuple] = []

        def offer(doc: int, score: int) -> None:
            if score > 0 and (len(best) < k or (score, -doc) > best[0]):
                (heapq.heappushpop if len(best) == k else heapq.heappush)(best, (score, -doc))

        def wait(low: np.ndarray, high: np.ndarray) -> None:
            at, most = self.maxima(low, high)
            parts = most * times
            bound, self.bounded = int(parts.sum()), self.bounded + 1
            if bound > 0 and (len(best) < k or bound >= best[0][0]):
                heapq.heappush(waiting, (-bound, self.bounded, int(self.docs[at[parts.argmax()]]), low, high))

        wait(self.starts[lists], self.starts[lists + 1])
        while waiting and (len(best) < k or -waiting[0][0] >= best[0][0]):
            _, _, doc, low, high = heapq.heappop(waiting)
            sizes = high - low
            total = int(sizes.sum())
            if total <= self.LEAF:
                places = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(total)
                docs, back = np.unique(self.docs[places], return_inverse=True)
                scores = np.zeros(len(docs), np.int64)
                np.add.at(scores, back, np.repeat(times, sizes) * self.impacts[places])
                self.scored += total
                # documents are in ascending order, so a stable sort keeps the smaller ones of a tie
                for i in np.argsort(-scores, kind="stable")[:k]:
                    offer(int(docs[i]), int(scores[i]))
                continue
            middle = np.searchsorted(self.keys, lists * self.n_docs + doc)
            middle = np.clip(middle, low, high)
            inside = middle < high
            inside[inside] = self.docs[middle[inside]] == doc
            offer(doc, int((times[inside] * self.impacts[middle[inside]]).sum()))
            self.scored += int(inside.sum())
            wait(low, middle)
            wait(middle + inside, high)
        return [(score, -doc) for score, doc in sorted(best, reverse=True)]


def search_block(docs: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """The k best documents of a block for each item of a chunk."""
    terms = pc.unique(items["term"])
    of_item = pc.index_in(items["term"], value_set=terms).to_numpy()
    weights = np.zeros(len(terms), np.int64)
    weights[of_item] = items["w"].to_numpy()
    docs = docs.take(pc.sort_indices(docs["doc_id"]))
    held = docs["terms"].combine_chunks()
    sizes = pc.list_value_length(held).to_numpy(zero_copy_only=False)
    lists = pc.index_in(held.flatten(), value_set=terms)
    asked = lists.is_valid().to_numpy(zero_copy_only=False)
    lists = lists.drop_null().to_numpy().astype(np.int64)
    places = np.repeat(np.arange(docs.num_rows), sizes)[asked]
    tf = np.asarray(docs["tfs"].combine_chunks().flatten())[asked]
    impacts = weights[lists] * ((1_000_000_000 * tf) // (1000 * tf + 8 * docs["m"].to_numpy()[places]))
    block = Block(lists, places, impacts, len(terms), docs.num_rows)
    ids, out = docs["doc_id"].to_numpy(), ([], [], [])
    numbers, names = pc.rank(items["item"], tiebreaker="dense").to_numpy(), items["item_id"].to_pylist()
    times, order = items["times"].to_numpy(), np.argsort(numbers, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1):
        for score, doc in block.search(of_item[rows].astype(np.int64), times[rows], k) if len(rows) else []:
            for column, value in zip(out, (names[rows[0]], ids[doc], score), strict=True):
                column.append(value)
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], schema=FOUND)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    block: int = 1_000_000,
    chunk: int = 500_000,
) -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank, doc_id, score.

    ``block``: postings of a block of documents, ``chunk``: terms of a chunk of items, both on average.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "search")
    exploded = items.select(F.col(item_col).cast("long").alias("item_id"), F.explode(terms_of(plain_text(text_col))).alias("term"))
    asked = tables.stored(exploded.groupBy("item_id", "term").agg(F.count("*").alias("times")), "asked")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    counted = tables.stored(frequencies(rows, TermFilter(asked.select("term").distinct())), "counted")
    stats = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms")).alias("postings")).first()
    if not stats.postings:
        return tables.result(spark.createDataFrame([], "item_id long, rank int, doc_id long, score long"))
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = F.lit(float(2 * stats.docs + 2)) / (2 * F.col("df") + 1).cast("double")
    weight = F.floor(1000 * F.log(ratio)).cast("long").alias("w")
    weighted = tables.stored(asked.join(df, "term").select("item_id", "term", "times", weight), "weighted")
    blocks, chunks = max(1, -(-stats.postings // block)), max(1, -(-weighted.count() // chunk))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    m = (25 + F.expr(f"(75 * n * {stats.docs}L) div {stats.terms}L")).alias("m")
    place = F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(blocks)).alias("block")
    lists = counted.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0)).select("doc_id", m, "terms", "tfs", place)
    dealt = lists.withColumn("chunk", all_of(chunks)).groupBy("block", "chunk")
    # an item's number, for items without an identifier too
    number = F.xxhash64(F.col("item_id").isNull(), "item_id")
    asks = weighted.select("item_id", "term", "times", "w", number.alias("item"), F.pmod(number, F.lit(chunks)).alias("chunk")).withColumn("block", all_of(blocks))
    local = dealt.cogroup(asks.groupBy("block", "chunk")).applyInArrow(
        lambda left, right: search_block(left, right, k) if left.num_rows and right.num_rows else FOUND.empty_table(), "item_id long, doc_id long, score long"
    )
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return tables.result(ranked.select("item_id", "rank", "doc_id", "score"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
