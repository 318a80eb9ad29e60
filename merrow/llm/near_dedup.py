"""MinHash near duplicates with sequential Bayesian verification.

Every document gets its set of word shingles and a signature of minima. Documents with the same set are one class;
classes meet in bands of the signature. The signatures of a candidate pair are compared batch by batch: after n of
them with m equal, the pair is dropped when the posterior probability of a similarity at the threshold or above
(uniform prior) is under ``miss``. Survivors are verified on their full sets.

No group is ever expanded into all its pairs. In each bucket a member meets the bucket's centre first (rounds with
different centres); after each round the verified links are turned into components, and only buckets that still hold
several components go on. Before the second round the shingles of the documents in them are counted: one in which
fewer shingles than the threshold's share occur in any other of them can have no link and goes, which is exact.
Members of a bucket that are in different components after the last round are all compared, so no link that would
join two components is lost: as pairs in buckets of up to ``SMALL`` members, and beyond that in blocks of ``BLOCK``
members against blocks, each a task of its own that gives the links alone (signatures prune, then the sizes of all
intersections of the full sets come from products of membership matrices).

Documents with equal hashes of their sets are one class only after a comparison of the full sets; links that come
from hashes are confirmed on full sets too. Words are hashed by BLAKE2b, and the size of a set is exact.

Defined cases: white space is ASCII; with fewer words than a shingle has, the whole sequence is one shingle; a text
without words (or null) has an empty set, is its own component and linked with nothing; rows that share an identifier
have one component, found by the largest of their texts, and so do those without an identifier; a very long text is read in windows of ``WINDOW`` bytes (its words as numbers, some 16 bytes for each,
stay in memory); further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, Tables, documents, join_dealt, mix64, plain_text, salted
from .components import components

ROWS, BANDS, BATCH = 4, 32, 16
SMALL, BLOCK = 16, 256
NO_ID = 2**63 - 1  # stands for a null identifier, so that it never is the smallest beside another


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def shingle_set(text: str, size: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


WINDOW = 1 << 20
GAP = re.compile(rb"[\x20\x09-\x0d]")


def word_windows(data: bytes) -> Iterator[list[bytes]]:
    """The words of lower-cased bytes, in windows of ``WINDOW`` bytes that end between words."""
    start = 0
    while start < len(data):
        gap = GAP.search(data, start + WINDOW)
        end = gap.start() if gap else len(data)
        yield data[start:end].split()
        start = end


class Words(dict):
    """word -> its number, in order of appearance; ``hashes`` has 64 bits of BLAKE2b for each number."""

    MOST = 400_000

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.empty(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty(n, np.uint64)])
        self.hashes[n] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return n


class Signer:
    """Hashes of the distinct shingles of a text, and the minima of a family of multiplicative hashes over them."""

    def __init__(self, size: int, hashes: int = ROWS * BANDS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.size = size
        self.mul = rng.integers(0, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)
        self.words = Words()

    def shingles(self, text: str) -> np.ndarray:
        """One hash for each distinct shingle; shingles with equal hashes are compared word by word, so the number is exact."""
        if len(self.words) > Words.MOST:
            self.words = Words()
        parts = [np.fromiter(map(self.words.__getitem__, w), np.int64, len(w)) for w in word_windows(text.encode("utf-8").lower())]
        number = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if not len(number):
            return np.zeros(0, np.uint64)
        n = min(self.size, len(number))
        last = len(number) - n + 1
        words = self.words.hashes[number]
        h = np.full(last, n, np.uint64)
        for i in range(n):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[i : last + i])
        order = np.argsort(h, kind="stable")
        h = h[order]
        again = np.flatnonzero(h[1:] == h[:-1])
        x, y = order[again], order[again + 1]
        if any((number[x + i] != number[y + i]).any() for i in range(n)):
            return self.told_apart(number, n)
        return h[np.concatenate([[True], h[1:] != h[:-1]])]

    def told_apart(self, number: np.ndarray, n: int) -> np.ndarray:
        """The same for a set in which two shingles share a hash: a digest of each shingle's whole words."""
        word = {v: k for k, v in self.words.items()}
        parts = zip(*(number[i : len(number) - n + 1 + i].tolist() for i in range(n)), strict=True)
        digests = [hashlib.blake2b(b" ".join(word[i] for i in part), digest_size=8).digest() for part in set(parts)]
        return np.sort(np.frombuffer(b"".join(digests), np.uint64))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(low), 1024):
            part = low[i : i + 1024] ^ self.add[:, None]
            part *= self.mul[:, None]
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x2C1B3C6D)
            np.minimum(out, part.min(1), out=out)
        return out


SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("signature", pa.binary())])


def signed(rows: DataFrame, size: int) -> DataFrame:
    def sign(batches):
        signer = Signer(size)
        for batch in batches:
            made = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = signer.shingles(text.as_py())
                with np.errstate(over="ignore"):
                    h1, h2 = s.sum(dtype=np.uint64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                made.append((doc_id, len(s), int(h1.astype(np.int64)), int(h2.astype(np.int64)), signer.signature(s).tobytes() if len(s) else None))
            yield pa.RecordBatch.from_pydict({n: [m[i] for m in made] for i, n in enumerate(SIGNED.names)}, schema=SIGNED)

    return rows.mapInArrow(sign, "doc_id long, n long, h1 long, h2 long, signature binary")


def banded(classes: DataFrame) -> DataFrame:
    """(key, id): one row for each band of a signature."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def bands(batches):
        salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, BANDS, ROWS)
            h = np.broadcast_to(salt, (batch.num_rows, BANDS)).copy()
            for r in range(ROWS):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r].astype(np.uint64))
            ids = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(ids)], schema=schema)

    return classes.select("id", "signature").mapInArrow(bands, "key long, id long")


def least_equal(threshold: float, miss: float, hashes: int = ROWS * BANDS) -> list[int]:
    """For each batch end n, the fewest equal positions m with P(similarity >= threshold | m of n) >= miss."""

    def tail(m: int, n: int) -> float:  # of Beta(m + 1, n - m + 1) above the threshold: a binomial sum
        return sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    return [next(m for m in range(n + 1) if tail(m, n) >= miss) for n in range(BATCH, hashes + 1, BATCH)]


def plausible(pairs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) that no batch rules out."""
    needed = least_equal(threshold, miss)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def prune(batches):
        for batch in batches:
            alive = np.arange(batch.num_rows)
            if not len(alive):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in (2, 3))
            equal = np.zeros(batch.num_rows, np.int64)
            for k, least in enumerate(needed):
                part = slice(k * BATCH, (k + 1) * BATCH)
                equal[alive] += (x[alive, part] == y[alive, part]).sum(1)
                alive = alive[equal[alive] >= least]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in (0, 1)], schema=schema)

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(prune, "a long, b long")


def verified(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b, text_a, text_b) with 100 * intersection >= percent * union of the full sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches):
        recent: OrderedDict[int, set] = OrderedDict()

        def known(i: int, text) -> set:
            if i not in recent:
                recent[i] = shingle_set(text.as_py(), size)
                if len(recent) > 8:
                    recent.popitem(last=False)
            recent.move_to_end(i)
            return recent[i]

        for batch in batches:
            ok = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                s, t = known(a, x), known(b, y)
                both = len(s & t)
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in (0, 1)], schema=schema)

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def unlike(several: DataFrame, texts: DataFrame, size: int, tables: Tables) -> DataFrame:
    """several (doc_id, first, copies) -> the doc_ids whose full set is not that of the first document of their class."""
    with_text = several.distinct().join(texts, "doc_id")
    lead = with_text.where(F.col("doc_id") == F.col("first")).select(F.col("first").alias("b"), F.col("text").alias("text_b"), "copies")
    others = with_text.where(F.col("doc_id") != F.col("first")).select(F.col("doc_id").alias("a"), "first", F.col("text").alias("text_a"), "copies")
    met = salted(others.withColumnRenamed("first", "b"), tables.stored(lead, "lead"), "b", "copies", "a")
    good = verified(met, size, 100).select(F.col("a").alias("doc_id"))
    return tables.stored(several.where("doc_id <> first").select("doc_id").distinct().join(good, "doc_id", "left_anti"), "unlike")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: id, n_shingles, component_id, kept, class_id (documents with one set share it)."""
    tables = Tables(docs.sparkSession, "near")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), plain_text(text_col).alias("text"))
    sigs = tables.stored(signed(rows, shingle), "signed")
    full, key = sigs.where("n > 0"), ["n", "h1", "h2"]
    while True:
        grouped = full.groupBy(*key).agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.count("*").alias("copies"))
        classes = tables.stored(grouped, "classes")
        n_classes, n_full = classes.count(), full.count()
        bands = banded(classes)
        shared = tables.stored(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
        members = tables.stored(join_dealt(bands, shared, ["key"], "size", n_classes, ["id"], alike=True), "members")
        firsts = classes.where("copies > 1").select(*key, F.col("id").alias("first"), "copies")
        several = tables.stored(join_dealt(full.select("doc_id", *key), firsts, key, "copies", n_full, ["doc_id"], alike=True).drop(*key), "several")
        # the texts of the copies, and one for each class that any bucket holds
        wanted = tables.stored(members.select(F.col("id").alias("doc_id")).union(several.select("doc_id")).distinct(), "wanted")
        texts = Filter(tables, wanted, "doc_id").probe(rows).join(wanted.hint("merge"), "doc_id", "left_semi")
        texts = tables.stored(texts.groupBy("doc_id").agg(F.max("text").alias("text")), "texts")
        failed = unlike(several, texts, shingle, tables)
        if failed.isEmpty():
            break
        # a collision of 128 bits, or one identifier with several texts: a class of its own, linked by its bands as any other
        own = F.col("own").isNotNull()
        apart = full.join(failed.withColumn("own", F.lit(1)), "doc_id", "left")
        apart = apart.withColumn("h1", F.when(own, F.col("doc_id")).otherwise(F.col("h1"))).withColumn("h2", F.when(own, F.lit(-1)).otherwise(F.col("h2")))
        full = tables.stored(apart.drop("own"), "apart")
    signatures = classes.select("id", "signature")

    def confirmed_links(pairs: DataFrame) -> DataFrame:
        # texts of pairs only go into the shuffles; the joins are the same at every size, so they grow in proportion
        ends = tables.stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
        some = Filter(tables, ends, "doc_id").probe(texts)
        with_a = pairs.hint("merge").join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        with_both = with_a.hint("merge").join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        return tables.stored(verified(with_both, shingle, percent), "links")

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = tables.stored(pairs.distinct(), "pairs")
        with_a = pairs.join(signatures.select(F.col("id").alias("a"), F.col("signature").alias("sig_a")), "a")
        with_both = with_a.join(signatures.select(F.col("id").alias("b"), F.col("signature").alias("sig_b")), "b")
        return confirmed_links(tables.stored(plausible(with_both, percent / 100, miss), "plausible"))

    members = members.withColumn("component", F.col("id"))
    links, labels = None, None
    # a star in each bucket, around the smallest member, then around the one with most in common
    for order in (F.col("id"), F.col("apart")):
        centre = F.min_by(F.struct("id", "component"), order).alias("centre")
        centres = tables.stored(members.groupBy("key").agg(centre, F.first("size").alias("size")), "centres")
        star = salted(members, centres, "key", "size", "id").where(F.col("component") != F.col("centre.component"))
        found = links_of(star.select(F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b")))
        links = found if links is None else links.unionByName(found)
        labels = components(links, tables)
        first = "apart" not in members.columns
        members = _open(members, labels, tables)
        if first:
            common = tables.stored(in_common(texts.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), shingle, tables), "common")
            able = common.where(100 * F.col("shared") >= percent * F.col("n")).select("id", "n", (F.col("n") - F.col("shared")).alias("apart"))
            members = _mixed(members.join(able, "id"), tables)
    sizes = tables.stored(members.groupBy("key").agg(F.count("*").alias("now")), "sizes")
    members = tables.stored(members.join(sizes, "key").drop("size").withColumnRenamed("now", "size"), "rest")
    crowd = members.where(F.col("size") > SMALL)
    one = tables.stored(block_links(crowd, texts, shingle, percent, miss, tables), "block-links")
    sure = confirmed_links(one)
    if sure.count() < one.count():  # a link of hashes that the full sets refute: all links instead of one for two components
        sure = confirmed_links(tables.stored(block_links(crowd, texts, shingle, percent, miss, tables, every=True), "block-links"))
    links = links.unionByName(sure)
    x, y = members.where(F.col("size") <= SMALL).alias("x"), members.alias("y")
    near_size = (100 * F.col("x.n") >= percent * F.col("y.n")) & (100 * F.col("y.n") >= percent * F.col("x.n"))
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & near_size)
    links = links.unionByName(links_of(rest.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))))
    labels = components(links, tables)

    of_class = classes.join(labels, "id", "left").select("n", "h1", "h2", "copies", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component"))
    of_class = tables.stored(of_class, "of-class")
    placed = join_dealt(full.select("doc_id", *key), of_class, key, "copies", n_full, ["doc_id"], alike=True)
    alone = sigs.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("component"))
    out = placed.select("doc_id", "n", "class_id", "component").unionByName(alone)
    component, named = F.coalesce("component", "doc_id"), lambda c: F.nullif(c, F.lit(NO_ID))
    return tables.result(
        out.select(
            named(F.col("doc_id")).alias(id_col),
            F.col("n").alias("n_shingles"),
            named(component).alias("component_id"),
            (F.col("doc_id") == component).alias("kept"),
            named(F.coalesce("class_id", "doc_id")).alias("class_id"),
        )
    )


def in_common(texts: DataFrame, size: int, tables: Tables) -> DataFrame:
    """(id, n, shared): a document's shingles, and how many of them occur in another document too, or a few more.

    32 bits of the hashes will do: two shingles taken for one only keep a document that need not be kept.
    """
    schema = pa.schema([("h", pa.int32()), ("id", pa.int64())])

    def explode(batches):
        signer = Signer(size)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = (signer.shingles(text.as_py()) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), doc_id))], schema=schema)

    rows = texts.select("doc_id", "text").mapInArrow(explode, "h int, id long")
    twice = tables.stored(rows.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h", F.lit(1).alias("twice")), "twice")
    return rows.join(twice.hint("merge"), "h", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("twice").alias("shared"))


def sets_of(texts: DataFrame, size: int) -> DataFrame:
    """(id, hashes, signature): a document's full set and its minima."""
    schema = pa.schema([("id", pa.int64()), ("hashes", pa.binary()), ("signature", pa.binary())])

    def sets(batches):
        signer = Signer(size)
        for batch in batches:
            made = [(i, h.tobytes(), signer.signature(h).tobytes()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for h in [signer.shingles(t.as_py())]]
            yield pa.RecordBatch.from_pydict({n: [m[k] for m in made] for k, n in enumerate(schema.names)}, schema=schema)

    return texts.select("doc_id", "text").mapInArrow(sets, "id long, hashes binary, signature binary")


def intersections(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of slices of the membership matrix."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[several], number[column[several]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, columns):
        part = slice(*np.searchsorted(column, [start, start + columns]))
        member = np.zeros((len(sets), columns), np.float32)
        member[row[part], column[part] - start] = 1
        out += member @ member.T
    return out.astype(np.int64)


def block_links(members: DataFrame, texts: DataFrame, size: int, percent: int, miss: float, tables: Tables, every: bool = False) -> DataFrame:
    """Links between components in large buckets: blocks of a bucket meet blocks, one link for two components comes out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    needed = least_equal(percent / 100, miss)
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    sets = tables.stored(sets_of(texts.join(wanted, "doc_id", "left_semi"), size), "sets")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    placed = members.select("key", "id", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).alias("block"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = placed.withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def link(table: pa.Table) -> pa.Table:
        ids, component, block = (table[c].to_numpy() for c in ("id", "component", "block"))
        full = [np.frombuffer(h, np.uint64) for h in table["hashes"].to_pylist()]
        signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint32).reshape(len(ids), -1)
        n = np.array([len(h) for h in full])
        alive = (component[:, None] != component) & (ids[:, None] < ids) & (100 * n[:, None] >= percent * n) & (100 * n >= percent * n[:, None])
        if (block != block[0]).any():
            alive &= block[:, None] != block
        equal = np.zeros(alive.shape, np.int16)
        for k, least in enumerate(needed):
            for column in range(k * BATCH, (k + 1) * BATCH):
                equal += signature[:, column, None] == signature[:, column]
            alive &= equal >= least
        some = np.flatnonzero(alive.any(1) | alive.any(0))
        if not len(some):
            return schema.empty_table()
        both = intersections([full[i] for i in some])
        m = n[some]
        i, j = np.nonzero(alive[np.ix_(some, some)] & (100 * both >= percent * (m[:, None] + m - both)))
        if not every:
            _, first = np.unique(np.sort(np.column_stack([component[some][i], component[some][j]])), axis=0, return_index=True)
            i, j = i[first], j[first]
        return pa.Table.from_arrays([pa.array(ids[some][i]), pa.array(ids[some][j])], schema=schema)

    return met.join(sets, "id").groupBy("key", "low", "high").applyInArrow(link, "a long, b long").distinct()


def _open(members: DataFrame, labels: DataFrame, tables: Tables) -> DataFrame:
    """Members with their new components, in the buckets that hold more than one component."""
    now = members.drop("component").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return _mixed(now, tables)


def _mixed(members: DataFrame, tables: Tables) -> DataFrame:
    mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return tables.stored(members.join(tables.stored(mixed, "mixed"), "key"), "open")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=4, percent=80).drop("class_id")
