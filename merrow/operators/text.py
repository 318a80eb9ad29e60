"""Query and index tokens, postings and BM25."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.functions.storage import stored

from .stemming import porter

# fixed values: words that a query does not search for
STOPWORDS = frozenset(
    "a an the for with and or of to in on at by from is are be i me my we our you your "
    "want need looking find get some any good best cheap new under over below".split()
)
K1, B, FLOOR = 1.2, 0.75, 1e-6
FEW = 100_000  # query rows that are sent to every task


@F.pandas_udf(T.StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition; no built-in function has it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t))


def tokenize_query(column: Column | str, most: int = 20) -> Column:
    """Words of letters, digits, _ and -, without single characters, stopwords, plain numbers and repeats."""
    words = F.regexp_extract_all(compatible(F.lower(column)), F.lit(r"(?U)([\p{L}\p{N}_-]+)"), F.lit(1))
    number = lambda w: F.regexp_replace(w, "-", "").rlike(r"^\p{N}*$")
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS) & ~number(w))
    return F.slice(F.array_distinct(kept), 1, most)


_MARKS = str.maketrans({**dict.fromkeys("®™©", " "), **dict.fromkeys("‐‑‒–—―−", "-"), **dict.fromkeys("‘’‚′", "'"), **dict.fromkeys("“”„″", '"')})


@F.pandas_udf(T.StringType())
def ascii_fold(texts: pd.Series) -> pd.Series:
    """ASCII text: marks unified, accents stripped, other characters and runs of space as one space."""

    def fold(text):
        if text is None:
            return None
        if not text.isascii():
            text = unicodedata.normalize("NFKD", text.translate(_MARKS))
            text = "".join(" " if ord(c) > 127 else c for c in text if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", text).strip()

    return texts.map(fold)


def tokenize_ascii(column: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit("([a-z0-9][a-z0-9-]*)"), F.lit(1))


def index_tokens(column: Column | str) -> Column:
    """Unicode words, the way an index splits its documents."""
    return F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def stemmed(tokens: DataFrame, column: str = "token") -> DataFrame:
    """Stems of the distinct vocabulary only, joined back."""

    @F.pandas_udf(T.StringType())
    def stem(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in words:
            yield part.map(porter)

    stems = tokens.select(column).distinct().select(column, stem(column).alias("_stem"))
    return tokens.join(stems, column).withColumn(column, F.col("_stem")).drop("_stem")


def build_postings(docs: DataFrame, id_col: str, text: Column | str, stem: bool = False) -> DataFrame:
    """(token, id, tf, dl): term frequency and document length in tokens."""
    words = docs.select(F.col(id_col).alias("id"), index_tokens(text).alias("words"))
    tokens = words.select("id", F.size("words").alias("dl"), F.explode("words").alias("token"))
    tokens = stemmed(tokens) if stem else tokens
    return tokens.groupBy("token", "id", "dl").agg(F.count("*").alias("tf")).select("token", "id", "tf", "dl")


def asked_postings(docs: DataFrame, id_col: str, text: Column | str, queries: DataFrame) -> DataFrame:
    """(token, id, tf, dl) of the tokens of queries (query_id, token) only, and one row of the empty token for each document.

    No text has an empty token: its rows bring the lengths of all documents along, so texts are split once and what
    nobody asks for is not moved.
    """
    words = docs.select(F.col(id_col).alias("id"), index_tokens(text).alias("words"))
    tokens = words.select("id", F.size("words").alias("dl"), F.explode(F.array_append("words", F.lit(""))).alias("token"))
    asked = queries.select(F.explode(F.array("token", F.lit(""))).alias("token")).distinct()
    return tokens.join(asked, "token", "left_semi").groupBy("token", "id", "dl").agg(F.count("*").alias("tf")).select("token", "id", "tf", "dl")


def bm25(postings: DataFrame, queries: DataFrame, visible: DataFrame | None = None, size: DataFrame | None = None, by_document: bool = False) -> DataFrame:
    """queries (query_id, token) -> (query_id, id, score) of every document with any of the tokens.

    ``visible`` (id) restricts documents and, with them, all statistics. ``size`` (docs, avgdl; one row) gives the
    statistics where they are known, or where the postings are a part of the index. A frequent token's postings meet a
    few query rows: the join may be split by adaptive execution, the sums are partial. ``by_document``: postings are
    dealt by document and up to ``FEW`` query rows are sent to them, so that sums are made where a document is.
    """
    rows = postings if visible is None else postings.join(visible.select("id").distinct(), "id", "left_semi")
    if size is None:
        size = rows.groupBy("id").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    asked = queries.select("query_id", "token").distinct()
    rows = rows.join(asked.select("token").distinct(), "token", "left_semi")
    df = rows.groupBy("token").agg(F.count("*").alias("df"))
    wanted = asked.join(df, "token")
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(FLOOR))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    if by_document and asked.count() <= FEW:
        rows, wanted = rows.repartition("id"), F.broadcast(wanted)
    hits = rows.join(wanted, "token").crossJoin(size)  # one row of statistics
    return hits.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def bm25_search(postings: DataFrame, queries: DataFrame, limit: int, visible: DataFrame | None = None, size: DataFrame | None = None) -> DataFrame:
    """The best documents of each query: score (rounded, so ties are the same everywhere), then identifier."""
    scores = bm25(postings, queries, visible, size).withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def bm25_listing(
    postings: DataFrame, queries: DataFrame, items: DataFrame, limit: int, tie: str = "rating_number", id_col: str = "item_id", size: DataFrame | None = None
) -> DataFrame:
    """Search among items that a filter has left: statistics are those of the whole index, only listed items compete.

    Order: score, then ``tie`` from high to low with nulls last, then id. total_matches counts what matches before the cut.
    """
    scores = bm25(postings, queries, size=size).withColumn("score", F.round("score", 6))
    found = scores.join(items.select(F.col(id_col).alias("id"), F.col(tie).alias("_tie")), "id")
    totals = found.groupBy("query_id").agg(F.count("*").alias("total_matches"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("_tie"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.join(totals, "query_id").select("query_id", "id", "score", "rank", "total_matches")


def bm25_rank_of(postings: DataFrame, queries: DataFrame, targets: DataFrame, shown: int = 25) -> DataFrame:
    """targets (query_id, id): place in the complete ranking, and what it says about the miss."""
    scores = bm25(postings, queries).withColumn("score", F.round("score", 6))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    found = targets.join(ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    return found.withColumn("place", F.when(F.col("rank").isNull(), "no_match").when(F.col("rank") <= shown, "inside").otherwise("outside"))


def asked_size(postings: DataFrame) -> DataFrame:
    """One row: number of documents with words and their average length, of ``asked_postings``."""
    lengths = postings.where("token = '' AND dl > 0").groupBy("id").agg(F.first("dl").alias("dl"))
    return lengths.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))


def asked_scores(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """As ``bm25``, rounded, of ``asked_postings``: scores are summed where a document is and are not shuffled."""
    scores = bm25(postings.where("token <> ''"), queries, size=asked_size(postings), by_document=True)
    return scores.withColumn("score", F.round("score", 6))


def asked_search(postings: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """As ``bm25_search``, of ``asked_postings``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return asked_scores(postings, queries).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def asked_rank_of(postings: DataFrame, queries: DataFrame, targets: DataFrame, shown: int = 25) -> DataFrame:
    """As ``bm25_rank_of``, of ``asked_postings``: the targets' own scores first, then those before them are counted where they are."""
    wanted = targets.select("query_id", "id").distinct()
    scores = asked_scores(postings, queries)
    own = stored(scores.join(wanted, ["query_id", "id"], "left_semi"), "targets").select("query_id", F.col("id").alias("_id"), F.col("score").alias("_score"))
    own = F.broadcast(own) if own.count() <= FEW else own
    # a target is before itself, whatever the order its sum is taken in
    before = (F.col("id") == F.col("_id")) | (F.col("score") > F.col("_score")) | (F.col("score") == F.col("_score")) & (F.col("id") < F.col("_id"))
    ranks = scores.join(own, "query_id").where(before).groupBy("query_id", "_id").agg(F.count("*").cast("int").alias("rank"))
    found = targets.join(ranks.withColumnRenamed("_id", "id"), ["query_id", "id"], "left")
    return found.withColumn("place", F.when(F.col("rank").isNull(), "no_match").when(F.col("rank") <= shown, "inside").otherwise("outside"))


def history_query(titles: DataFrame, most: int = 20) -> DataFrame:
    """titles (user_id, title_no, title): tokens taken in turn from each title, first of equals, cut."""
    tokens = titles.select("user_id", "title_no", F.posexplode(tokenize_ascii("title")).alias("pos", "token"))
    first = tokens.groupBy("user_id", "token").agg(F.min(F.struct("pos", "title_no")).alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("at"))).where(F.col("rank") <= most)
    return ranked.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda s: s["token"]), " ").alias("query"))


def outside_core_search(postings: DataFrame, queries: DataFrame, core: DataFrame, seen: DataFrame, limit: int, shelf: Column | None = None) -> DataFrame:
    """BM25 over the documents outside the core, without those a query's user has seen. Postings are ``asked_postings``.

    seen (query_id, id); or, with ``shelf``, an expression of id that names the shelf a document is on, seen (query_id,
    shelf): a user has seen all of a shelf, and no row is made for each of its documents.
    """
    outside = postings.join(core.select("id").distinct(), "id", "left_anti")
    scores = asked_scores(outside, queries)
    if shelf is None:
        scores = scores.join(seen, ["query_id", "id"], "left_anti")
    else:
        scores = scores.withColumn("shelf", shelf).join(seen, ["query_id", "shelf"], "left_anti").select("query_id", "id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
