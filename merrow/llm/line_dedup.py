"""Line deduplication: explode normalised lines, hash, count distinct documents, drop, reassemble by position.

A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Keys of at least
``min_chars`` code points found in at least ``min_docs`` documents lose all their lines, except in the document with
the largest identifier among those holding it. The long lines are hashed once and written: 16 bytes of hash, identifier
and position; that is all that is shuffled of them, and a line that very many documents hold is dealt to many tasks. The
texts go through one shuffle, to meet the positions that they lose.

Defined cases: a null or empty text is one empty line; a text of any length is one row, and its lines are rows of their
own; columns named n_lines or n_dropped are replaced by the counts, if those are asked for; rows that share an identifier are one document for the count,
and each keeps or loses its lines alike; null identifiers count as one document that never is the largest beside
another; further columns stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, documents, join_dealt, plain_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(WHITE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def dedup_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", with_counts: bool = True
) -> DataFrame:
    """``docs`` with text replaced by the lines that stay; ``with_counts`` adds n_lines, n_dropped."""
    tables = Tables(docs.sparkSession, "lines")
    added = ["n_lines", "n_dropped"] if with_counts else []
    others = [c for c in docs.columns if c not in (text_col, *added)]
    rows = docs.select(
        F.struct(*[F.col(c) for c in others]).alias("_row"),
        F.col(id_col).alias("_id"),
        plain_text(text_col).alias("_text"),
    ).withColumn("_version", F.xxhash64("_text"))
    lines = F.split("_text", "\n", -1)
    long_lines = (
        rows.select("_id", "_version", F.posexplode(lines).alias("_pos", "_line"))
        .where(F.char_length("_line") >= min_chars)
        .select("_id", "_version", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_version", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))
    )
    long_lines = tables.stored(long_lines, "long")
    common = (
        long_lines.select("_h1", "_h2", "_id").distinct()
        .groupBy("_h1", "_h2").agg(F.count("*").alias("_docs"), F.max("_id").alias("_keeper"))
        .where(F.col("_docs") >= min_docs)
    )
    common = tables.stored(common, "common")
    lost = (
        join_dealt(long_lines, common, ["_h1", "_h2"], "_docs", long_lines.count(), ["_id", "_pos"])
        .where(~F.col("_id").eqNullSafe(F.col("_keeper")))
        .groupBy("_id", "_version").agg(F.collect_set("_pos").alias("_lost"))
        .select(F.col("_id").alias("_lost_id"), F.col("_version").alias("_lost_version"), "_lost")
    )
    lost = tables.result(lost)
    # merged at every size alike: texts are the wide side, and small inputs tell what large ones cost
    met = rows.join(lost.hint("merge"), F.col("_id").eqNullSafe(F.col("_lost_id")) & (F.col("_version") == F.col("_lost_version")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), "_lost")
    rebuilt = F.concat_ws("\n", F.transform(stay, lambda i: F.get("_lines", i)))
    out = met.withColumn("_lines", lines).withColumn("_n", F.size("_lines"))
    dropped = F.size(F.coalesce("_lost", F.array().cast("array<int>")))
    out = out.select("_row", F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(rebuilt).alias("_kept"), "_n", dropped.alias("_dropped"))
    counts = [F.col(c).cast("long").alias(name) for c, name in zip(("_n", "_dropped"), added, strict=False)]
    return out.select("_row.*", F.col("_kept").alias(text_col), *counts)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents)),
hot AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, hot.k IS NOT NULL AND doc_id <> keeper AS gone FROM l LEFT JOIN hot ON l.k = hot.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
