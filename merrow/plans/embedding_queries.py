"""Queries of hashed vectors by entry, and of a build that is cut off and resumed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from merrow.functions.storage import shared_folder
from merrow.operators import vectors
from merrow.operators.embedding_build import EmbeddingBuild

from .registry import query

#: Signed word counts by SHA-256 of the word: four bytes, the lowest first, give the bucket, the fifth the sign.
ENTRIES = """
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(trim(lower(text)), '[ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents),
h AS (SELECT doc_id, sha256(w) AS h FROM w WHERE w <> ''),
b AS (
  SELECT doc_id, CAST(('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT % {dim} AS INT) AS bucket,
    CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM h),
c AS (SELECT doc_id, bucket, sum(sign)::DOUBLE AS x FROM b GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM c GROUP BY 1)
SELECT {id} AS id, bucket, round(CAST(CAST(x / n AS {kind}) AS DOUBLE), 5) AS entry FROM c JOIN n USING (doc_id) WHERE x <> 0"""


def entries(made, id_col):
    return made.select(F.col(id_col).alias("id"), F.posexplode("vec").alias("bucket", "x")).where("x <> 0").select("id", "bucket", F.round(F.col("x").cast("double"), 5).alias("entry"))


@query(ENTRIES.replace("{dim}", "64").replace("{id}", "doc_id").replace("{kind}", "DOUBLE"))
def g01_hash_embed_entries(v):
    return entries(vectors.hash_embed(v.documents, 64, "doc_id", "text"), "doc_id")


@query(ENTRIES.replace("{dim}", "32").replace("{id}", "printf('D%012d', doc_id)").replace("{kind}", "FLOAT"))
def g07_resumed_build(v):
    """The vectors of all documents after a build that stopped behind its first wave and was resumed."""
    items = v.documents.select(F.format_string("D%012d", "doc_id").alias("id"), "text")
    encode = lambda new: vectors.hash_embed(new, 32, "id", "text")
    path = f"{shared_folder(v.spark)}/merrow-embeddings-{uuid.uuid4().hex}"
    first = EmbeddingBuild(v.spark, path, encode, 32, {"encoder": "hash", "version": 1})
    first.start(items, rows_a_range=max(1, items.count() // 7))
    first.run(items, ranges_a_wave=2, waves=1)
    resumed = EmbeddingBuild(v.spark, path, encode, 32, {"encoder": "hash", "version": 1})
    resumed.run(items, ranges_a_wave=4)
    return entries(resumed.vectors(), "id")
