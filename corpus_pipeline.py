"""Corpus preparation: toxicity, line dedup, near-duplicate removal, masking of personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of ``documents``, with n_chars of the text as it is then.

Defined cases of every stage: a null text is empty (it stays null where the stage does not change texts); an empty table
gives an empty one; texts of any length are handled whole; rows that share an identifier stay or go alike in the
near-duplicate stage and are rows of their own elsewhere; further columns are kept, whatever their names, up to the last
stage, which ignores them. Each stage's docstring says what else there is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merrow.llm.common import documents, stored
from merrow.llm.line_dedup import dedup_lines
from merrow.llm.near_dedup import near_duplicates
from merrow.llm.packing import pack
from merrow.llm.pii import redact
from merrow.llm.toxicity import fit_toxicity, keep_clean


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go, the others stay as they are; one without letters is not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_clean(docs, fit_toxicity(docs, labels))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of five documents or more stay in the largest identifier's document only; a null text becomes empty."""
    return counted(dedup_lines(docs, with_counts=False), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest identifier of each group of near duplicates stays (five words, 0.8); documents without words all stay."""
    kept = near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.kept_id), "left_semi")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emails, IP addresses, card and phone numbers, disguised or not, become their kind in brackets; null stays null."""
    return counted(redact(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces with their token ids, in sequences of at most 1024 tokens; an empty one is its end id."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("near dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

# classifier, signatures and tokenizer are not SQL; the tests hold every stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
