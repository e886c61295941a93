"""The corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents. NULL texts count as empty. Stages drop rows by their place
in their files, never by doc_id: of rows that share an id only those go whose
text is a copy, and of equal rows one stays. The near-copies stage leaves rows
with a NULL doc_id. Empty tables pass through; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import exact_dedup, jaccard, packing, pii, quality
from lodestar.llm.common import columns_of, free_name, stash, table

#: Scores and trained spans are not expressible in SQL.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(quality.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return quality.accepted(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return jaccard.drop_near_copies(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data redacted; n_chars follows the text where it changed."""
    model = pii.fit(docs)
    before = free_name("__chars", docs)
    redacted = pii.redact(docs.withColumn(before, F.char_length("text").cast("long")), model)
    if "n_chars" in docs.columns:
        changed = F.char_length("text").cast("long")
        redacted = redacted.withColumn("n_chars", F.when(changed != F.col(before), changed).otherwise(F.col("n_chars")))
    return redacted.select(columns_of(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("jaccard", jaccard_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
