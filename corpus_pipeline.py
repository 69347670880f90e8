"""The corpus pipeline: quality, line dedup, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bpe, jaccard, lines, mixing, quality
from emberlog.llm.common import table, unused, written
from emberlog.llm.queries import word_bpe


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; an empty table stays one. Null and empty texts are scored as empty ones."""
    model = quality.fit(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    return quality.classify(docs, model).where("_quality.predicted = 1").drop("_quality")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go; n_chars follows the text. No document goes, an emptied one stays empty, a null text null.

    Rows that repeat an id and its text keep or lose the same chunks.
    """
    out = lines.dedup_lines(docs).drop("_lines")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest doc_id.

    Rows that repeat an id and its text are one document, and one of them stays; rows that repeat an id with another text stay. Rows
    with a null id stay, null and empty texts too. An empty table stays one.
    """
    id_ = unused("_id", docs.columns)
    gone = jaccard.jaccard_classes(docs, links=False).where("not kept").select(F.col("doc_id").alias(id_)).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col(id_), "left_anti")
    again = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias("n")).where("n > 1").select(id_)
    once = left.join(again, F.col("doc_id") == F.col(id_), "left_anti")
    return once.union(left.join(again, F.col("doc_id") == F.col(id_), "left_semi").dropDuplicates(["doc_id", "text"]))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves sources by their target weights; null texts count as one character, null sources as one source."""
    return mixing.mixed_order(docs, size=F.length("text"), block_size=65536, slots=1000)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, their number and digest, and the digest of the text they decode to, in the mixed order.

    Files that are read again lose the order of their rows, so the schedule is computed again; it rests on the rows alone. A null text has
    no ids; repeated rows give repeated results.
    """
    return bpe.encoded_digests(mixing_stage(spark, docs, sf_dir), word_bpe())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: The classifier's fit has no SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
