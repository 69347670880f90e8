"""The registered queries of this subpackage: thin forms of its operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bpe, fim, jaccard, lines, media, merkle, mixing, neardup, quality, substring, suffixtree, tokenbin, warc
from emberlog.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 65,536 characters, square-root weights, a period of 1,000 slots."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("chars"))
    return mixing.mix_sources(docs, size=F.col("chars"), block_size=65536, slots=1000).drop("chars")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), word_bpe())


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_rows(media.store_texts(table(spark, sf_dir, "documents")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    return quality.classify(docs, model).select("doc_id", "_quality.*")


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.read_tokens(tokenbin.write_tokens(table(spark, sf_dir, "documents"), word_bpe(), 49408, 1))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    clean = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", F.col("_lines.n").alias("n_lines"), F.col("_lines.removed").alias("removed_lines"),
                      F.length(clean).cast("long").alias("clean_chars"), F.md5(clean).alias("clean_md5"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.parse_records(warc.read_records(spark, at)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), k=5, threshold=0.8)


def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffixtree.tree_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other document's claim is its row without line ends in the text."""
    docs = table(spark, sf_dir, "documents")
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    cut = merkle.leaf(*row, F.translate("text", "\n", ""))
    return merkle.proven(docs, claim=F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, cut).otherwise(merkle.leaf(*row, F.col("text"))))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.rebuilt(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources, "op2_bpe": op2_bpe, "op3_near_duplicates": op3_near_duplicates,
    "op4_substring_dedup": op4_substring_dedup, "op5_line_dedup": op5_line_dedup, "op6_media": op6_media,
    "op7_quality": op7_quality, "op8_warc": op8_warc, "op9_token_binary": op9_token_binary, "op10_jaccard_join": op10_jaccard_join,
    "op11_suffix_tree": op11_suffix_tree, "op12_merkle_manifest": op12_merkle_manifest, "op13_fill_in_middle": op13_fill_in_middle,
}
SQL = {"op1_mix_sources": mixing.SQL, "op3_near_duplicates": neardup.SQL, "op5_line_dedup": lines.SQL, "op8_warc": warc.SQL, "op10_jaccard_join": jaccard.SQL,
       "op12_merkle_manifest": merkle.SQL, "op13_fill_in_middle": fim.SQL}
