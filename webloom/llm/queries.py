"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import table


def op1_warc(spark: SparkSession, d: str) -> DataFrame:
    from webloom.llm.warc import round_trip
    return round_trip(table(spark, d, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark: SparkSession, d: str) -> DataFrame:
    from webloom.llm.simhash import near_duplicates
    return near_duplicates(table(spark, d, "documents"))


def op3_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    from webloom.llm.decontaminate import decontaminate
    return decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    from webloom.llm.toxicity import toxicity
    return toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op5_preferences(spark: SparkSession, d: str) -> DataFrame:
    from webloom.llm.preferences import broken_off, format_preferences
    return format_preferences(*broken_off(table(spark, d, "conversations")))


def op6_secrets(spark: SparkSession, d: str) -> DataFrame:
    from webloom.llm.secrets import find_secrets
    return find_secrets(table(spark, d, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_markov")


def op7_quality(spark: SparkSession, d: str) -> DataFrame:
    from webloom.llm.quality import quality
    return quality(table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_repeats(spark: SparkSession, d: str) -> DataFrame:
    from webloom.llm.repeats import repeat_digests
    return repeat_digests(table(spark, d, "documents"))


def op9_packing(spark: SparkSession, d: str) -> DataFrame:
    from webloom.llm.packing import pack_documents
    return pack_documents(table(spark, d, "documents"))


def op10_tokencount(spark: SparkSession, d: str) -> DataFrame:
    """Trees of all documents, and three edits of each that come from its own text."""
    from webloom.llm.tokencount import apply_edit_lists, build_trees
    trees = build_trees(table(spark, d, "documents"))
    n = F.coalesce(F.length("text"), F.lit(0))
    edits = [F.struct(F.pmod(F.xxhash64("doc_id", F.lit(3 * k)), n + 1).alias("pos"),
                      F.pmod(F.xxhash64("doc_id", F.lit(3 * k + 1)), F.lit(40)).alias("n_del"),
                      F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit(3 * k + 2)), n + 1) + 1).cast("int"),
                                  F.lit(30)).alias("ins")) for k in range(3)]
    return apply_edit_lists(trees, F.array(*edits)).select(
        "doc_id", "tokens_before", "n_edits", "n_tokens", F.length("text").alias("n_chars"),
        F.sha2(F.col("text"), 256).alias("text_sha256"), "reencoded_chars")


def op11_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    from webloom.llm.quality_model import quality_scores
    return quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


def op12_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    from webloom.llm.negatives import clean_rows, hard_negatives
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(clean_rows(table(spark, d, "embeddings"), "vec_id", label, "embedding"), F.col("id") % 100 == 0)


def op13_collocations(spark: SparkSession, d: str) -> DataFrame:
    from webloom.llm.phrases import collocations
    return collocations(table(spark, d, "documents"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, d)


QUERIES = {
    "pipeline": pipeline,
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_preferences": op5_preferences,
    "op6_secrets": op6_secrets,
    "op7_quality": op7_quality,
    "op8_repeats": op8_repeats,
    "op9_packing": op9_packing,
    "op10_tokencount": op10_tokencount,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}
