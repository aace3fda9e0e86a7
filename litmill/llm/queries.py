"""The queries of the operators for training data: name -> query, and SQL for the same rows where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.llm import language, leakage, lookalike, mixing, neardup, quality, survivor, variants


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of records of one publication."""
    return neardup.group_pairs(neardup.publication_groups(table(spark, folder, "merged_literature")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of spellings of one person among the entries of name_key."""
    return variants.variant_pairs(variants.name_variants(variants.written_names(table(spark, folder, "master"))))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Names and institutions of master that are not in the ordinary form of their look."""
    return lookalike.odd_items(table(spark, folder, "master")).select("rec_id", "field_name", "item_pos")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """What survives of each group of records of one publication."""
    literature = table(spark, folder, "merged_literature")
    return survivor.survivors(literature, neardup.publication_groups(literature))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    literature = table(spark, folder, "merged_literature")
    filters = language.fit_filters(literature, "lang", ["title", "abstract"], "rec_id")
    return language.text_languages(literature, filters, "rec_id", ["title", "abstract"], "lang")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """All segments of the records whose label is missing, wrong, or not the only language."""
    return language.wrong_labels(_segments(spark, folder)).select("rec_id", "field_name", "seg_no", "lang")


def p6_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment of every record, with its confidence."""
    return _segments(spark, folder).withColumn("confidence", F.round("confidence", 4))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a third or more of a held-out item, with the item."""
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The spans to remove, one row for each."""
    found = leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.select("doc_id", "item_id", F.round("share", 6).alias("share"), F.posexplode("spans").alias("span_no", "span")).select(
        "doc_id", "item_id", "share", "span_no", F.col("span.start").alias("start_char"), F.col("span.end").alias("end_char")
    )


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of every mix, shuffled: which document, and which of its copies."""
    return mixing.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).rows


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source of every mix."""
    return mixing.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets")).shares


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents most of whose text is not natural prose."""
    return quality.nonprose(table(spark, folder, "documents"))


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every document, with the reasons of the rules that fired."""
    return quality.text_statistics(table(spark, folder, "documents")).withColumn("reasons", F.array_join("reasons", ","))


def p9_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Characters, words and lines of every document, those that SQL can count as well."""
    return quality.text_statistics(table(spark, folder, "documents")).select("doc_id", "n_chars", "n_words", "n_lines")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_segments": p6_segments, "p7_found": p7_found, "p7_spans": p7_spans, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_statistics": p9_statistics, "p9_counts": p9_counts}
SQL: dict[str, str] = {
    "p9_counts": r"""select doc_id, length(coalesce(text, '')) as n_chars, len(regexp_extract_all(coalesce(text, ''), '[^\s\p{Z}]+')) as n_words,
  len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}]'))) as n_lines from documents"""
}
