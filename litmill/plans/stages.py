"""Stages: merge records, clean them by rule with a ledger, normalise nested metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions import keys, labels, people
from litmill.operators import filters, merge


def merge_sources(df: DataFrame, order: str = "rec_id") -> DataFrame:
    """One record for each DOI, then one for each title among records without one; records with neither stay as they are.

    Records of one title without a DOI are first resolved by surnames: a representative keeps its own authors; then the
    representatives of a title are merged, and theirs are united.
    """
    columns = ["first_id", "n_merged", *merge.FIRST, *merge.UNITED, "times_cited"]
    by_doi = merge.doi_merge(df, order).select(F.col("merge_key").alias("doi"), *columns)
    loose = df.where(keys.doi_key(F.col("doi")) == "")
    titled = loose.where(keys.title_words_key(F.col("title")) != "")
    resolved = merge.absorbed(titled, representatives(titled, order), order)
    by_title = merge.title_merge(resolved, order).select(F.lit("").alias("doi"), *columns)
    alone = loose.where(keys.title_words_key(F.col("title")) == "").select(F.lit("").alias("doi"), F.col(order).alias("first_id"), F.lit(1).cast("bigint").alias("n_merged"), *merge.FIRST, *merge.UNITED, "times_cited")
    return by_doi.unionByName(by_title).unionByName(alone)


def representatives(df: DataFrame, order: str = "rec_id") -> DataFrame:
    """``(order, rep)`` of each record by title and surnames."""
    return merge.same_title_representatives(df, people.surnames(people.split_authors(F.col("authors"))), order)


@dataclass(frozen=True)
class CleanConfig:
    """``scope``: text that ``source`` must hold, "" for all. ``anchor``: words that keep a record without abstract, None drops them all."""

    scope: str = ""
    anchor: str | None = "agent[- ]based|individual[- ]based|multi[- ]?agent|simulation"
    drop_uncited: bool = False


def clean_steps(config: CleanConfig = CleanConfig()) -> list[tuple[str, Column]]:
    rescued = F.coalesce(F.col("title"), F.lit("")).rlike(f"(?i){config.anchor}") if config.anchor else F.lit(False)
    steps = [
        ("out of scope", ~F.contains(F.lower(F.coalesce("source", F.lit(""))), F.lit(config.scope))),
        ("title in another script", filters.foreign_script(F.col("title"))),
        ("document type", filters.dropped_type(F.col("doc_type"))),
        ("no abstract", filters.blank(F.col("abstract")) & ~rescued),
    ]
    return [*steps, ("not cited", F.coalesce("times_cited", F.lit(0)) == 0)] if config.drop_uncited else steps


def clean(df: DataFrame, config: CleanConfig = CleanConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The records kept (with ``abstract_missing``), those removed (with ``drop_reason``), and the ledger."""
    reason = F.lit(None).cast("string")
    for name, test in reversed(clean_steps(config)):
        reason = F.when(F.coalesce(test, F.lit(False)), name).otherwise(reason)
    judged = df.withColumn("drop_reason", reason)
    kept = judged.where("drop_reason is null").drop("drop_reason").withColumn("abstract_missing", filters.blank(F.col("abstract")))
    return kept, judged.where("drop_reason is not null"), filters.ledger(df, clean_steps(config))


def normalise(df: DataFrame) -> DataFrame:
    """``df`` with venue, document type, year, authors, places and key lists in one form."""
    persons = people.people(F.col("authors_std"))
    return df.withColumns(
        {
            "venue_name": keys.venue_name(F.col("journal"), F.col("venue")),
            "doc_type_std": labels.doc_type(F.col("doc_type")),
            "year_num": keys.number(F.col("year")),
            "authors_list": persons,
            "n_authors": F.size(persons),
            "first_author": people.first_author(persons),
            "corresponding": people.corresponding_author(persons),
            "has_orcid": people.any_orcid(persons),
            "name_key": F.array_join(people.name_keys(people.full_names(persons)), ";"),
            "countries": people.places(persons, "country"),
            "institutions": people.places(persons, "institution"),
            "keywords_list": people.json_list(F.col("keywords")),
            "mesh_list": people.json_list(F.col("mesh_terms")),
        }
    )
