"""How much more frequent a value is inside a group than over all, and what marks each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_shares(df: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, value, n, share)``: shares of a group's rows in percent."""
    n = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return n.withColumn("share", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def lifts(inside: DataFrame, group: str, value: str, document: str) -> DataFrame:
    """``(group, value, n_docs, group_docs, lift)``: share of a group's documents with the value over the share of all with it.

    ``inside`` holds one row for each document and value; documents and values repeat freely.
    """
    rows = inside.select(group, value, document).where(F.col(value).isNotNull()).distinct()
    n = rows.groupBy(group, value).agg(F.count("*").alias("n_docs"))
    per_group = inside.groupBy(group).agg(F.count_distinct(document).alias("group_docs"))
    overall = rows.select(value, document).distinct().groupBy(value).agg(F.count("*").alias("all_n"))
    every = inside.agg(F.count_distinct(document).alias("all_docs"))
    joined = n.join(per_group, group).join(overall, value).join(F.broadcast(every))  # one row
    return joined.select(group, value, "n_docs", "group_docs", ((F.col("n_docs") / F.col("group_docs")) / (F.col("all_n") / F.col("all_docs"))).alias("lift"))


def signatures(lifted: DataFrame, group: str, value: str, least: int, least_lift: float, k: int, fallback_k: int) -> DataFrame:
    """The ``k`` values of the largest lift among those frequent and marked enough; else the ``fallback_k`` largest of all."""
    order = (F.desc("lift"), F.desc("n_docs"), F.col(value))
    marked = (F.col("n_docs") >= least) & (F.col("lift") >= least_lift)
    rows = lifted.withColumn("marked", marked).withColumn("any_marked", F.max("marked").over(Window.partitionBy(group)))
    kept = rows.where(F.col("marked") | ~F.col("any_marked")).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return kept.where(F.col("rank") <= F.when(F.col("any_marked"), k).otherwise(fallback_k)).select(group, value, "n_docs", "lift", "rank")


def contrast(df: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, value, share, lift)``: each group's most frequent value, its share in percent, and that over its share of all rows."""
    rows = df.where(F.col(value).isNotNull())
    n = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    total = n.groupBy(value).agg(F.sum("n").alias("all_n"))
    every = rows.agg(F.count("*").alias("every"))
    top = n.withColumn("size", F.sum("n").over(Window.partitionBy(group))).withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))).where("r = 1")
    return top.join(total, value).join(F.broadcast(every)).select(group, value, (100 * F.col("n") / F.col("size")).alias("share"), ((F.col("n") / F.col("size")) / (F.col("all_n") / F.col("every"))).alias("lift"))  # every: one row


def composition(df: DataFrame, group: str, document: str, value: str, k: int) -> DataFrame:
    """``(group, value, n, rank)``: the ``k`` values found in most of a group's documents, each counted once a document; ties by value."""
    n = df.where(F.col(value).isNotNull()).select(group, document, value).distinct().groupBy(group, value).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))).where(F.col("rank") <= k)


def heatmap(lifted: DataFrame, group: str, value: str, least: int, each: int, most_values: int, ceiling: float) -> DataFrame:
    """``(group, value, lift)`` for every group and the ``most_values`` values that stand first in any group: lift up to ``ceiling``, 0 if the group lacks it.

    Values come from the ``each`` largest lifts of every group among those found ``least`` times; of equal rank the larger lift, then the smaller value goes first.
    """
    ranked = lifted.where(F.col("n_docs") >= least).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("lift"), value))).where(F.col("rank") <= each)
    chosen = ranked.groupBy(value).agg(F.min(F.struct("rank", -F.col("lift"))).alias("place")).orderBy("place", value).limit(most_values).select(value)
    cells = lifted.select(group).distinct().crossJoin(F.broadcast(chosen))  # most_values rows
    return cells.join(lifted.select(group, value, "lift"), [group, value], "left").select(group, value, F.least(F.coalesce("lift", F.lit(0.0)), F.lit(ceiling)).alias("lift"))


def profiles(documents: DataFrame, sizes: DataFrame, group: str, domain: str, country: str, least: int = 20) -> DataFrame:
    """``(group, members, papers, international, mean_year, papers_per_member, domain, domain_lift, country, country_lift, specificity)``.

    ``documents``: a row for each group and document with ``domain``, ``year`` and the array ``country``; ``sizes``: group, members. A lift is the share of
    the group's documents with its most frequent value over the share of all documents, for countries over the share of all mentions.
    Groups of fewer than ``least`` documents are left out.
    """
    base = documents.groupBy(group).agg(
        F.count("*").alias("papers"), F.round(100.0 * F.avg(F.when(F.size(country) > 1, 1.0).otherwise(0.0)), 1).alias("international"), F.avg("year").cast("int").alias("mean_year")
    ).where(F.col("papers") >= least)
    once = documents.dropDuplicates(["document"])

    def leading(inside: DataFrame, universe: DataFrame, value: str) -> DataFrame:
        n = inside.groupBy(group, value).agg(F.count("*").alias("n"))
        top = n.groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct("n", F.lit(0) - F.xxhash64(value))).alias("t")).select(group, f"t.{value}", "t.n")
        every = universe.groupBy(value).agg(F.count("*").alias("all_n"))
        total = universe.agg(F.count("*").alias("total"))
        lifted = top.join(every, value).join(F.broadcast(total)).join(base.select(group, "papers"), group)  # total: one row
        return lifted.select(group, value, ((F.col("n") / F.col("papers")) / (F.col("all_n") / F.col("total"))).alias(f"{value}_lift"))

    named = leading(documents.where(F.col(domain).isNotNull()), once.where(F.col(domain).isNotNull()), domain)
    spread = lambda df: df.select(*(c for c in df.columns if c != country), F.explode(country).alias(country))
    located = leading(spread(documents), spread(once), country)
    joined = base.join(sizes, group).join(named, group, "left").join(located, group, "left")
    return joined.select(
        group, "members", "papers", "international", "mean_year", F.round(F.col("papers") / F.col("members"), 2).alias("papers_per_member"), domain, F.round(f"{domain}_lift", 2).alias("domain_lift"),
        country, F.round(f"{country}_lift", 2).alias("country_lift"), F.round(F.col(f"{domain}_lift") * F.col(f"{country}_lift"), 2).alias("specificity"),
    )
