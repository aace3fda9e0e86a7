"""Ranks, shares and top lists with ties decided by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litmill.session import materialize


def _below(counts: DataFrame, value: str, sums: dict) -> DataFrame:
    """``counts`` (distinct values) with the sums over all rows of a larger value, and over all rows as ``all_<name>``.

    Values are laid out by range and summed partition by partition; only a row for each partition is broadcast, and each
    partition is then summed by itself, so no task sees all values.
    """
    ranged = materialize(counts.repartitionByRange(F.desc(value)).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("_part").agg(*(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = parts.select("_part", *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums), *(F.sum(f"_s_{n}").over(Window.partitionBy()).alias(f"all_{n}") for n in sums))
    inside = Window.partitionBy("_part").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(offsets), "_part")
    return joined.select(*counts.columns, *((F.col(f"_o_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()), *(f"all_{n}" for n in sums))


def average_rank(df: DataFrame, value: str, out: str = "avg_rank") -> DataFrame:
    """Descending rank; equal values share the mean of their places. Values are counted first, so only distinct ones are ordered."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    above = _below(counts, value, {"_above": F.col("_n")})
    return df.join(above.select(value, (F.col("_above") + (F.col("_n") + 1) / 2).alias(out)), value, "left")


def concentration(df: DataFrame, value: str, share: float = 0.5) -> DataFrame:
    """``(n, total, k)``: how many of the largest values make up this share of the sum. Ordered are distinct values only."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    run = _below(counts, value, {"before_n": F.col("_n"), "before_s": F.col("_n") * F.col(value)})
    reached = run.where(F.col("before_s") < F.col("all_before_s") * share).withColumn("k", F.col("before_n") + F.least("_n", F.ceil((F.col("all_before_s") * share - F.col("before_s")) / F.col(value))))
    return reached.agg(F.max("all_before_n").alias("n"), F.max("all_before_s").alias("total"), F.max("k").alias("k"))


def top_in_group(df: DataFrame, group: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def top_percent(df: DataFrame, order: Sequence, percent: float, least: int) -> DataFrame:
    """The first rows up to a percentage of all, but at least so many."""
    k = max(least, int(df.count() * percent / 100))
    return df.orderBy(*order).limit(k)


def cumulative_first_seen(df: DataFrame, key: str, period: str) -> DataFrame:
    """``(period, new, total)``: keys by the period they appear first in, and their running number."""
    first = df.groupBy(key).agg(F.min(period).alias(period)).where(F.col(period).isNotNull())
    new = first.groupBy(period).agg(F.count("*").alias("new"))
    return new.withColumn("total", F.sum("new").over(Window.orderBy(period)))


def rank_shift(df: DataFrame, one: str, other: str, least: int = 1000) -> DataFrame:
    """``(n, shifted)``: rows, and those whose ranks by two values (descending, ties averaged) lie more than ``least`` places apart."""
    ranked = average_rank(average_rank(df, one, "_one"), other, "_other")
    return ranked.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("_one") - F.col("_other")) > least).alias("shifted"))


def first_rows(df: DataFrame, order: Sequence, limit: int | None) -> DataFrame:
    """The first rows in order; all of them without a limit."""
    return df if limit is None else df.orderBy(*order).limit(limit)
