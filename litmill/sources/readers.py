"""Readers with declared schemas; nothing is inferred, malformed lines are dropped or kept apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from litmill.sources.writers import restore_table


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table, only the named columns of it."""
    restore_table(spark, path)
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType, malformed: str = "drop", parts: int | None = None) -> DataFrame:
    """JSON lines, plain or gzip. ``malformed`` lines are dropped, or kept with the text in ``_corrupt_record`` ("keep").

    Gzip files can't be split, so ``parts`` spreads what one task read.
    """
    if malformed == "keep":
        declared = schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " ")
        df = spark.read.schema(f"{declared}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    else:
        df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.repartition(parts) if parts else df


def read_cache(spark: SparkSession, path: str, record: str) -> DataFrame:
    """``(key, record columns)`` of files that hold one JSON object from keys to records; an empty record is a known miss."""
    whole = spark.read.option("wholetext", True).text(path)
    pairs = whole.select(F.explode(F.from_json("value", f"map<string,struct<{record}>>")).alias("key", "record"))
    return pairs.select("key", "record.*")


LEDGER = "stage string, step string, removed bigint, remaining bigint, pct_removed double, csv string, note string"


def read_ledger(spark: SparkSession, path: str, own_stage: str | None = None, schema: str = LEDGER) -> DataFrame:
    """A ledger written as CSV with a header, without the lines of the stage that is about to write its own anew."""
    df = spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return df.where(~F.col("stage").eqNullSafe(F.lit(own_stage))) if own_stage else df


def read_xml(spark: SparkSession, path: str, tags: Sequence[str], schema: str | StructType) -> DataFrame:
    """Records of several tags, one read for each, with the tag in ``type``; plain or gzip."""
    out = None
    for tag in tags:
        part = spark.read.format("xml").option("rowTag", tag).option("mode", "DROPMALFORMED").schema(schema).load(path).withColumn("type", F.lit(tag))
        out = part if out is None else out.unionByName(part)
    return out


def any_of(field: str, values: Sequence[str]) -> str:
    """A search expression: the values, quoted where they hold a blank, hyphen or stop, joined by OR."""
    quoted = (f'"{v}"' if any(c in v for c in " -.") else v for v in values)
    return f"{field}=({' OR '.join(quoted)})"


def none_of(expression: str, field: str, values: Sequence[str]) -> str:
    """The expression without what any of the values finds; itself where there are none."""
    return f"{expression} NOT {any_of(field, values)}" if values else expression
