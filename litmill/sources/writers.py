"""Writers: a table is written beside the old one and takes its place when it is whole."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str, keep_backup: bool = True) -> None:
    """Write ``df`` to ``path`` whole or not at all; ``df`` may read the table that it replaces.

    The first table replaced stays as ``path.bak`` and is never overwritten. If the job dies between taking the old table away
    and putting the new one in its place, ``restore_table`` (called here and by ``read_table``) ends what was begun.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    restore_table(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    (here, fs), (new, _), (old, _), (bak, _) = (_path(spark, p) for p in (path, f"{path}.new", f"{path}.old", f"{path}.bak"))
    if fs.exists(here):
        keep = keep_backup and not fs.exists(bak)
        fs.rename(here, bak if keep else old)
    fs.rename(new, here)
    fs.delete(old, True)


def restore_table(spark: SparkSession, path: str) -> bool:
    """Put the new table in place where a replacement broke off between its two renames; else leave everything as it is."""
    path = path.rstrip("/")
    (here, fs), (new, _), (done, _) = _path(spark, path), _path(spark, f"{path}.new"), _path(spark, f"{path}.new/_SUCCESS")
    (old, _), (bak, _) = _path(spark, f"{path}.old"), _path(spark, f"{path}.bak")
    if fs.exists(here) or not fs.exists(done) or not (fs.exists(old) or fs.exists(bak)):
        return False
    fs.rename(new, here)
    fs.delete(old, True)
    return True


def write_audit(df: DataFrame, path: str, columns: Sequence[str]) -> bool:
    """Rows taken out, as CSV with a header, only the columns they have; nothing is written for no rows."""
    kept = df.select(*(c for c in columns if c in df.columns))
    if kept.isEmpty():
        return False
    kept.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return True


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


@dataclass
class Report:
    """A report in Markdown, section by section, from small tables."""

    lines: list[str] = field(default_factory=list)

    def add(self, title: str, df: DataFrame, most: int = 200) -> Report:
        """A section with the first rows of a small table; where there are more, the last line says so."""
        self.lines += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        rows = df.limit(most + 1).collect()
        self.lines += ["| " + " | ".join(str(v) for v in row) + " |" for row in rows[:most]] + ([f"More than {most} rows."] if len(rows) > most else []) + [""]
        return self

    def text(self) -> str:
        return "\n".join(self.lines)
