"""An append-only log keyed by row: what counts, what is left to do, and the same over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_success(log: DataFrame, key: str = "row_index", order: tuple[str, ...] = ("logged_at", "received_at"), retry_failed: bool = False) -> DataFrame:
    """The last successful line of each key. A later failure changes nothing, unless ``retry_failed``: then it takes the key out.

    Lines repeated exactly count once; of lines at the same time the one with more tokens counts.
    """
    at = F.struct(*order, F.coalesce("total_tokens", F.lit(0)), F.coalesce("topic", F.lit("")))
    best = log.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(F.when(F.col("status") == "success", F.struct(at.alias("at"), F.struct(*(c for c in log.columns if c != key)).alias("row")))).alias("ok"),
        F.max(F.when(F.col("status") != "success", F.col(order[0]))).alias("failed_at"),
    )
    kept = best.where("ok is not null")
    if retry_failed:
        kept = kept.where(F.col("failed_at").isNull() | (F.col("failed_at") <= F.col(f"ok.at.{order[0]}")))
    return kept.select(key, "ok.row.*")


def pending(rows: DataFrame, done: DataFrame, key: str, done_key: str) -> DataFrame:
    """Rows without a done line."""
    return rows.join(done.select(F.col(done_key).alias(key)).distinct(), key, "left_anti")


def stale_share(rows: DataFrame, done: DataFrame, key: str, done_key: str, fingerprint: str) -> DataFrame:
    """``(n_matched, n_stale, stale_share)``: done lines whose fingerprint is no longer the row's. The caller decides on them."""
    joined = rows.select(F.col(key).alias(done_key), F.col(fingerprint).alias("_now")).join(done.select(done_key, fingerprint), done_key)
    stale = F.coalesce(F.sum(F.when(~F.coalesce("_now", F.lit("")).eqNullSafe(F.coalesce(fingerprint, F.lit(""))), 1)), F.lit(0))
    return joined.agg(F.count("*").alias("n_matched"), stale.alias("n_stale")).withColumn("stale_share", F.col("n_stale") / F.greatest("n_matched", F.lit(1)))


def discard_stale(done: DataFrame, report: DataFrame, most: float = 0.05) -> DataFrame:
    """The done lines, or none of them where more than this share is stale: rows then no longer stand at their places."""
    return done.join(F.broadcast(report.select((F.col("stale_share") > most).alias("_stale"))), F.lit(True)).where("not _stale").drop("_stale")  # one row


def current_progress(progress: DataFrame, version: str, version_col: str = "query_version") -> DataFrame:
    """Progress made under this version of a query; what another version fetched does not count."""
    return progress.where(F.col(version_col) == version)


def incomplete(progress: DataFrame, wanted: DataFrame, key: str, fetched: str = "fetched", total: str = "total") -> DataFrame:
    """``(key, next_row)`` of the wanted keys of which not all is fetched: unknown totals count as not done; the next row is after those fetched."""
    state = progress.groupBy(key).agg(F.max(fetched).alias("_f"), F.max(total).alias("_t"))
    joined = wanted.select(key).distinct().join(state, key, "left")
    return joined.where(F.col("_t").isNull() | (F.coalesce("_f", F.lit(0)) < F.col("_t"))).select(key, (F.coalesce("_f", F.lit(0)) + 1).alias("next_row"))


def log_rates(log: DataFrame, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Lines, failures and tokens for each window of the log's own time; over a stream, lines later than ``late`` are left out."""
    timed = log.withWatermark("logged_at", late) if log.isStreaming else log
    counted = timed.groupBy(F.window("logged_at", window).alias("w")).agg(
        F.count("*").alias("n_lines"), F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("n_failed"), F.sum(F.coalesce("total_tokens", F.lit(0)).cast("bigint")).alias("tokens")
    )
    return counted.select(F.col("w.start").alias("window_start"), "n_lines", "n_failed", "tokens")


def run_log_upserts(stream: DataFrame, table: str, checkpoint: str, key: str = "row_index"):
    """Start a query that keeps the last success of each key in the Parquet table ``table``.

    Each micro-batch is merged with the table and replaces it whole, so a batch that is repeated after a failure changes nothing.
    """
    from litmill.sources.writers import _path, replace_table

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        where, fs = _path(spark, table)
        both = batch.unionByName(spark.read.schema(batch.schema).parquet(table)) if fs.exists(where) else batch
        replace_table(last_success(both, key).select(*batch.columns), table, keep_backup=False)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
