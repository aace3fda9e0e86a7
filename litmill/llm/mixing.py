"""Combine documents by source so that each source reaches its target share of all tokens.

Every document of a mix draws a uniform number from a hash of mix, document and seed. Inverting the Poisson distribution
at that number gives how often the document is taken at a given mean rate, at most the cap; a higher rate never takes it
less often. So for each document the rates at which it is taken once more are known, tokens are summed over bins of the
rate (a table of bounded size), and the rate of each source is read off where its tokens meet the target. Rows are then
exploded by their count and shuffled by hash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litmill.session import materialize


@dataclass(frozen=True)
class MixConfig:
    """``tokenizer``: a vocabulary file in the format of byte pairs and ranks. ``seed``: another seed takes other documents.
    ``bins``: steps of the rate between ``least_rate`` and ``most_rate``, evenly spaced in its logarithm; the error of a
    share is at most one step, or one document."""

    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    seed: int = 7
    bins: int = 16384
    least_rate: float = 1e-6
    most_rate: float = 60.0


@cache
def _encoder(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, tokenizer: str = MixConfig.tokenizer) -> DataFrame:
    """Columns ``keep`` and ``n_tokens``, the tokens of the whole text; 0 for null and empty ones."""
    keep = keep if keep is not None else [c for c in df.columns if c != text_col]
    source = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(_encoder(SparkFiles.get(Path(tokenizer).name)).encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["row", "n_tokens"])

    df.sparkSession.sparkContext.addFile(tokenizer)  # the executors need not have it
    counted = source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, n_tokens bigint")
    return counted.select(*(F.col(f"row.`{c}`").alias(c) for c in keep), "n_tokens")


def poisson_table(config: MixConfig, most: int) -> np.ndarray:
    """For k = 1 .. most (rows) and each bin of the rate (columns), the chance of fewer than k; it falls along the bins."""
    rates = np.geomspace(config.least_rate, config.most_rate, config.bins)
    term, total, rows = np.exp(-rates), np.zeros_like(rates), []
    for k in range(most):
        total = total + term
        rows.append(np.minimum(total, 1.0))
        term = term * rates / (k + 1)
    return np.array(rows).reshape(most, config.bins)


def _with_bins(df: DataFrame, config: MixConfig) -> DataFrame:
    """Adds ``bins``: for k = 1 .. max_repeats the bin of the rate from which the document is taken k times or more.

    The last bin stands for every higher rate, so a source whose target needs the cap reaches it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            caps = np.array(batch.column("max_repeats").to_pylist(), np.int64)
            draws = np.array(batch.column("draw").to_pylist(), np.float64)
            most = int(caps.max(initial=0))
            if table is None or len(table) < most:
                table = poisson_table(config, most)
            # taken k times or more while the chance of fewer is not above the draw; rows fall, so search them reversed
            at = np.stack([config.bins - np.searchsorted(row[::-1], draws, side="right") for row in table[:most]]) if most else np.zeros((0, len(caps)), int)
            at = np.minimum(at, config.bins - 1)
            bins = [at[:c, i].tolist() for i, c in enumerate(caps)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names), pa.array(bins, pa.list_(pa.int32()))], names=[*batch.schema.names, "bins"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{ddl}, bins array<int>")


@dataclass(frozen=True)
class Mix:
    """``rows``: mix_id, document, source, copy_no, n_tokens, shuffled. ``shares``: the report, one row for each target."""

    rows: DataFrame
    shares: DataFrame


def mix_sources(documents: DataFrame, targets: DataFrame, config: MixConfig = MixConfig(), id_col: str = "doc_id") -> Mix:
    """Mixes of the largest size at which every source can still reach its share under its cap.

    ``targets``: mix_id, source, target_share, max_repeats; repeated rows of a mix and source count once (their largest
    share and cap), rows with a null, a share not above 0 or a cap below 1 are reported and take nothing. A source without
    documents can't contribute; its actual share is 0 and the other sources keep their proportions. Documents without
    source or without tokens are never taken; repeated documents (same id) are all taken alike. Nothing else is dropped.
    """
    sizes = materialize(token_counts(documents, keep=[id_col, "source"], tokenizer=config.tokenizer).where("n_tokens > 0").withColumnRenamed(id_col, "_doc"), "tokens")
    wanted = targets.groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    usable = wanted.where("target_share > 0 and max_repeats >= 1 and source is not null and mix_id is not null")
    held = sizes.groupBy("source").agg(F.sum("n_tokens").alias("held_tokens"))
    each = Window.partitionBy("mix_id")
    plan = (
        usable.join(held, "source")
        .withColumn("mix_tokens", F.min(F.col("max_repeats") * F.col("held_tokens") / F.col("target_share")).over(each))
        .withColumn("goal", F.col("mix_tokens") * F.col("target_share"))
    )
    plan = materialize(plan, "plan")  # a row for each target
    drawn = (
        sizes.join(plan.select("mix_id", "source", "max_repeats"), "source")
        .withColumn("draw", (F.pmod(F.xxhash64(F.lit(config.seed), "mix_id", "_doc"), F.lit(1 << 53)) + 0.5) / float(1 << 53))
    )
    binned = materialize(_with_bins(drawn.select("mix_id", "_doc", "source", "n_tokens", "max_repeats", "draw"), config).drop("draw", "max_repeats"), "bins")
    tokens = binned.select("mix_id", "source", "n_tokens", F.explode("bins").alias("bin")).groupBy("mix_id", "source", "bin").agg(F.sum("n_tokens").alias("tokens"))
    rising = Window.partitionBy("mix_id", "source").orderBy("bin")
    reached = tokens.withColumn("reached", F.sum("tokens").over(rising)).join(plan.select("mix_id", "source", "goal"), ["mix_id", "source"])
    chosen = reached.groupBy("mix_id", "source").agg(F.min_by(F.struct("bin", "reached"), F.struct(F.abs(F.col("reached") - F.col("goal")), "bin")).alias("at"))
    chosen = materialize(chosen.select("mix_id", "source", F.when(F.col("at.reached") > 0, F.col("at.bin")).alias("rate_bin"), F.col("at.reached").alias("actual_tokens")), "rates")
    taken = binned.join(chosen.select("mix_id", "source", "rate_bin"), ["mix_id", "source"]).withColumn("copies", F.size(F.filter("bins", lambda b: b <= F.col("rate_bin"))))
    rows = (
        taken.where("copies > 0")
        .select("mix_id", "_doc", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
        .withColumn("place", F.xxhash64(F.lit(config.seed + 1), "mix_id", "_doc", "copy_no"))
    )
    shuffled = rows.repartition("place").sortWithinPartitions("place").withColumnRenamed("_doc", id_col)
    actual = wanted.join(chosen, ["mix_id", "source"], "left").join(plan.select("mix_id", "source", "held_tokens", "goal"), ["mix_id", "source"], "left")
    shares = actual.select(
        "mix_id", "source", "target_share", "max_repeats",
        F.coalesce("held_tokens", F.lit(0)).alias("held_tokens"),
        F.coalesce("actual_tokens", F.lit(0)).alias("actual_tokens"),
        F.coalesce(F.try_divide("actual_tokens", F.sum("actual_tokens").over(each)), F.lit(0.0)).alias("actual_share"),
    )
    return Mix(shuffled, shares)
