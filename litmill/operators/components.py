"""Connected components by alternating large and small stars; the number of rounds grows with the logarithm of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.session import materialize


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every node of an edge; the component is its smallest node.

    Directions, loops and repeated edges don't matter; edges with a null end are left out, a node that only loops is its
    own component. Each round is written to the shared folder. Nothing but a checksum reaches the driver. Components that
    have not settled after ``most_rounds`` (far more than any size needs) are an error, never a result.
    """
    a, b = F.col(f"`{src}`"), F.col(f"`{dst}`")
    ends = edges.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    links = materialize(ends.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct(), "links")
    looped = links.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component"))
    current = links.where("src <> dst")
    before = _checksum(current)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
        current = materialize(small.unionByName(low.select("src", F.col("m").alias("dst"))).distinct(), "stars")
        after = _checksum(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    members = current.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    roots = current.select(F.col("dst").alias("id"), F.col("dst").alias("component"))
    return members.unionByName(roots).unionByName(looped).groupBy("id").agg(F.min("component").alias("component"))
