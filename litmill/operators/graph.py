"""Co-authorship and other graphs as edge tables ``(source, target, weight)``, source < target."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmill.operators.components import connected_components
from litmill.operators.ranking import cumulative_first_seen
from litmill.session import materialize


def position_weight(position: Column, n: Column) -> Column:
    """Weight of an author's place among ``n``: first 1, last 0.75, second 0.6, others 0.35; alone 1."""
    # The weights.
    return F.when((n <= 1) | (position == 1), 1.0).when(position == n, 0.75).when(position == 2, 0.6).otherwise(0.35)


def paired(df: DataFrame, members: str, weighted: bool = True, *keep: str) -> DataFrame:
    """``(keep, source, target, w)``: a row for each pair of members of each row's list, source < target.

    The list is first exploded by its earlier member, so no cell ever holds more than one list.
    """
    n = F.size("_m")
    place = lambda k: position_weight(k, n) if weighted else F.lit(1.0)
    one = df.where(F.size(members) >= 2).select(*keep, F.col(members).alias("_m")).select(*keep, "_m", F.posexplode("_m").alias("_i", "_x"))
    two = one.where(F.col("_i") < n - 1).select(*keep, "_i", "_x", n.alias("_n"), F.posexplode(F.slice("_m", F.col("_i") + 2, n)).alias("_k", "_y"))
    n = F.col("_n")
    weight = place(F.col("_i") + 1) * place(F.col("_i") + 2 + F.col("_k"))
    return two.select(*keep, F.least("_x", "_y").alias("source"), F.greatest("_x", "_y").alias("target"), weight.alias("w"))


def pair_edges(df: DataFrame, members: str, weighted: bool = True) -> DataFrame:
    """Edges between the members of each row's list, weights (of both places, multiplied, or 1) summed over the rows.

    The lists hold each member once; lists of fewer than two give nothing. ``papers`` counts the rows of an edge.
    """
    return paired(df, members, weighted).groupBy("source", "target").agg(F.sum("w").alias("weight"), F.count("*").alias("papers"))


def paper_weight(n: Column) -> Column:
    """Weight of a paper by its number of countries: up to three 1.25, up to six 1.15, more 1."""
    return F.when(n <= 3, 1.25).when(n <= 6, 1.15).otherwise(1.0)


def documents_of(partition: DataFrame, authors: DataFrame, scope: DataFrame, document: str = "rec_id") -> DataFrame:
    """``(community, document)``, each once: documents in ``scope`` that any member of the community has written.

    ``partition``: node, community; ``authors``: document, node; ``scope``: document.
    """
    return authors.join(scope.select(document), document, "left_semi").join(partition.select("node", "community"), "node").select("community", document).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree, weighted_degree)``."""
    ends = edges.select(F.col("source").alias("node"), "weight").unionByName(edges.select(F.col("target").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def density(edges: DataFrame) -> DataFrame:
    """``(nodes, edges, density)``."""
    n = degrees(edges).agg(F.count("*").alias("nodes"))
    m = edges.agg(F.count("*").alias("edges"))
    return n.join(m).select("nodes", "edges", F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0).alias("density"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)``."""
    return connected_components(edges, "source", "target").withColumnRenamed("id", "node")


def clustering(edges: DataFrame) -> DataFrame:
    """``(node, triangles, coefficient)``; nodes of degree below two have 0.

    Each edge points to its end of higher degree, so the lists that are joined to open pairs stay short at hubs.
    """
    degree = degrees(edges).select("node", "degree")
    e = edges.join(degree.withColumnsRenamed({"node": "source", "degree": "ds"}), "source").join(degree.withColumnsRenamed({"node": "target", "degree": "dt"}), "target")
    up = F.struct("ds", "source") < F.struct("dt", "target")
    arcs = materialize(e.select(F.when(up, F.col("source")).otherwise(F.col("target")).alias("a"), F.when(up, F.col("target")).otherwise(F.col("source")).alias("b")), "arcs")
    open_pairs = arcs.join(arcs.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = open_pairs.join(edges.select(F.col("source").alias("b"), F.col("target").alias("c")), ["b", "c"])
    corners = closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    joined = degree.join(corners, "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return joined.select("node", "triangles", F.when(F.col("degree") >= 2, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("coefficient"))


def pruned(edges: DataFrame, least_degree: int) -> DataFrame:
    """Edges between nodes of at least this degree, measured once, before anything is removed."""
    keep = degrees(edges).where(F.col("degree") >= least_degree).select("node")
    return edges.join(keep.withColumnRenamed("node", "source"), "source", "left_semi").join(keep.withColumnRenamed("node", "target"), "target", "left_semi")


def heavy_edges(edges: DataFrame, percentile: float) -> DataFrame:
    """Edges whose weight is at or above this percentile (interpolated)."""
    bound = edges.agg(F.percentile("weight", F.lit(percentile)).alias("bound"))
    return edges.join(F.broadcast(bound)).where(F.col("weight") >= F.col("bound")).drop("bound")  # one row


def communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """``(node, community)`` by label propagation: each round a node takes the label with the largest weight around it, its own
    counting one more than its heaviest edge lets others count; ties go to the smaller label. Deterministic.

    The partition differs from one that maximises modularity node by node; compare them by ``modularity``.
    """
    both = materialize(edges.select("source", "target", "weight").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight")), "arcs")
    labels = materialize(both.select(F.col("source").alias("node")).distinct().withColumn("community", F.col("node")), "labels")
    for _ in range(rounds):
        votes = both.join(labels.withColumnsRenamed({"node": "target"}), "target").groupBy("source", "community").agg(F.sum("weight").alias("w"))
        own = labels.join(both.groupBy(F.col("source").alias("node")).agg(F.max("weight").alias("w")), "node").select(F.col("node").alias("source"), "community", F.col("w") * 0.5)
        total = votes.unionByName(own.toDF("source", "community", "w")).groupBy("source", "community").agg(F.sum("w").alias("w"))
        best = total.groupBy("source").agg(F.min_by("community", F.struct(-F.round("w", 9), "community")).alias("community"))
        labels = materialize(best.withColumnRenamed("source", "node"), "labels")
    return labels


def modularity(edges: DataFrame, partition: DataFrame, weighted: bool = True) -> DataFrame:
    """``(modularity)`` of a partition ``(node, community)``."""
    w = F.col("weight") if weighted else F.lit(1.0)
    side = lambda end, name: partition.select(F.col("node").alias(end), F.col("community").alias(name))
    e = edges.withColumn("w", w).join(side("source", "cs"), "source").join(side("target", "ct"), "target")
    inside = e.where("cs = ct").groupBy(F.col("cs").alias("c")).agg(F.sum("w").alias("inside"))
    touch = e.select(F.explode(F.array("cs", "ct")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("d"))
    m = edges.agg(F.sum(w).alias("m"))
    joined = touch.join(inside, "c", "left").join(F.broadcast(m))  # one row
    return joined.agg(F.round(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)), 9).alias("modularity"))


def growth(rows: DataFrame, period: str, members: str) -> DataFrame:
    """``(period, new_nodes, nodes, new_edges, edges, mean_degree, mean_weighted_degree, giant_share)`` of the graph of all rows
    up to each period. Nodes are members in a list, alone or not; means and the share of the largest component, in percent,
    are over the nodes that have an edge, null as long as there is none.

    Components grow period by period: the edges that are new in one join the components so far, and only those they touch
    are worked on again.
    """
    listed = materialize(rows.select(F.col(period).alias("period"), F.col(members).alias("names")), "listed")
    nodes = cumulative_first_seen(listed.select("period", F.explode("names").alias("n")), "n", "period").withColumnRenamed("new", "new_nodes").drop("total")
    met = paired(listed, "names", True, "period").withColumnsRenamed({"source": "s", "target": "t"})
    first = materialize(met.groupBy("s", "t").agg(F.min("period").alias("period")), "first")
    edges = first.groupBy("period").agg(F.count("*").alias("new_edges")).join(met.groupBy("period").agg(F.sum("w").alias("w")), "period", "full")
    table = nodes.join(edges, "period", "full").select("period", F.coalesce("new_nodes", F.lit(0)).alias("new_nodes"), F.coalesce("new_edges", F.lit(0)).alias("new_edges"), F.coalesce("w", F.lit(0.0)).alias("w"))
    label = sizes = None
    giants = []
    for year, _, found, _ in sorted(table.collect()):  # a row for each period
        if found:
            new = first.where(F.col("period") == F.lit(year)).select("s", "t")
            if label is None:
                links = new.select(F.col("s").alias("a"), F.col("t").alias("b"))
            else:
                named = lambda df, end, out: df.join(label.select(F.col("id").alias(end), F.col("component").alias(out)), end, "left").withColumn(out, F.coalesce(out, end))
                links = named(named(new, "s", "a"), "t", "b").select("a", "b")
            joined = materialize(connected_components(links, "a", "b"), "joined")
            fresh = new.select(F.explode(F.array("s", "t")).alias("id")).distinct()
            if label is not None:
                fresh = fresh.join(label.select("id"), "id", "left_anti")
            every = fresh.withColumn("component", F.col("id"))
            every = every if label is None else label.unionByName(every)
            moved = every.join(joined.select(F.col("id").alias("component"), F.col("component").alias("into")), "component", "left")
            label = materialize(moved.select("id", F.coalesce("into", "component").alias("component")), "label")
            sizes = tuple(label.groupBy("component").count().agg(F.sum("count"), F.max("count")).first())
        giants.append((year, *(sizes or (0, 0))))
    giant = rows.sparkSession.createDataFrame(giants, f"period {listed.schema['period'].dataType.simpleString()}, linked bigint, giant bigint")
    upto = Window.orderBy("period")  # a row for each period
    grown = table.join(giant, "period").withColumns({"nodes": F.sum("new_nodes").over(upto), "edges": F.sum("new_edges").over(upto), "w": F.sum("w").over(upto)})
    mean = lambda c: F.when(F.col("linked") > 0, 2 * F.col(c) / F.col("linked"))
    return grown.select(F.col("period").alias(period), "new_nodes", "nodes", "new_edges", "edges", F.round(mean("edges"), 6).alias("mean_degree"), F.round(mean("w"), 6).alias("mean_weighted_degree"), F.round(F.when(F.col("linked") > 0, 100 * F.col("giant") / F.col("linked")), 6).alias("giant_share"))


def partition_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(pairs_a, pairs_b, pairs_both, jaccard)`` of nodes put together by two partitions, from counts, without pairs."""
    both = a.select("node", F.col("community").alias("ca")).join(b.select("node", F.col("community").alias("cb")), "node")
    choose = lambda *keys: both.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))
    row = choose("ca").toDF("pairs_a").join(choose("cb").toDF("pairs_b")).join(choose("ca", "cb").toDF("pairs_both"))
    return row.withColumn("jaccard", F.col("pairs_both") / F.greatest(F.col("pairs_a") + F.col("pairs_b") - F.col("pairs_both"), F.lit(1)))


def eigenvector_centrality(edges: DataFrame, rounds: int = 25) -> DataFrame:
    """``(node, centrality)`` by power iteration on the weighted graph, scaled to unit length.

    Each node has a loop, which makes bipartite graphs converge; weights are divided by their sum, so nothing overflows.
    """
    arcs = edges.select("source", "target", "weight").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    total = arcs.agg(F.max("weight").alias("m"))
    loops = arcs.select("source").distinct().select("source", F.col("source").alias("target")).join(F.broadcast(total)).select("source", "target", F.col("m").alias("weight"))  # one row
    walk = materialize(arcs.unionByName(loops), "arcs")
    value = walk.select(F.col("source").alias("node")).distinct().withColumn("centrality", F.lit(1.0))
    for k in range(rounds):
        moved = walk.join(value.withColumnRenamed("node", "target"), "target").groupBy(F.col("source").alias("node")).agg(F.sum(F.col("weight") * F.col("centrality")).alias("centrality"))
        value = moved
        if k % 5 == 4 or k == rounds - 1:
            value = materialize(moved, "centrality")
            norm = value.agg(F.sqrt(F.sum(F.col("centrality") * F.col("centrality"))).alias("norm"))
            value = value.join(F.broadcast(norm)).select("node", (F.col("centrality") / F.col("norm")).alias("centrality"))  # one row
    return value


def betweenness(edges: DataFrame, sources: int = 200, most_edges: int = 2_000_000) -> DataFrame:
    """``(node, betweenness)`` from shortest paths out of the ``sources`` nodes first in hash order, unweighted, normalised.

    Paths need the whole graph, so it is for pruned graphs: more than ``most_edges`` edges are refused. The sources are
    worked in parallel, each task with a copy of the edges.
    """
    spark = edges.sparkSession
    if edges.count() > most_edges:
        raise ValueError(f"more than {most_edges} edges; prune the graph first")
    nodes = [r[0] for r in degrees(edges).select("node").orderBy("node").collect()]
    number = {x: i for i, x in enumerate(nodes)}
    arcs = [(number[s], number[t]) for s, t in edges.select("source", "target").collect()]
    neighbours: list[list[int]] = [[] for _ in nodes]
    for s, t in arcs:
        neighbours[s].append(t)
        neighbours[t].append(s)
    chosen = sorted(range(len(nodes)), key=lambda i: (hash((i * 2654435761) & 0xFFFFFFFF), i))[:sources]
    sent = spark.sparkContext.broadcast(neighbours)  # at most most_edges

    def run(batches):
        total = np.zeros(len(sent.value))
        for batch in batches:
            for s in batch["s"]:
                order, paths, level, before = [], {s: 1.0}, {s: 0}, {}
                queue = [s]
                for v in queue:
                    order.append(v)
                    for w in sent.value[v]:
                        if w not in level:
                            level[w], paths[w], before[w] = level[v] + 1, 0.0, []
                            queue.append(w)
                        if level[w] == level[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                share = dict.fromkeys(order, 0.0)
                for w in reversed(order[1:]):
                    for v in before[w]:
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    total[w] += share[w]
        used = np.flatnonzero(total)
        yield pd.DataFrame({"i": used, "x": total[used]})

    seeds = spark.createDataFrame([(int(i),) for i in chosen], "s int").repartition(max(1, min(len(chosen), spark.sparkContext.defaultParallelism)))
    summed = seeds.mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
    n = len(nodes)
    scale = (n / max(1, len(chosen))) / max(1, (n - 1) * (n - 2))
    names = spark.createDataFrame(list(enumerate(nodes)), "i int, node string")
    return names.join(summed, "i", "left").select("node", (F.coalesce("x", F.lit(0.0)) * scale).alias("betweenness"))
