"""The relationship graph: size, components, centrality.

Edges are a relation (src, dst). Nothing is pulled to the driver but the answer to
"did anything change"; each round is written to the shared checkpoint folder, so a
lost executor costs one round and the plan does not grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def edges(fks: DataFrame) -> DataFrame:
    """Distinct directed table pairs; parallel foreign keys are one edge."""
    return fks.select(F.col("child_table").alias("src"), F.col("parent_table").alias("dst")
                      ).distinct()


def undirected(edge: DataFrame) -> DataFrame:
    """Each edge in both directions, without loops and duplicates."""
    kept = edge.where(F.col("src") != F.col("dst"))
    return kept.select("src", "dst").union(kept.select(F.col("dst"), F.col("src"))).distinct()


def connected_components(nodes: DataFrame, edge: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node name reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every node
    hands its neighbours the smallest name it knows. The number of rounds grows with
    the logarithm of the graph, not with its diameter, and both steps are a grouped
    minimum and an equi join.
    """
    star = cut_lineage(undirected(edge).where(F.col("src") > F.col("dst")))
    while True:
        star = cut_lineage(_small_star(_large_star(star)))
        if _is_star_forest(star):
            break
    return nodes.select("node").distinct().join(star.withColumnRenamed("src", "node"), "node",
                                                "left").select(
        "node", F.coalesce("dst", "node").alias("component"))


def _attach_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest of u and its listed neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def _large_star(star: DataFrame) -> DataFrame:
    both = star.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(
        star.select(F.col("dst"), F.col("src")))
    return (_attach_minimum(both).where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
            .select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct())


def _small_star(star: DataFrame) -> DataFrame:
    down = star.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    linked = _attach_minimum(down)
    to_min = linked.select(F.col("v").alias("src"), F.col("m").alias("dst"))
    own = linked.select(F.col("u").alias("src"), F.col("m").alias("dst"))
    return to_min.union(own).where(F.col("src") != F.col("dst")).distinct()


def _is_star_forest(star: DataFrame) -> bool:
    """True when every node points at one centre and no centre points anywhere."""
    doubled = star.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chained = star.join(star.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return doubled.isEmpty() and chained.isEmpty()


def graph_metrics(nodes: DataFrame, edge: DataFrame) -> DataFrame:
    """Nodes, edges, components, connectedness, density and hub in one row."""
    parts = connected_components(nodes, edge)
    n = parts.agg(F.count(F.lit(1)).alias("total_nodes"),
                  F.count_distinct("component").alias("connected_components"),
                  F.lit(1).alias("k"))
    m = edge.agg(F.count(F.lit(1)).alias("total_edges"), F.lit(1).alias("k"))
    top = hub(degree_centrality(nodes, edge)).withColumn("k", F.lit(1))
    nodes_d = F.col("total_nodes").cast("double")
    return n.join(m, "k").join(top, "k", "left").select(
        "total_nodes", "total_edges", "connected_components",
        (F.col("connected_components") == 1).alias("is_connected"),
        F.when(F.col("total_nodes") > 1, F.round(F.col("total_edges") / (
            nodes_d * (nodes_d - 1)), 4)).otherwise(F.lit(0.0)).alias("density"),
        "hub_table", "hub_degree")


def degree_centrality(nodes: DataFrame, edge: DataFrame) -> DataFrame:
    """Undirected degree over n - 1; a loop counts twice, a lone node scores 1."""
    ends = undirected(edge).select(F.col("src").alias("node"), F.lit(1).alias("w"))
    loops = edge.where(F.col("src") == F.col("dst")).select(
        F.col("src").alias("node"), F.lit(2).alias("w")).distinct()
    degree = ends.unionByName(loops).groupBy("node").agg(F.sum("w").alias("degree"))
    all_nodes = nodes.select("node").distinct()
    n = all_nodes.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("k"))
    counted = all_nodes.join(degree, "node", "left").withColumn("k", F.lit(1))
    value = F.coalesce("degree", F.lit(0))
    # `n` is a single row by construction
    return counted.join(F.broadcast(n), "k").select(
        "node", value.cast("bigint").alias("degree"),
        F.when(F.col("n") > 1, value / (F.col("n") - 1)).otherwise(F.lit(1.0)).alias("centrality"))


def hub(centrality: DataFrame) -> DataFrame:
    """The most central node, first name among equals."""
    return centrality.orderBy(F.col("centrality").desc(), "node").limit(1).select(
        F.col("node").alias("hub_table"), F.round("centrality", 4).alias("hub_degree"))


def isolated(nodes: DataFrame, edge: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edge.select(F.col("src").alias("node")).union(edge.select("dst"))
    return nodes.select("node").distinct().join(ends, "node", "left_anti")


def betweenness(nodes: DataFrame, edge: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Normalised betweenness centrality on the undirected graph (Brandes, 2001).

    All searches advance together, one level per round: (source, node, distance, number
    of shortest paths). Dependencies are then summed from the outermost level inwards.
    `sources` restricts the searches for an estimate; with all nodes the result is exact.
    """
    link = cut_lineage(undirected(edge))
    all_nodes = cut_lineage(nodes.select("node").distinct())
    n = all_nodes.count()
    start = all_nodes if sources is None else sources.select("node").distinct()
    frontier = start.select(F.col("node").alias("s"), "node", F.lit(0).alias("dist"),
                            F.lit(1.0).alias("paths"))
    reached = cut_lineage(frontier)
    frontier = reached
    depth = 0
    while True:
        step = (frontier.join(link, frontier["node"] == link["src"])
                .groupBy("s", F.col("dst").alias("node"))
                .agg(F.sum("paths").alias("paths"))
                .join(reached.select("s", "node"), ["s", "node"], "left_anti")
                .select("s", "node", F.lit(depth + 1).alias("dist"), "paths"))
        step = cut_lineage(step)
        if step.isEmpty():
            break
        depth += 1
        reached = cut_lineage(reached.unionByName(step))
        frontier = step

    dependency = None
    for level in range(depth, 0, -1):
        here = reached.where(F.col("dist") == level)
        if dependency is None:
            weighted = here.withColumn("delta", F.lit(0.0))
            total = weighted.select("s", "node", "delta")
        else:
            weighted = here.join(dependency, ["s", "node"], "left").withColumn(
                "delta", F.coalesce("delta", F.lit(0.0)))
            total = total.unionByName(weighted.select("s", "node", "delta"))
        parents = reached.where(F.col("dist") == level - 1).select(
            "s", F.col("node").alias("src"), F.col("paths").alias("parent_paths"))
        dependency = cut_lineage(
            weighted.join(link.select("src", F.col("dst").alias("node")), "node")
            .join(parents, ["s", "src"])
            .groupBy("s", F.col("src").alias("node"))
            .agg(F.sum(F.col("parent_paths") / F.col("paths") * (F.lit(1.0) + F.col("delta")))
                 .alias("delta")))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    if dependency is None:
        return all_nodes.select("node", F.lit(0.0).alias("betweenness"))
    sums = total.groupBy("node").agg(F.sum("delta").alias("d"))
    return all_nodes.join(sums, "node", "left").select(
        "node", (F.coalesce("d", F.lit(0.0)) * F.lit(scale)).alias("betweenness"))
