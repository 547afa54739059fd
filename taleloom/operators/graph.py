"""Undirected simple graphs as (nodes, edges): nodes(id, ord, frequency), edges(a, b, weight, ord)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taleloom.operators.components import connected_components
from taleloom.operators.ordering import numbered
from taleloom.sources.shared import written

#: Nodes up to which paths are walked for betweenness; above, it is the degree centrality. The cutoff is part of the result.
BETWEENNESS_NODES = 100


def build(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between known nodes, one (the first) for each unordered pair, with a drawing width."""
    known = nodes.select("id")
    rows = edges.join(known.toDF("a"), "a", "left_semi").join(known.toDF("b"), "b", "left_semi")
    first = W.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy("ord")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    return rows.withColumn("width", F.least(1 + F.ln(F.col("weight") + 1), F.lit(5.0)))


def node_size(frequency: Column) -> Column:
    return F.least(10 + 5 * F.ln(frequency + 1), F.lit(30.0))


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v): each edge from either end; a loop counts from both."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, centrality): centrality = degree / max(1, n - 1)."""
    counts = both_ways(edges).groupBy("u").agg(F.count("*").alias("degree"))
    n = nodes.agg(F.count("*").alias("n"))
    out = nodes.select("id").join(counts, F.col("id") == F.col("u"), "left").crossJoin(F.broadcast(n))  # one row
    out = out.withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return out.select("id", "degree", (F.col("degree") / F.greatest(F.lit(1), F.col("n") - 1)).alias("centrality"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n, m, density, average degree; zeros for an empty graph."""
    both = nodes.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("m")))  # one row each
    n, m = F.col("n"), F.col("m")
    return both.select("n", "m", F.when(n > 1, 2 * m / F.when(n > 1, n * (n - 1))).otherwise(0.0).alias("density"), F.when(n > 0, 2 * m / F.when(n > 0, n)).otherwise(0.0).alias("average_degree"))


def distances(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(source, id, distance) to every node that a breadth-first search reaches. A round extends all frontiers by
    one join and drops what was visited; it ends when no frontier is left. All pairs only suit small graphs; pass `sources` else."""
    links = both_ways(edges).distinct()
    frontier = (sources or nodes).select(F.col("id").alias("source"), "id").withColumn("distance", F.lit(0))
    seen = frontier = written(frontier)
    for step in range(1, 1 << 20):
        new = frontier.join(links, F.col("id") == F.col("u")).select("source", F.col("v").alias("id")).distinct()
        new = written(new.join(seen, ["source", "id"], "left_anti").withColumn("distance", F.lit(step)))
        if new.isEmpty():
            return seen
        seen, frontier = seen.unionByName(new), new
    return seen


def closeness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, closeness): (reached / (n - 1)) * (reached / sum of distances); 0 if nothing is reached."""
    sums = distances(nodes, edges).filter("distance > 0").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("r"), F.sum("distance").alias("total"))
    n = nodes.agg(F.count("*").alias("n"))
    out = nodes.select("id").join(sums, "id", "left").crossJoin(F.broadcast(n))  # one row
    return out.select("id", F.coalesce(F.col("r") / (F.col("n") - 1) * (F.col("r") / F.col("total")), F.lit(0.0)).alias("closeness"))


def path_betweenness(nodes: list[str], links: list[tuple[str, str]]) -> dict[str, float]:
    """Interior visits of one shortest path per ordered pair, over (n-1)(n-2)/2 (or 1). Neighbours go in the
    order of their ids, and a search's tree keeps the first way that reached a node."""
    order = sorted(nodes)
    near: dict[str, set[str]] = {x: set() for x in order}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    visits = dict.fromkeys(order, 0)
    for source in order:
        came, queue = {source: source}, [source]
        for x in queue:
            for y in sorted(near[x]):
                if y not in came:
                    came[y] = x
                    queue.append(y)
        for target in queue[1:]:
            x = came[target]
            while x != source:
                visits[x] += 1
                x = came[x]
    n = len(order)
    scale = (n - 1) * (n - 2) / 2 or 1
    return {x: v / scale for x, v in visits.items()}


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, betweenness). A graph of at most BETWEENNESS_NODES nodes goes to one task, whose input that bounds; a larger
    one gives degree centrality."""
    if len(nodes.select("id").limit(BETWEENNESS_NODES + 1).collect()) > BETWEENNESS_NODES:
        return degrees(nodes, edges).select("id", F.col("centrality").alias("betweenness"))
    rows = nodes.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(edges.select("a", "b"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        alone = pdf["b"].isna()
        got = path_betweenness(pdf[alone]["a"].tolist(), list(pdf[~alone][["a", "b"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"id": list(got), "betweenness": list(got.values())})

    return rows.withColumn("graph", F.lit(0)).groupBy("graph").applyInPandas(solve, "id string, betweenness double")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community): connected components, named community_0, community_1, ... by their first node's ord.
    A node without an edge is a component of its own."""
    ids = nodes.select("id", "ord")
    ends = edges.select("a", "b").join(ids.select(F.col("id").alias("a"), F.col("ord").alias("u")), "a").join(ids.select(F.col("id").alias("b"), F.col("ord").alias("v")), "b")
    least = connected_components(ends.select("u", "v")).select(F.col("node").alias("ord"), "component")
    labelled = written(ids.join(least, "ord", "left").select("id", F.coalesce("component", "ord").alias("label")))
    tops = numbered(labelled.select("label").distinct(), ["label"], "i")
    return labelled.join(tops, "label").select("id", F.concat(F.lit("community_"), (F.col("i") - 1).cast("string")).alias("community"))


def frequent(nodes: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    kept = nodes.filter(F.col("frequency") >= least)
    return kept, induced(kept, edges)


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.toDF("a"), "a", "left_semi").join(ids.toDF("b"), "b", "left_semi")


def ego(nodes: DataFrame, edges: DataFrame, centre: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within `depth` steps and the edges among them; none for an unknown centre."""
    links = both_ways(edges)
    reach = nodes.filter(F.col("id") == centre).select("id")
    for _ in range(depth):
        reach = reach.unionByName(reach.join(links, F.col("id") == F.col("u")).select(F.col("v").alias("id"))).distinct()
    near = nodes.join(reach, "id", "left_semi")
    return near, induced(near, edges)


def analytics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, betweenness, closeness, community) of every node."""
    out = degrees(nodes, edges).select("id", F.col("centrality").alias("degree"))
    for more in (betweenness(nodes, edges), closeness(nodes, edges), components(nodes, edges)):
        out = out.join(more, "id")
    return out


def top(scores: DataFrame, nodes: DataFrame, metric: str, limit: int = 10) -> DataFrame:
    """The nodes with the best scores, ties by ord, a missing score as 0."""
    rows = nodes.select("id", "ord").join(scores.select("id", metric), "id", "left").withColumn(metric, F.coalesce(metric, F.lit(0.0)))
    return rows.orderBy(F.desc(metric), "ord").limit(limit).select("id", metric)


def cytoscape(nodes: DataFrame, edges: DataFrame, color: Column) -> DataFrame:
    """(group, data): JSON elements for a drawing library; a missing size is 10, a missing width 1."""
    n = nodes.select(F.lit("nodes").alias("group"), F.to_json(F.struct("id", F.coalesce(color, F.lit("#6b7280")).alias("color"), F.round(F.coalesce(node_size(F.col("frequency")), F.lit(10.0)), 3).alias("size"))).alias("data"))
    e = edges.select(F.lit("edges").alias("group"), F.to_json(F.struct(F.col("a").alias("source"), F.col("b").alias("target"), F.round(F.coalesce("width", F.lit(1.0)), 3).alias("width"))).alias("data"))
    return n.unionByName(e)
