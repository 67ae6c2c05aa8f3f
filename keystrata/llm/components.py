"""Connected components by repeated contraction, for near-duplicate links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import scratch, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) for every id in edges (a, b); component is the smallest id reachable.

    Each round maps a node to its smallest neighbour (itself included), follows that map twice
    more, and replaces the nodes of all edges; edges within a component vanish, so the graph
    shrinks from round to round and a path of n nodes takes O(log n) rounds. Rounds are written to
    the shared folder. Minima are combined before each shuffle, and no node's edges are gathered
    in one place. Self-links, repeated links and both directions are allowed; null ends are
    ignored. No edges: no rows.
    """
    with scratch(edges.sparkSession):
        return stored(_contracted(edges), "components", keep=True)


def _contracted(edges: DataFrame) -> DataFrame:
    both = edges.filter("a is not null and b is not null").select("a", "b")
    links = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = links.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    while not links.isEmpty():
        nearest = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to"))
        hop = stored(nearest, "nearest")
        for _ in range(2):
            further = hop.select(F.col("a").alias("to"), F.col("to").alias("next"))
            hop = hop.join(further, "to", "left").select("a", F.coalesce("next", "to").alias("to"))
        hop = stored(hop, "hop")
        labels = labels.join(hop.select(F.col("a").alias("component"), "to"), "component", "left")
        labels = stored(labels.select("id", F.coalesce("to", "component").alias("component")), "labels")
        links = links.join(hop.select("a", F.col("to").alias("new_a")), "a")
        links = links.join(hop.select(F.col("a").alias("b"), F.col("to").alias("new_b")), "b")
        links = links.select(F.col("new_a").alias("a"), F.col("new_b").alias("b")).filter("a <> b").distinct()
        links = stored(links, "links")
    return labels
