"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node of an undirected edge table; root is one node of its component.

    Each round points every node at its smallest neighbour (or itself), doubles those pointers until all reach
    their ends, and contracts the edges to those. Every end has taken in a neighbour, so the nodes left at least halve;
    the loop runs until no edge is left. Every step is written to the shared folder.
    NULL ends are no nodes; loops and repeated edges do no harm; no edges give no rows.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "cc-nodes")
    roots = nodes.select("node", F.col("node").alias("root"))
    edges = written(edges.filter("a <> b").distinct(), "cc-edges")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("p"))
        up = written(up.select("n", F.least("n", "p").alias("p")), "cc-up")
        while True:
            doubled = written(up.join(up.select(F.col("n").alias("p"), F.col("p").alias("pp")), "p"), "cc-up")
            up = doubled.select("n", F.col("pp").alias("p"))
            if doubled.filter("pp <> p").isEmpty():
                break
        roots = written(roots.join(up, roots["root"] == up["n"], "left").select("node", F.coalesce("p", "root").alias("root")), "cc-roots")
        left = up.select(F.col("n").alias("a"), F.col("p").alias("pa"))
        right = up.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(left, "a").join(right, "b").filter("pa <> pb")
        edges = written(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
    return roots
