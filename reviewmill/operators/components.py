"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.session import cut_measured


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) with root the smallest node of the component, from edges (src, dst).

    Each round takes the smallest root among the neighbours and then jumps to that
    root's own root, so long chains halve. Minima combine map-side; each round is
    checkpointed. Stops when a round changes nothing.
    """
    both = cut_measured(
        edges.select("src", "dst")
        .unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        .distinct()
    )
    roots = cut_measured(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root")))
    for _ in range(max_rounds):
        heard = (
            both.join(roots, both.src == roots.node)
            .groupBy("dst")
            .agg(F.min("root").alias("heard"))
        )
        nearer = roots.join(heard, roots.node == heard.dst).select(
            "node", F.col("root").alias("was"), F.least("root", "heard").alias("via")
        )
        parents = roots.select(F.col("node").alias("via"), F.col("root").alias("up"))
        step = cut_measured(
            nearer.join(parents, "via", "left").select("node", "was", F.least("via", F.coalesce("up", "via")).alias("root"))
        )
        roots = step.select("node", "root")
        if step.filter(F.col("root") != F.col("was")).isEmpty():
            return roots
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
