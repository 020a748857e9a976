"""Connected components of a graph held in a DataFrame.

Labels start as the node itself; a round takes the least label among a node
and its neighbours, then follows labels one step (``label <- label[label]``),
so long chains halve.  Nothing but one sum per round reaches the driver, and
every round is written to the scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.common import materialise


def _total(labels: DataFrame):
    return labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(u, v)``, both long: label is the
    least node reachable.  Empty edges give an empty result."""
    links = materialise(edges.union(edges.select("v", "u")).where("u <> v").distinct())
    labels = materialise(links.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label")))
    before = _total(labels)
    while before is not None:
        told = links.join(labels, links.v == labels.node).select(links.u.alias("node"), "label")
        near = materialise(told.union(labels).groupBy("node").agg(F.min("label").alias("label")))
        up = near.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = materialise(near.join(up, "label").select("node", F.col("top").alias("label")))
        now = _total(labels)
        if now == before:
            break
        before = now
    return labels
