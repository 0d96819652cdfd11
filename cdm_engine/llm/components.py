"""Connected components over an edge table, without links or labels on the driver.

Labels start at each node's smallest neighbour; a round takes the smallest label among a node's
neighbours and then that label's own label (pointer jumping), so that the number of rounds grows
with the logarithm of the longest path. Each round is written to the shared folder, in place of the one before: a lost executor
costs one round, and lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b); label is the smallest node of the component."""
    both = edges.select("a", "b").where("a <> b")
    pairs = materialize(both.union(both.select("b", "a")).distinct(), "edges")
    table = materialize(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:  # labels only fall, so this ends
        labels = table.select("node", "label")
        near = pairs.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        better = (
            labels.join(near, "node")
            .withColumn("next", F.least("label", "near"))
            .join(hop, "next", "left")
            .select("node", F.least("next", F.coalesce("jump", "next")).alias("label"), F.col("label").alias("old"))
        )
        before, table = table, materialize(better, "labels")
        release(before)
        if not table.where("label <> old").limit(1).count():
            release(pairs)
            return table.select("node", "label")
