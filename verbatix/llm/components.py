"""Connected components by minimum-label propagation with pointer jumping, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, labels: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (a, b), for every node that has an edge.

    ``labels`` (node, label) of an earlier call stay valid as links node-label.
    Each round takes the least label of the neighbours and then the label of that
    label, so chains halve; the table is written after each round. ``rows`` tells about
    how many edges there are. Null ends and loops are ignored; no edges give an empty table.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b")
    if labels is not None:
        pairs = pairs.unionByName(labels.where("node != label").selectExpr("node as a", "label as b"))
    both = common.materialize(pairs.unionByName(pairs.selectExpr("b as a", "a as b")).distinct(), rows=rows)
    rows = both.count()  # from the files' footers; there are no more nodes than that
    now = common.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), rows=rows)
    while True:
        common.settle(edges.sparkSession)  # each round leaves broadcasts in the driver
        near = both.join(now, both.b == now.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = now.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = common.materialize(step.join(jump, "label").select("node", "was", F.least("label", "next").alias("label")), rows=rows)
        moved = new.where("was != label").limit(1).count()
        common.drop_shared(edges.sparkSession, now)
        now = new.select("node", "label")
        if not moved:
            common.drop_shared(edges.sparkSession, both)
            return now
