"""Connected components of edge tables, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) → (node, component), the component named by its least node.

    Every round writes its labels to the shared folder, where they replace those of
    the round before; only a count reaches the driver. A path of n nodes takes about
    log n rounds, a star two.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = written(both.where("node != other").distinct(), "component-edges", narrow=True)
    held = written(both.groupBy("node").agg(F.least(F.min("other"), F.min("node")).alias("component")), "component-labels", narrow=True)
    while True:
        labels = held.select("node", "component")
        of_other = labels.select(F.col("node").alias("other"), F.col("component").alias("offered"))
        offers = both.join(of_other, "other").groupBy("node").agg(F.min("offered").alias("offered"))
        hooked = labels.join(offers, "node").select("node", F.least("component", "offered").alias("component"), F.col("component").alias("was"))
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = hooked.join(up, "component", "left").select("node", F.least("component", F.coalesce("above", "component")).alias("component"), "was")
        jumped = written(jumped, "component-labels", narrow=True)
        discard(held)
        held = jumped
        if not jumped.where("component != was").limit(1).count():
            discard(both)
            return jumped.select("node", "component")


def extended(labels: DataFrame, links: DataFrame, broadcast: int = 1_000_000) -> DataFrame:
    """``labels`` (node, component) after more ``links`` (a, b): only the
    components that these touch are worked on."""
    links = links.select("a", "b").distinct()
    sided = links
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
        sided = sided.join(own, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
    sided = written(sided.select("a", "b", "of_a", "of_b"), "component-links", narrow=True)
    merged = components(sided.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    ends = sided.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    new = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    above = merged.select(F.col("node").alias("component"), F.col("component").alias("above"))
    few = above.limit(broadcast + 1).count() <= broadcast
    moved = labels.unionByName(new).join(F.broadcast(above) if few else above, "component", "left")
    return written(moved.select("node", F.coalesce("above", "component").alias("component")), "component-labels", narrow=True)
