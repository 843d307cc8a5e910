"""Connected components of links, as a few joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rapport.llm.shared import staged


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (the smallest node that links reach) of all nodes in ``edges`` (``a``, ``b``, not null).

    Smallest labels pass along the links, and each round also follows label of label, so long chains shorten by halves.
    Each round is a table in the shared folder.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
                    .select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        moved = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        moved = staged(moved, "labels")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = staged(moved.join(jump, "label").select("node", "was", F.least("label", "next").alias("label")), "labels")
        if after.where("was != label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
