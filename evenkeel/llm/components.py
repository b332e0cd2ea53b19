"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.sources import materialise


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every node of ``links`` (a, b): the smallest id that it reaches.

    Every round takes the least label among a node's neighbours, then the label of that
    label, so long chains take a logarithm of rounds. Labels are written to the
    shared folder each round; a lost executor costs one round's re-read.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both.where("a <> b"))
    labels = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = materialise(low.join(up, "label", "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        labels = new.select("id", "label")
        if not new.where("label <> old").limit(1).count():
            return labels
