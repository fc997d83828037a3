"""Connected components by minimum labels and pointer jumping, on DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each end of a link with the smallest id it reaches.

    A round takes the smallest label among a node's neighbours (combined before
    the shuffle, so a node of many links needs no single task), then follows
    the label's own label, which halves the remaining distance at least for
    paths. Rounds end when no label changes; labels only fall, so they do end.
    Null ends link nothing.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("other")).where("id IS NOT NULL AND other IS NOT NULL AND id <> other")
    both = cut(both.union(both.select("other", "id")).distinct())
    labels = cut(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("component")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("near"))
        lower = labels.join(seen, "id").select("id", F.least("component", "near").alias("step"), F.col("component").alias("before"))
        jump = labels.select(F.col("id").alias("step"), F.col("component").alias("jump"))
        after = cut(lower.join(jump, "step", "left").select("id", F.coalesce(F.least("step", "jump"), "step").alias("component"), "before"))
        done = after.where("component <> before").isEmpty()
        labels = after.select("id", "component")
        if done:
            return labels
