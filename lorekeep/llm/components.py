"""Connected components of an edge table by least labels, with label shortcuts so that long paths take few rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work


def connected_components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, component): every id of edges (src, dst, longs) and the least id reachable from it.

    Each round takes the least label among neighbours, then the label of that label; rounds are staged in the shared folder.
    Minima are combined before each shuffle, so a node with many neighbours costs its own task nothing more.
    """
    spark = edges.sparkSession
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    links = work.staged(both.distinct(), folder, f"{name}-links")
    labels = work.staged(links.groupBy(F.col("src").alias("id")).agg(F.least(F.first("src"), F.min("dst")).alias("component")), folder, f"{name}-0")
    k = 0
    while True:
        near = links.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("component").alias("near"))
        least = labels.join(near, F.col("id") == F.col("src")).select("id", F.col("component").alias("old"), F.least("component", "near").alias("label"))
        further = labels.select(F.col("id").alias("label"), F.col("component").alias("further"))
        moved = least.join(further, "label").select("id", F.least("label", "further").alias("component"), (F.least("label", "further") < F.col("old")).alias("moved"))
        k += 1
        now = work.staged(moved, folder, f"{name}-{k}")
        work.forget(spark, f"{folder}/{name}-{k - 1}")
        labels = now.select("id", "component")
        if now.where("moved").isEmpty():
            return labels
