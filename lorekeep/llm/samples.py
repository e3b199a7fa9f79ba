"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lowest_hashed(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of (doc_id, ...): those whose hashed ids are lowest, alike on every run."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled(labels: DataFrame, column: str, most: dict[int, int], fold: Column) -> DataFrame:
    """(id, label): up to most[value] ids for each value of a 0/1 column, from the rows that fold admits; small enough to broadcast."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(fold).dropna().dropDuplicates(["doc_id"])
    parts = [lowest_hashed(rows.where(F.col("label") == value), n) for value, n in most.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(F.col("doc_id").alias("id"), "label")
