"""The corpus pipeline: toxicity, quality, near-duplicates, personal data, packing.

Each stage takes the documents that the one before kept and returns documents with the same columns; the last returns packed
pieces. Tables between stages are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import minhash, packing, pii, quality, toxicity, work

#: Similarity in percent at which the near_dedup stage links two texts.
ALIKE = 80

#: Trained models and token ids have no SQL form; tests compare what each stage keeps and writes with a plain version of it.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.reject(docs, work.table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling leaves out go."""
    return quality.select(docs, work.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates stays; of rows that repeat its id, the one of the least hash.
    Rows without an id stay."""
    kept = minhash.near_duplicates(docs, percent=ALIKE).where("kept and doc_id is not null").select(F.col("doc_id").alias("__lorekeep_id"))
    same = docs.join(kept, F.col("doc_id") == F.col("__lorekeep_id"), "left_semi").groupBy("doc_id")
    one = same.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__lorekeep_row")).select("__lorekeep_row.*")
    return one.unionByName(docs.where("doc_id is null"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids placed in sequences."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what the last one returns."""
    folder = work.work_folder(spark)
    docs = work.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.staged(docs, folder, name)
    return docs
