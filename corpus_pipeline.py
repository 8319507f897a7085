"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Nulls and edge cases are those of the operators: documents with a null or empty text pass all stages but the last, which has nothing of them to pack;
ids may be null or repeated; rows equal in id and text become one by the second stage if they have a word; very long texts are handled whole; extra columns go through the first four stages;
an empty table, or one that a stage empties, gives no rows from there on.

No stage can be written in SQL as a whole, so ``ORACLE_SQL`` is None; the tests compare with brute force instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkvane.llm.common import read, shared_folder
from sparkvane.llm.linear_grouping import pack
from sparkvane.llm.recompression import drop_repeated_passages
from sparkvane.llm.simhash_vptree import drop_near_duplicates
from sparkvane.llm.string_tiling import drop_contaminated
from sparkvane.llm.toxicity_chain import drop_toxic, fit_chain


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit_chain(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("benchmark_decontamination", decontamination), ("best_fit_packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: packed sequences with their texts.

    Stages are written below the session's checkpoint folder, which all executors share; each is removed once the next is written, the last one stays
    for whoever reads the result.
    """
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
