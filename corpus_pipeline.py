"""The training-data pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
in the shared folder and rereads it as the next stage's ``docs``. All stages but the last
return the columns of documents.

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join: of each group of near duplicates the smallest ``doc_id`` stays;
3. substring dedup: passages of 50 words and more that an earlier document holds are cut;
4. secret scans: secrets are masked;
5. best-fit packing: pieces of at most 2048 tokens with their sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from histshift.llm.common import table, write_table
from histshift.llm.jaccard_join import one_per_group
from histshift.llm.packing import pack_documents
from histshift.llm.quality import keep_good
from histshift.llm.secrets import redact
from histshift.llm.substring_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates),
          ("substring dedup", repeated_passages), ("secret scans", secrets), ("best-fit packing", packing)]

#: Tokenising, training and whole-text edits are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, name.replace(" ", "-"))
    return docs
