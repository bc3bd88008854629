"""The training-data pipeline: documents in, packed sequences out.

Each stage works on all rows that the stage before it kept.  All stages but the last
return the columns of ``documents``; the last returns packed pieces.

Cases: texts that are null, empty or without a letter have no language and go in the
first stage; of rows repeated with their id and text one stays after the second; rows
without an id are rows like all others in every stage; null sources are one source, and a
null language teaches nothing.  Ties go to the smaller doc_id.  Very long texts stay whole
until the last stage cuts them into pieces.  Further columns stay, whatever their names,
until the last stage.  An empty table gives an empty one of the stage's columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import common, exact, langid, minhash, mixing, packing

#: Language ID, BagMinHash, the mixture's hashes and the packing are not SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told by more than the margin."""
    model = langid.learn(docs.where(langid.bucket(F.col("doc_id"), 5) != 0).select("text", "lang"))
    found = langid.classify(docs.select(common.whole_row(), "text"), model)
    return found.where(~F.col("langid.rejected")).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return minhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source as often as its weight in the mixture asks."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences: one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        common.release(spark)
        if k:
            _delete(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
