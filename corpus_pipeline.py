"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of their ``docs``. Extra columns,
nulls, repeated rows and empty tables pass through as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontaminate, packing, quality, simhash_dedup, substring_dedup
from tallyweave.llm.names import named, quoted
from tallyweave.llm.scratch import Scratch


def as_rows(docs: DataFrame) -> DataFrame:
    """All columns in one, so that result columns can't clash with them."""
    return docs.select(F.struct(*map(named, docs.columns)).alias("row"))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    voters = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "crc32(cast(doc_id as string)) % 3 <> 1")
    return quality.score(as_rows(docs), voters, "row.text", ["row"]).where("predicted = 1").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with a similarity of 0.8 or more (five-word shingles)."""
    return simhash_dedup.keep_one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that occur elsewhere too, and documents of which nothing is left."""
    found = substring_dedup.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    kept = found.where("n_removed = 0 or kept_text <> ''")
    columns = [F.col(f"row.{quoted(c)}") for c in docs.columns]
    for k, c in enumerate(docs.columns):
        if c == "text":
            columns[k] = text.alias(c)
        elif c == "n_chars":
            columns[k] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(columns[k]).alias(c)
    return kept.select(*columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    found = decontaminate.find_items(as_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "row.text", carry=["row"])
    return found.where(F.size("hits") == 0).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("best_fit_packing", pack_sequences),
]
#: SQL can express none of the fitted, hashed or genetic stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
