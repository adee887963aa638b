"""A cleaning and packing pipeline over ``documents``, stage by stage.

Each stage takes (spark, docs, folder) and works on all that the stage before kept;
its result is written as Parquet and read again as the next stage's docs.  All but
the last return the columns of docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._spark import cut, remove, shared_folder
from tessera.llm.decontaminate import contained_items
from tessera.llm.line_dedup import removed_lines, without_lines
from tessera.llm.near_dedup import Plan, near_dedup
from tessera.llm.packing import pack_documents
from tessera.llm.queries import TOXIC_AT, not_held_out, table
from tessera.llm.toxicity import score_toxicity


#: Five words and 0.8; sets that similar miss all chunks of the index with probability 9e-5.
NEAR = Plan(shingle=5, percent=80)


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labels of the input table."""
    source = table(spark, folder, "documents").select("doc_id", "text")
    labels = not_held_out(table(spark, folder, "labels"))
    scored = score_toxicity(docs, labels, score_col="__toxicity", training_docs=source)
    return scored.where(F.col("__toxicity") < TOXIC_AT).drop("__toxicity")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without lines that are similar to an earlier one; n_chars follows the text.

    Documents stay, also those that have no line left."""
    kept = without_lines(docs, removed_lines(docs))
    if "n_chars" not in kept.columns:
        return kept
    count = F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(count)
    return kept.withColumn("n_chars", changed)


def _placed(docs: DataFrame) -> DataFrame:
    """place and text of each row; places order rows by id, null ids last, and then by a hash of the text."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"))
    return docs.select(place.alias("place"), "text")


def _at(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """``docs`` joined (left_anti or left_semi) with the rows of ``places``, null ids included."""
    named = places.select(F.col("place.id").alias("__id"), F.col("place.mark").alias("__mark"))
    hit = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__mark"))
    return docs.join(named, hit, how)


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates, and all others.

    Null ids are the largest; of rows that share an id the one of the smallest hash of
    its text stays, and of rows that share id and text any one.  Rows without words all stay."""
    groups = near_dedup(_placed(docs), id_col="place", plan=NEAR).where("n_shingles > 0")
    decided = groups.groupBy("place").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    decided = cut(decided.where("not kept or n > 1"))
    left, twice = _at(docs, decided, "left_anti"), decided.where("kept")
    if twice.isEmpty():
        return left
    return left.unionByName(_at(docs, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that contain no benchmark item, judged row by row, whatever their ids."""
    found = contained_items(_placed(docs), table(spark, folder, "benchmark"), id_col="place")
    return _at(docs, cut(found.where(F.size("hits") > 0).select("place").distinct()), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents in bins of the permitted lengths."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL cannot express the scores or the packing; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written to the shared folder.

    A table goes when the next one is written; the last one stays, for the result reads it."""
    docs = table(spark, folder, "documents")
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{home}/{i}")
        docs = spark.read.parquet(f"{home}/{i}")
        if i:
            remove(spark, f"{home}/{i - 1}")
    return STAGES[-1][1](spark, docs, folder)
