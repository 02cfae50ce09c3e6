"""The corpus pipeline: language ID, near and exact deduplication, mixing, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all rows its predecessor kept; its result is written as Parquet
and read again as the next stage's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, mixing, packing, simhash, suffix_dedup
from tessera.llm.common import dropped, fold, table, workers_can_import, written
from tessera.llm.queries import MIX_WEIGHTS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; the others get the predicted language.

    The network learns from the labelled documents of one side of a fold, as the query does.  Texts of a language that it
    has not met cannot be told from those it has, so nothing else is rejected.
    """
    workers_can_import(spark)
    net = language_id.fit(docs.where(fold("doc_id", 4) != 2))
    found = language_id.predict(docs, net, keep=[docs[c] for c in COLUMNS if c != "lang"])
    return found.where("lang_pred <> 'und'").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row stays: that of the smallest id, of several such rows that of the smallest hash.

    Rows without an id stay if none of their component has one, as no component can be told apart then.
    """
    workers_can_import(spark)
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row_key"))
    groups = simhash.near_duplicates(rows, keep=["row_key"])
    first = groups.where("doc_id = component_id").groupBy("doc_id", "component_fp").agg(F.min("row_key").alias("row_key"))
    nameless = groups.where("component_id is null").select("row_key").distinct()
    kept = rows.join(first, ["doc_id", "row_key"], "left_semi").dropDuplicates(["doc_id", "row_key"])
    return kept.select(*COLUMNS).unionAll(rows.where("doc_id is null").join(nameless, "row_key", "left_semi").select(*COLUMNS))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier document's go; a document without a word left goes with them."""
    workers_can_import(spark)
    kept = suffix_dedup.remove_repeats(docs, keep=["lang", "source"], with_text=True)
    kept = kept.where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf of the domain-language-source tree gives its budget: a document may come once in each epoch."""
    workers_can_import(spark)
    mixed = mixing.mix(docs, weights=MIX_WEIGHTS, with_text=True)
    return mixed.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, with its sequence and its place there."""
    workers_can_import(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The network, the tokenizer and the packing have no SQL twin; tests hold the stages against plain versions and round trips.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), None
    for _, stage in STAGES[:-1]:
        after = written(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
