"""A training corpus from documents: five stages, each written as Parquet and read by the next.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame with the columns of ``docs``, the
last one a row per packed piece. A run that is repeated starts a folder of its own, and a stage that
loses executors is worked out again from what its predecessor wrote.

All stages: null text counts as empty, columns that a stage does not know are passed on, an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm import decontam, jaccard, langid, linededup, packing
from snapledger.llm.common import col, free_name, written
from snapledger.storage import scratch_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told: the model, trained on labelled documents, finds one."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))), key="doc_id", text="text", lang="lang")
    kept = free_name(docs, "_all")
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias(kept), "text")
    return (langid.predict_language(rows, model).where(F.col("lang_pred") != langid.UNDETERMINED)
            .select(f"{kept}.*"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take later copies of repeated line runs out; a document of which nothing is left goes."""
    before, rows = free_name(docs, "_before"), docs
    rows = rows.withColumn(before, F.struct(*[col(c) for c in docs.columns]))
    found = linededup.dedup_lines(rows.select("doc_id", "text", before), "doc_id", "text")
    changed = F.col("removed") != ""
    values = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.where(~changed | F.col("text").rlike(r"\S")).select(
        *[(F.when(changed, values[c]).otherwise(F.col(before)[c]) if c in values else F.col(before)[c]).alias(c)
          for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of similar documents: that with the smallest id, text hash and other values."""
    classes = jaccard.text_classes(jaccard.keyed_texts(docs, "doc_id", "text"))
    keep = written(classes.select("class_id", "class_hash").distinct(), "kept")
    keep = keep.select(F.col("class_id").alias("id"), F.col("class_hash").alias("known"))
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col("doc_id").alias("key"),
                       jaccard.text_hash("text").alias("hash"))
    kept = rows.join(keep, F.col("key").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("known")))
    rest = F.to_json(F.struct(F.col("row")["text"].isNull().alias("t"), *[F.col("row")[c].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]),
                     {"ignoreNullFields": "false"})
    return kept.groupBy("hash").agg(F.min_by("row", rest).alias("row")).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark, each told by id and text."""
    found = decontam.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="doc_id", text="text",
                             item_key="item_id", item_text="text")
    other, text = free_name(docs, "_id"), free_name(docs, "_text")
    leaked = written(found.select(F.col("key").alias(other), F.col("hash").alias(text)).distinct(), "leaked")
    return docs.join(leaked, F.col("doc_id").eqNullSafe(F.col(other)) & (decontam.text_hash("text") == F.col(text)), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences; a row per piece."""
    return (packing.pack(docs.select("doc_id", "text"))
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontaminate", decontaminate), ("pack", pack)]
#: SQL can express neither the language model nor the packing; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; the result is the last stage's table."""
    folder = scratch_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
