"""A corpus pipeline: quality rules, near duplicates, repeated substrings, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, with text and n_chars
of what is left. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import decontaminate, jaccard, packing, quality, substrings
from tidegraph.llm.common import quoted, stored, table
from tidegraph.llm.superkmers import LEAST


def _rows(docs: DataFrame) -> DataFrame:
    """id, doc: a number for each row, and the row; stored, so that all reads see the same numbers. doc_id may be null or shared, the number is not."""
    return stored(docs.select(F.monotonically_increasing_id().alias("id"), F.struct("*").alias("doc")), "rows")


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("doc_id"), F.col("doc.text").alias("text"))


def _with_text(docs: DataFrame, text: F.Column) -> DataFrame:
    """docs with another text; n_chars follows where docs has it."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the lines that failed go from the others."""
    judged = quality.clean_lines(docs)
    found = F.col(quoted(judged.columns[-1]))
    changed = F.when(found["n_lines_failed"] > 0, found["cleaned"]).otherwise(F.col("text"))
    return _with_text(judged.where(found["kept"]), changed).select(*map(quoted, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links between their texts connect, the one with the smallest doc_id stays (null is smallest; of several, the smallest hash of the text)."""
    rows = _rows(docs)
    found = jaccard.near_duplicates(_texts(rows)).select(F.col("doc_id").alias("id"), "component_id")
    names = rows.select("id", F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(LEAST)).alias("name"), F.xxhash64("doc.text").alias("hash"))
    stay = found.join(names, "id").groupBy("component_id").agg(F.min(F.struct("name", "hash", "id")).alias("least")).select("least.id")
    return rows.join(stay, "id", "left_semi").select("doc.*")


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that come again go; a document that loses all its words goes."""
    out = substrings.remove_repeats(docs)
    found = F.col(quoted(out.columns[-1]))
    changed = F.when(found["n_removed"] > 0, found["kept"]).otherwise(F.col("text"))
    return _with_text(out.where((found["n_removed"] < found["n_words"]) | (found["n_words"] == 0)), changed).select(*map(quoted, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go."""
    rows = _rows(docs)
    found = decontaminate.contained(_texts(rows), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return rows.join(stored(found.select(F.col("doc_id").alias("id")).distinct(), "found"), "id", "left_anti").select("doc.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_substrings),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
