"""Corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate
from tidemark.llm.common import delete_path, fresh_names, passing_tables, work_dir
from tidemark.llm.line_dedup import ADDED, dedup_lines
from tidemark.llm.ngram_join import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import RULE_COLUMNS, quality_rules


def shielded(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list]:
    """docs with columns that an operator would replace by its own under other names, and the columns that bring them back."""
    clash = [c for c in docs.columns if c.lower() in names]
    other = dict(zip(clash, fresh_names(docs.columns, *(f"_{c}" for c in clash)), strict=True))
    return docs.withColumnsRenamed(other), [F.col(other.get(c, c)).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Also without what stands as far from its language's common words as a text that has none of them (0.9 of that distance)."""
    docs, own = shielded(docs, RULE_COLUMNS)
    # A verdict that counts as not deterministic keeps the filter above the projections that work it out.
    once = F.col("kept") & (F.spark_partition_id() >= 0)
    return quality_rules(docs, max_word_share=0.9).select(*docs.columns, once.alias("kept")).where("kept").select(*own)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each class of repeated lines keeps its first; a document that loses all its words goes, one that had none stays."""
    docs, own = shielded(docs, ADDED)
    out = dedup_lines(docs, min_equal=1)
    return out.where((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).select(*own)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five-word shingles, similarity 0.8), once.

    A row is known by its id and text, so rows that share an id or have none (the largest) stay unless a group joins them;
    rows without words are in no group and all stay."""
    key, own, first = fresh_names(docs.columns, "_row", "_id", "_first")
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    groups = near_duplicates(docs.select(row.alias(key), "text"), key=key, size=5, percent=80).distinct()
    ids = docs.select(row.alias(key), F.col("doc_id").cast("long").alias(own)).distinct()
    order = F.struct(F.col(own).isNull().alias("null"), F.col(own).alias("id"), F.col(key).alias("row"))
    first = groups.where("n_shingles > 0").join(ids, key).groupBy("component_id").agg(F.min(order).alias(first)).select(F.col(f"{first}.row").alias(key))
    known = docs.withColumn(key, row)
    kept = known.join(first, key, "left_semi").dropDuplicates([key])
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    return kept.unionByName(known.where(wordless)).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs.select("doc_id", "text"))


STAGES = [("quality_rules", quality), ("line_dedup", unique_lines), ("ngram_join", one_of_each), ("decontaminate", decontaminated), ("packing", packed)]

#: Line dedup, the near-duplicate join and the packing programme have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written to the shared folder and read again by the next. A stage's work
    tables and the rows that it read are deleted once its own rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with passing_tables(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{base}/{k}-{name}")
            schema = out.schema
            del out
        docs = spark.read.schema(schema).parquet(f"{base}/{k}-{name}")
        if k:
            delete_path(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
