"""The corpus pipeline: quality rules, near-duplicates, benchmark leaks, secrets, packing. Part of subpackage llm.

Each stage takes an empty table to an empty one, and texts of any length whole; all but the last return the columns
they got, whatever those are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard_join, packing, quality, secrets
from plumbline.llm.common import dropped, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, rows that repeat an id or have none each by its text; null and empty texts go."""
    return quality.kept_rows(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row, that with the smallest id; a null id comes after all others.

    Rows are told apart by a number of their own, not by doc_id: of rows that repeat an id, or have none, one stays for
    each group, and a row without words, which is in no group, stays.
    """
    # numbers are given once, as rows may come in another order when they are read again
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
    group = jaccard_join.jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"))
    group = group.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    ids = rows.select("_row", F.col("doc_id").cast("long").alias("_id"))
    first = ids.join(group, "_row").groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_first"))
    return rows.join(first.select("_first._row"), "_row", "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them; of rows that repeat an id, or have none, those without."""
    leaks = decontaminate.leak_rows(docs, table(spark, sf_dir, "benchmark"))
    leaks = leaks.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (decontaminate.text_hash(F.col("text")) == F.col("_hash"))
    return docs.join(leaks, same, "left_anti").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, whatever their ids, secrets replaced by their kinds; null and empty texts stay as they are."""
    return secrets.redact(docs)


#: The workers of the last stage run beside a JVM that the stages before have filled, so they keep fewer chunks than op3's.
CHUNKS = 100_000


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences; a null text is an empty one, a null id stays null, a repeated one is packed again."""
    return packing.pack(docs, chunks=CHUNKS)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL has neither the shingle join's components at this size nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = written(stage(spark, docs, sf_dir), name)
        dropped(docs)
        docs = out
    return docs
