"""A corpus pipeline of five stages: quality, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import lines, neardup, packing, quality, tiling
from siftwell.llm.textbatch import forget, fresh, written


def _columns(docs: DataFrame, text) -> DataFrame:
    return docs.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more.

    Null texts are scored as empty; rows of equal text stay or go together; without labels every
    score is 0.5 and all stay; an empty table stays empty. Columns stay as they are."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "_score")
    return quality.score(docs, model, out=score).where(F.col(score) >= 0.5).drop(score)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line in ten documents or more stays only in its first place; documents that this empties go, as their lines stand elsewhere.

    The first place is in the smallest doc_id, nulls last, then by text. Documents that were null or
    empty before stay, null as empty; repeated rows count as documents; n_chars is counted anew."""
    out = lines.dedup_lines(docs, keep_first=True)
    return _columns(out.where("n_dropped = 0 or kept <> ''"), F.col("kept"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest doc_id; one without an id if no other has one.

    Null and empty texts are one class; texts without words only with equal ones. Ties go by text; repeated rows leave one."""
    return neardup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without an id, or with one id, are told apart by their texts.

    Null and empty texts hold none and stay; repeated rows stay or go together; an empty benchmark leaves all."""
    (key,) = fresh(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = written(tiling.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=key).select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return keyed.join(found, key, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences of several lengths. Null and wordless texts give no piece; repeated rows are packed each."""
    return packing.op2(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("near-dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: A network, exact tilings and best fit have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
            if kept is not None:
                forget(spark, kept)
            kept = docs
    return docs
