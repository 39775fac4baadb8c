"""The operators as queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import crossparse, fingerprints, licenses, lines, neardup, packing, quality, secrets, tiling, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda f: lambda s, d: f(table(s, d, "documents"))
    also = lambda f, other: lambda s, d: f(table(s, d, "documents"), table(s, d, other))
    return {
        "op1_fingerprints": docs(fingerprints.op1),
        "op2_packing": docs(packing.op2),
        "op3_license_scan": docs(licenses.op3),
        "op4_line_dedup": docs(lines.op4),
        "op5_decontamination": also(tiling.op5, "benchmark"),
        "op6_quality": also(quality.op6, "labels"),
        "op7_lm_scores": docs(crossparse.lm_scores),
        "op8_near_dedup": docs(neardup.op8),
        "op9_token_counts": docs(tokens.op9),
        "op10_secret_scan": docs(secrets.op10),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": lines.SQL, "op10_secret_scan": secrets.SQL}
