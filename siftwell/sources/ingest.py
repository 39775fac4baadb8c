"""JSON documents to flat text fields, one by one and as NDJSON files."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_LINE = 1 << 20


class BadDocument(ValueError):
    """A body that is no document; the message says why."""


class _Number(str):
    """A number as it was written."""


def _constant(_: str):
    raise ValueError("not JSON")


def _whole(text: str) -> str:
    """Halves of surrogate pairs, which no UTF-8 has, become U+FFFD."""
    return re.sub("[\ud800-\udfff]", "\ufffd", text)


def parse_document(line: str) -> tuple[str, dict[str, str]]:
    """(_id or '', fields) of a JSON object. Numbers keep their spelling, nulls are dropped, nested values are refused."""
    try:
        got = json.loads(line, parse_int=_Number, parse_float=_Number, parse_constant=_constant)
    except (ValueError, RecursionError) as e:
        raise BadDocument("invalid JSON body") from e
    if got is None:
        raise BadDocument("JSON body must be an object")
    if not isinstance(got, dict):
        raise BadDocument("invalid JSON body")
    fields = {}
    for k, v in got.items():
        if v is None:
            continue
        if isinstance(v, (dict, list)):
            raise BadDocument("nested values are not supported")
        fields[_whole(k)] = ("true" if v else "false") if isinstance(v, bool) else _whole(str(v))
    return fields.pop("_id", ""), fields


def parse_json(df: DataFrame, column: str) -> DataFrame:
    """Add ``_id``, ``fields`` and ``error`` (null where the document is good), in batches."""

    @F.pandas_udf("struct<_id:string,fields:map<string,string>,error:string>")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for x in s:
                try:
                    rows.append((*parse_document(x or ""), None))
                except BadDocument as e:
                    rows.append((None, None, str(e)))
            yield pd.DataFrame(rows, columns=["_id", "fields", "error"])

    return df.withColumn("_doc", parsed(F.col(column))).select(*df.columns, "_doc._id", "_doc.fields", "_doc.error")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value, _id, fields, error) of each line that isn't blank.

    ``file`` and ``line`` (a number that rises in a file) give the order. A line above 1 MiB is an error of
    its own: the lines before and after it stand."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), "value").where(F.col("value").rlike(r"\S"))
    long = F.octet_length("value") > MOST_LINE
    got = parse_json(lines.withColumn("_body", F.when(long, F.lit("")).otherwise(F.col("value"))), "_body").drop("_body")
    return got.withColumn("error", F.when(long, F.lit("line too long")).otherwise(F.col("error")))


def last_wins(docs: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key. Keys have few rows each or are salted by the caller; one shuffle."""
    by = Window.partitionBy(key).orderBy(F.desc(order))
    return docs.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
