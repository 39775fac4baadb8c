"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SEARCHES = {"term": ("the", False), "and": ("the AND lang:en", False), "or": ("lang:fr OR lang:de", False), "phrase": ('"the of"', False), "fuzzy1": ("attion~1", False), "fuzzy2": ("attion~2", False), "tf_top10": ("the OR of", True)}


def main() -> None:
    cpus, d = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from siftwell.plans import catalogue
    from siftwell.sources.index import Manager

    times: dict[str, float] = {}
    with tempfile.TemporaryDirectory() as base:
        index = Manager(spark, base).create("bench")
        t = time.time()
        index.index_all(catalogue.corpus(spark, d).select("_id", "fields"))
        times["index_build"] = time.time() - t
        for name, (q, rank) in SEARCHES.items():
            index.search(q, 10, rank)
            took = []
            for _ in range(3):
                t = time.time()
                index.search(q, 10, rank)
                took.append(time.time() - t)
            times[f"index_{name}"] = sorted(took)[1]
    for name in ("search_and", "search_phrase", "build_postings", "term_dictionary"):
        t = time.time()
        catalogue.queries()[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = time.time() - t
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in times.items()}, "sf": os.path.basename(d.rstrip("/"))}))


if __name__ == "__main__":
    main()
