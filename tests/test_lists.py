"""Postings lists: order of documents, runs, repeated ids, renumbering, bytes."""

import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from siftwell.functions import codec
from siftwell.operators import build
from siftwell.operators import lists as kernels
from siftwell.plans import catalogue, stored
from siftwell.sources.index import Corrupt, Manager, read_commit

DATA = "/root/testdata/sf0.001/documents.parquet"
QUERIES, SQL = catalogue.queries() | stored.queries(), catalogue.oracle_sql() | stored.oracle_sql()


def same(spark, folder, *names):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    for name in names:
        got, want = QUERIES[name](spark, str(folder)).toPandas(), duck.sql(SQL[name]).df()
        c = sorted(got.columns)
        assert len(got) and got[c].astype(str).sort_values(c).values.tolist() == want[c].astype(str).sort_values(c).values.tolist(), name


def files(folder, *wheres):
    os.makedirs(f"{folder}/documents.parquet")
    for i, w in enumerate(wheres):
        duckdb.sql(f"COPY ({w.format(DATA=DATA)}) TO '{folder}/documents.parquet/part-{i}.parquet' (FORMAT parquet)")


def test_documents_stand_in_the_order_of_their_ids(spark, tmp_path):
    """Spark reads the largest file first: here the one with the last ids."""
    files(tmp_path, *(f"SELECT * FROM '{{DATA}}' WHERE doc_id {w} ORDER BY doc_id DESC" for w in ("< 120", "BETWEEN 120 AND 139", ">= 140")))
    same(spark, tmp_path, "index_first", "merged_first", "index_docs", "index_counters", "index_top_tf")


def test_bulk_without_an_order_keeps_the_rows_order(spark, tmp_path):
    index = Manager(spark, str(tmp_path)).create("x")
    docs = spark.createDataFrame([(f"d{i:02d}", {"message": "common words"}) for i in range(40)], "_id string, fields map<string,string>")
    index.index_all(docs)
    assert [h["_id"] for h in index.search("common", 40)["hits"]] == [f"d{i:02d}" for i in range(40)]
    index.verify()


def test_repeated_ids_and_nulls(spark, tmp_path):
    files(tmp_path, "SELECT * FROM '{DATA}'", "SELECT * REPLACE ('other words the the' AS text) FROM '{DATA}' WHERE doc_id % 7 = 0", "SELECT * REPLACE (doc_id + 1000 AS doc_id, NULL::VARCHAR AS text) FROM '{DATA}' WHERE doc_id < 5")
    same(spark, tmp_path, "build_postings", "field_positions", "delta_encode", "merge_docs", "merge_postings")


def test_runs_of_few_documents(spark, tmp_path, monkeypatch):
    """Lists of many parts have the sizes of whole ones."""
    for m in (build, kernels):
        monkeypatch.setattr(m, "DEAL", 4)
    monkeypatch.setattr(kernels, "TOKENS", 500)
    monkeypatch.setattr(kernels, "PLACES", 100)
    files(tmp_path, "SELECT * FROM '{DATA}' WHERE doc_id % 5 <> 4")
    same(spark, tmp_path, "build_postings", "encoded_size", "term_dictionary", "merge_dictionary", "merge_postings", "decode_postings", "postings_integrity", "index_counters", "merged_term", "index_lifecycle")


def test_postings_are_grouped_without_sort_or_aggregate(spark):
    plan = QUERIES["build_postings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 1


def test_a_stored_key_is_one_row(spark, tmp_path):
    """Parts from four files, and from two segments after a merge, are joined."""
    index = Manager(spark, str(tmp_path)).create("x")
    docs = spark.createDataFrame([(str(i), {"message": f"common word{i % 3}"}) for i in range(60)], "_id string, fields map<string,string>").repartition(4)
    for _ in range(2):
        index.index_all(docs)
    index.delete("7")
    index.force_merge()
    index.verify()
    (seg,) = read_commit(index.path)["segments"]
    lists = spark.read.parquet(os.path.join(index.path, "segments", seg["id"], "postings"))
    assert {r.key: r.df for r in lists.collect()} == {"message:common": 118, "message:word0": 40, "message:word1": 38, "message:word2": 40} and lists.count() == 4


@pytest.mark.parametrize("wrong", ["array(0, 0, 1)", "array(0, 2, 1)", "array(1, 2, 3)"])
def test_verify_finds_documents_out_of_order(spark, tmp_path, wrong):
    index = Manager(spark, str(tmp_path)).create("x")
    for i in range(3):
        index.index_document(str(i), {"message": "common"})
    index.flush()
    index.verify()
    path = os.path.join(index.path, "segments", "seg-000001", "postings")
    lists = spark.read.parquet(path)
    lists.selectExpr(*[f"{wrong} AS docs" if c == "docs" else c for c in lists.columns]).write.parquet(path + ".new")
    os.rename(path, path + ".old"), os.rename(path + ".new", path)
    with pytest.raises(Corrupt):
        index.verify()


def test_numbering():
    r = random.Random(3)
    live = {s: sorted(r.sample(range(-100, 1000), 300)) for s in "ab"}
    at, segs = 0, {}
    for s, docs in live.items():
        rows = []
        for b in sorted({d // 64 for d in docs}):
            mine = np.array([d for d in docs if d // 64 == b])
            rows.append((b, at, np.frombuffer(kernels.bits(mine, 64), np.uint8)))
            at += len(mine)
        segs[s] = tuple(np.array(x) for x in zip(*rows))
    n = kernels.Numbering(64, segs)
    want = {(s, d): i for i, (s, d) in enumerate((s, d) for s in "ab" for d in live[s])}
    for s in "abc":
        assert n.new(s, np.arange(-200, 1100)).tolist() == [want.get((s, d), -1) for d in range(-200, 1100)]


def test_bytes_of_many_lists():
    r = random.Random(2)
    refused = 0
    for _ in range(300):
        lists = [[(d, sorted(r.sample(range(r.choice([10, 300, 2**31])), r.randrange(1, 5)))) for d in sorted(r.sample(range(r.choice([50, 2**14, 2**32])), r.randrange(1, 9)))] for _ in range(r.randrange(1, 6))]
        n, rows = [len(x) for x in lists], [x for y in lists for x in y]
        flat = np.cumsum([0, *n[:-1]]), np.array([d for d, _ in rows]), np.array([len(p) for _, p in rows]), np.array([q for _, p in rows for q in p])
        data = codec.encode_all(*flat)
        assert data.to_pylist() == [codec.encode(x) for x in lists]
        assert all((a == b).all() for a, b in zip(codec.decode_all(data), flat))
        raw = [bytearray(x) for x in data.to_pylist()]
        bad = r.choice(raw)
        bad[r.randrange(len(bad))] = r.randrange(256)
        try:
            want = [codec.decode(bytes(x)) for x in raw]
        except codec.BadPostings:
            want = [[]]
        if all(want):
            got = codec.decode_all(pa.array(map(bytes, raw)))
            assert got[1].tolist() == [d for x in want for d, _ in x] and got[3].tolist() == [q for x in want for _, p in x for q in p]
        else:
            refused += 1
            with pytest.raises(codec.BadPostings):
                codec.decode_all(pa.array(map(bytes, raw)))
    assert 50 < refused < 250
