import glob

import duckdb
import pytest

from siftwell.plans import catalogue, stored

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries() | stored.queries(), catalogue.oracle_sql() | stored.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        c.sql(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    c = sorted(got.columns)
    assert c == sorted(want.columns)
    assert got[c].astype(str).sort_values(c).values.tolist() == want[c].astype(str).sort_values(c).values.tolist()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())


def test_codec_golden(spark):
    from siftwell.operators import build

    posts = spark.createDataFrame([("s", "k", 0, [0], 1), ("s", "k", 1, [0, 2], 2), ("s", "k", 2, [1], 1)], "seg string, key string, doc long, pos array<int>, tf long")
    assert build.dictionary(posts).first().encoded_len == 11
    assert [r[0] for r in posts.orderBy("doc").select(build.deltas(posts.pos)).collect()] == [[0], [0, 2], [1]]


def test_multi_segment_returns_all_matches(spark):
    d = DATA.replace("sf0.001", "sf0.01")
    got = {r.seg_ord: r["count"] for r in catalogue.queries()["search_multi_segment"](spark, d).groupBy("seg_ord").count().collect()}
    sql = r"SELECT doc_id % 3, count(*) FROM '{}/documents.parquet' WHERE lang = 'es' OR list_contains(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nd}}]+'), 'in') GROUP BY 1"
    assert got == dict(duckdb.sql(sql.format(d)).fetchall()) and len(got) == 3 and sum(got.values()) > 500
