"""Queries over indices on disk, the query language, ingest and HTTP, with SQL written by hand.

The stored index has two bulk segments (documents from id 100 on, even and odd), a buffer (ids
below 100) and three deletes. It is built once a session and folder, where ``spark.checkpoint.dir``
says, and read as any search reads it: committed Parquet segments, then the buffer.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import analysis
from siftwell.plans import compile as plan
from siftwell.plans import query as language
from siftwell.plans.catalogue import BASE, EN, FR, OF, SRC3, THE, _near, _phrase, _sql, _tf, _vi, corpus
from siftwell.sources import ingest, server
from siftwell.sources.index import Index, Manager, NotFound

DELETED = ("42", "110", "121")
BUFFERED = 100
_built: dict[tuple[str, str, str], Index] = {}


def _folder(spark: SparkSession) -> str:
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file:")
    if not shared and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
    path = f"/{shared.lstrip('/')}" if shared else tempfile.gettempdir()
    return os.path.join(path, f"indices-{uuid.uuid4().hex}")


def live(spark: SparkSession, d: str) -> Index:
    """Two segments, the buffer and the deletes."""
    at = (spark.sparkContext.applicationId, d, "live")
    if at not in _built:
        docs = corpus(spark, d).select(F.col("_id").cast("long").alias("n"), "_id", "fields")
        index = Manager(spark, _folder(spark)).create("live")
        for parity in (0, 1):
            index.index_all(docs.where((F.col("n") >= BUFFERED) & (F.col("n") % 2 == parity)), order="n")
        for r in docs.where(F.col("n") < BUFFERED).orderBy("n").collect():
            index.index_document(r._id, r.fields)
        for i in DELETED:
            index.delete(i)
        _built[at] = index
    return _built[at]


def merged(spark: SparkSession, d: str) -> tuple[Index, list[tuple]]:
    """The same, its buffer flushed: the third segment, after which all are merged into one. And what each step said."""
    at = (spark.sparkContext.applicationId, d, "merged")
    if at not in _built:
        docs = corpus(spark, d).select(F.col("_id").cast("long").alias("n"), "_id", "fields")
        manager = Manager(spark, _folder(spark))
        index, said = manager.create("merged"), []
        say = lambda step, x: said.append((step, x.get("segment", ""), x.get("docs", 0), x.get("terms", 0), x["generation"]))
        say("empty flush", index.flush())
        for parity in (0, 1):
            say(f"bulk {parity}", index.index_all(docs.where((F.col("n") >= BUFFERED) & (F.col("n") % 2 == parity)), order="n"))
        for r in docs.where(F.col("n") < BUFFERED).orderBy("n").collect():
            index.index_document(r._id, r.fields)
        for i in DELETED:
            index.delete(i)
        say("flush", index.flush())
        say("force merge of one", index.force_merge())
        index.verify()
        said.append(("present", ",".join(n for n, _ in manager.list()), len(index.ram), sum(k for _, k in manager.list()), index.stats()["generation"]))
        _built[at] = index, said
    return _built[at]


def _found(which: Callable, query: str, limit: int | None = None, rank: bool = False) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        got = which(spark, d)
        tables = (got[0] if isinstance(got, tuple) else got).tables()
        hits = plan.search(tables, query, limit, rank).join(tables.docs.select("seg", "doc", "_id"), ["seg", "doc"])
        return hits.select("_id", "seg", "score")

    return run


SEG = f"CASE WHEN doc_id < {BUFFERED} THEN '_ram' WHEN doc_id % 2 = 0 THEN 'seg-000001' ELSE 'seg-000002' END"
ALIVE = f" AND doc_id NOT IN ({', '.join(DELETED)})"
ORDER = f"CASE WHEN doc_id < {BUFFERED} THEN 2 ELSE doc_id % 2 END, doc_id"


def _live_sql(leaves: list[str], where: str, score: str, tail: str = "") -> str:
    return _sql(leaves, where, score, ALIVE, tail, f"doc_id::VARCHAR AS _id, {SEG} AS seg")


def _merged_sql(leaves: list[str], where: str, score: str, tail: str = "") -> str:
    return _sql(leaves, where, score, ALIVE, tail, "doc_id::VARCHAR AS _id, 'seg-000004' AS seg")


#: name: (query, limit, rank, leaves, condition, score)
SEARCHES = {
    "term": ("the", None, False, [THE], "a > 0", "a"),
    "and": ("the AND lang:en", None, False, [THE, EN], "a > 0 AND b > 0", "a + b"),
    "rare_and": ("source:src3 AND the AND of", None, False, [SRC3, THE, OF], "a > 0 AND b > 0 AND c > 0", "a + b + c"),
    "or": ("lang:fr OR (of AND lang:en)", None, False, [FR, OF, EN], "a > 0 OR (b > 0 AND c > 0)", "a + b + c"),
    "phrase": ('"the of" AND lang:en', None, False, [_phrase("message", "the", ("of", 1)), EN], "a > 0 AND b > 0", "a + b"),
    "fuzzy": ("attion~1 OR thn~1", None, False, [_near("message", "attion", 1), _near("message", "thn", 1)], "a > 0 OR b > 0", "a + b"),
    "top_tf": ("the OR of", 10, True, [THE, OF], "a > 0 OR b > 0", "a + b"),
    "first": ("of", 7, False, [OF], "a > 0", "a"),
    "absent": ("nowhere AND the", None, False, [_tf("message:nowhere"), THE], "a > 0 AND b > 0", "a + b"),
}


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def index_hits(spark, d):
    """Hits as callers get them: fields, _seg and _score as text."""
    hits = live(spark, d).search("source:src7 AND of", 10**6, True)["hits"]
    return _rows(spark, [(h["_id"], h["_seg"], h["_score"], h["lang"], h["source"]) for h in hits], "_id string, _seg string, _score string, lang string, source string")


COUNTED = ("the", "the OR the", "attion~1", '"the of"', "the AND lang:en AND nowhere")


def index_counters(spark, d):
    """What a search says of its own work."""
    rows = []
    for q in COUNTED:
        x = live(spark, d).search(q, 5)
        rows.append((q, x["postings_lookups"], x["docs_examined"], x["segments_searched"], x["io"]["postings_decoded"], x["io"]["postings_bytes_read"], x["took_ms"] >= 0 and x["io"]["metadata_bytes_read"] > 0 and (x["io"]["docs_bytes_read"] > 0) == (x["docs_examined"] > 0)))
    return _rows(spark, rows, "query string, lookups long, examined long, segments long, decoded long, bytes long, sane boolean")


def index_stats(spark, d):
    x = live(spark, d).stats()
    rows = [(s["id"], s["docs"], s["deleted"], s["live"], s["terms"], s["bytes"] > 0) for s in x["segments"]]
    return _rows(spark, [*rows, ("total", x["docs"], x["deleted"], x["ram_docs"], x["ram_terms"], x["generation"] == 2)], "seg string, docs long, deleted long, live long, terms long, sane boolean")


def index_lifecycle(spark, d):
    return _rows(spark, merged(spark, d)[1], "step string, segment string, docs long, terms long, generation long")


def index_snapshot(spark, d):
    return _rows(spark, [(i, seq, f["lang"]) for seq, i, f in live(spark, d).snapshot()], "_id string, seq long, lang string")


def index_docs(spark, d):
    """The stored documents after the merge: dense ids, stored fields as they came."""
    docs = merged(spark, d)[0].tables().docs
    return docs.select("doc", "_id", F.sha2(F.coalesce(F.col("fields")["message"], F.lit("")), 256).alias("message"), F.col("fields")["lang"].alias("lang"))


def scan_vs_index(spark, d):
    """Documents by the index and by a scan of the texts that evaluates the query on each document's terms."""
    q = "of AND (lang:en OR source:src3)"
    node = language.parse(q)
    keys = F.collect_set(F.concat("field", F.lit(":"), "term"))

    @F.udf("boolean")
    def holds(terms):
        return language.matches(node, set(terms))

    docs = corpus(spark, d).where(~F.col("_id").isin(*DELETED))
    scan = analysis.positions(docs.select(F.col("_id").alias("name"), "fields")).groupBy("name").agg(keys.alias("terms")).where(holds("terms")).select(F.col("name").alias("_id"), F.lit("scan").alias("by"))
    return _found(live, q)(spark, d).select("_id", F.lit("index").alias("by")).union(scan)


def lifecycle_small(spark, d):
    """Upserts, duplicates over segments, deletes, merges of nothing, names: what each step gives."""
    m, out = Manager(spark, _folder(spark)), []
    say = lambda step, x: out.append((len(out), step, json.dumps(x)))
    ids = lambda q: [h["_id"] for h in x.search(q)["hits"]]
    x = m.create("logs")
    for name in ("logs", "Bad", "a/b", "", "x" * 256):
        try:
            m.create(name)
        except ValueError as e:
            say(f"create {name[:5]}", type(e).__name__)
    try:
        m.get("none")
    except NotFound as e:
        say("get none", type(e).__name__)
    say("same handle", m.get("logs") is x)
    say("auto id", x.index_document("", {"message": "first words"}))
    say("explicit id", x.index_document("2", {"message": "second words"}))
    say("next auto id", x.index_document("", {"message": "third words"}))
    say("upsert", x.index_document("2", {"message": "newer words"}))
    say("second", ids("second"))
    say("words", ids("words"))
    say("flush", {k: v for k, v in x.flush().items()})
    say("flush of nothing", x.flush()["flushed"])
    say("again", x.index_document("2", {"message": "words again"}))
    say("two copies", ids("words"))
    say("delete", x.delete("2"))
    for i in ("2", ""):
        try:
            x.delete(i)
        except NotFound:
            say(f"delete {i}", "NotFound")
    say("live", ids("words"))
    say("seq restarts", x.index_document("9", {"message": "one more"}))
    os.makedirs(os.path.join(x.path, "segments", "seg-000041.partial"))
    say("name after a partial one", x.flush()["segment"])
    say("merge", {k: v for k, v in x.force_merge().items()})
    say("after merge", ids("words OR more"))
    for i in ("1", "3", "9"):
        x.delete(i)
    say("lone segment", x.force_merge()["merged"])
    x.index_document("z", {"message": "zz"})
    x.flush()
    x.delete("z")
    say("merge of nothing", {k: v for k, v in x.force_merge().items()})
    say("list", m.list())
    say("reopened", [h["_id"] for h in Manager(spark, os.path.dirname(m.root)).get("logs").search("words")["hits"]])
    return _rows(spark, out, "n long, step string, said string")


LIFECYCLE = [
    ("create logs", '"Exists"'), ("create Bad", '"BadName"'), ("create a/b", '"BadName"'), ("create ", '"BadName"'), ("create xxxxx", '"BadName"'), ("get none", '"NotFound"'), ("same handle", "true"),
    ("auto id", '["1", 0, false]'), ("explicit id", '["2", 1, false]'), ("next auto id", '["3", 2, false]'), ("upsert", '["2", 3, true]'), ("second", "[]"), ("words", '["1", "3", "2"]'),
    ("flush", '{"flushed": true, "segment": "seg-000001", "docs": 3, "terms": 4, "generation": 1}'), ("flush of nothing", "false"), ("again", '["2", 0, false]'), ("two copies", '["1", "3", "2", "2"]'),
    ("delete", "2"), ("delete 2", '"NotFound"'), ("delete ", '"NotFound"'), ("live", '["1", "3"]'), ("seq restarts", '["9", 0, false]'), ("name after a partial one", '"seg-000042"'),
    ("merge", '{"merged": true, "segment": "seg-000043", "segments_before": 2, "segments_after": 1, "docs": 3, "dropped": 1, "generation": 3}'), ("after merge", '["1", "3", "9"]'), ("lone segment", "false"),
    ("merge of nothing", '{"merged": true, "segment": "", "segments_before": 2, "segments_after": 0, "docs": 0, "dropped": 4, "generation": 5}'), ("list", '[["logs", 0]]'), ("reopened", "[]"),
]

REJECTED = [
    ("", "query is empty"), ("  ", "query is empty"), ("a1 b1", "expected AND, OR, or end of query"), ('foo"bar"', "unexpected quote"), (':"x y"', "unexpected quote"), ("NOT xx", "NOT queries are not supported"), ("-level", "NOT queries are not supported"), ("!level", "NOT queries are not supported"),
    ("level:-x", "NOT queries are not supported"), ("aa && bb", "is not supported; use AND or OR"), ("aa || bb", "is not supported; use AND or OR"), ('""', "empty phrase"), ('"open', "unclosed phrase"), ("()", "empty parentheses"), ("(aa", "missing closing parenthesis"),
    ("AND", "unexpected operator AND"), (")", "unexpected closing parenthesis"), ("aa AND", "unexpected end of query"), (":x", "missing field name in"), ("level:", "missing term in"), ("level:e", "is below the minimum length of 2"),
    ("foo-bar", "produces multiple tokens; use AND or OR between single terms"), ("aa:bb:cc", "produces multiple tokens; use AND or OR between single terms"), ("xx~3", "fuzzy distance must be 0, 1, or 2"), ("xx~", "fuzzy distance must be 0, 1, or 2"), ("~1", "fuzzy distance must be 0, 1, or 2"),
    ("aa~1~2", "fuzzy distance must be 0, 1, or 2"), ("aa~bb", "fuzzy distance must be 0, 1, or 2"), ('"timeout"', "needs at least two terms"), ('"  "', "needs at least two terms"), ('"-aa bb"', "NOT queries are not supported"),
]


def query_errors(spark, d):
    rows = []
    for q, part in REJECTED:
        try:
            language.parse(q)
            rows.append((q, "accepted"))
        except language.BadQuery as e:
            rows.append((q, part if part in str(e) else str(e)))
    return _rows(spark, rows, "query string, error string")


def _shape(x) -> str:
    if isinstance(x, (language.And, language.Or)):
        return "(" + (" & " if isinstance(x, language.And) else " | ").join(map(_shape, x.kids)) + ")"
    if isinstance(x, language.Phrase):
        return f"{x.field}={'+'.join(f'{t}@{g}' for t, g in x.terms)}"
    return f"{x.field}={x.term}" + (f"~{x.distance}" if isinstance(x, language.Fuzzy) else "")


PARSED = [
    ("aa and bb OR cc", "((message=aa & message=bb) | message=cc)", 3), ("aa AND (bb or cc)", "(message=aa & (message=bb | message=cc))", 3), ("aa OR bb OR cc", "(message=aa | message=bb | message=cc)", 3), ("((aa))", "message=aa", 1),
    ("a:b:cc", "a=cc", 1), ("Level:ERROR", "Level=error", 1), ("timeot~1", "message=timeot~1", 1), ("and~0", "message=and~0", 1), ("message:and", "message=and", 1), ('"timeout a db"', "message=timeout@0+db@2", 2), ('-level:"aa bb"', "-level=aa@0+bb@1", 2),
    ('aa OR "bb cc dd" OR aa', "(message=aa | message=bb@0+cc@1+dd@2 | message=aa)", 5), ("timeout!", "message=timeout", 1), ('a:b:"cc dd"', "a:b=cc@0+dd@1", 2), (" (aa)AND(bb) ", "(message=aa & message=bb)", 2),
]


def query_trees(spark, d):
    return _rows(spark, [(q, _shape(t := language.parse(q)), language.term_count(t)) for q, _, _ in PARSED], "query string, tree string, terms long")


LINES = [
    ('{"_id":"p","message":"hello","code":500,"price":1.50,"ok":true,"none":null}', "p", '{"code": "500", "message": "hello", "ok": "true", "price": "1.50"}', None), ('{"a":1e5,"a":"last"}', "", '{"a": "last"}', None), ('{"_id":7}', "7", "{}", None),
    ('{"a":"\\ud800x"}', "", '{"a": "�x"}', None), ("not json", None, None, "invalid JSON body"), ("[1]", None, None, "invalid JSON body"), ('{"a":1} {}', None, None, "invalid JSON body"), ('{"a":NaN}', None, None, "invalid JSON body"), ("null", None, None, "JSON body must be an object"),
    ('{"a":{"b":1}}', None, None, "nested values are not supported"), ('{"a":[1]}', None, None, "nested values are not supported"), ("[" * 100_000, None, None, "invalid JSON body"),
]


def ndjson_lines(spark, d):
    """A file of lines, good and bad, with blank ones and one above 1 MiB between."""
    folder = _folder(spark)
    os.makedirs(folder)
    with open(f"{folder}/a.json", "w", encoding="utf-8") as f:
        f.write("\n\n \n".join(x for x, *_ in LINES) + "\n" + '{"a":"' + "x" * (1 << 20) + '"}\n')
    got = ingest.read_ndjson(spark, f"{folder}/a.json")

    @F.udf("string")
    def ordered(fields):
        return None if fields is None else json.dumps(dict(sorted(fields.items())), ensure_ascii=False)

    return got.select(F.sha2("value", 256).alias("line"), "_id", ordered("fields").alias("fields"), "error")


def http_routes(spark, d):
    """Method, path, body, status and a part of the answer."""
    m, out = Manager(spark, _folder(spark)), []
    for method, url, body, _, keys in ROUTES:
        status, got = server.handle(m, method, url, body)
        out.append((len(out), method, url, status, json.dumps([got.get(k) for k in keys.split(",") if k] if isinstance(got, dict) else isinstance(got, str))))
    return _rows(spark, out, "n long, method string, url string, status long, said string")


#: (method, path, body, (status, answer), keys of the answer)
ROUTES = [
    ("GET", "/healthz", "", (200, '["ok"]'), "status"), ("GET", "/", "", (200, "true"), ""), ("PUT", "/indices/logs", "", (201, "[]"), ""), ("PUT", "/indices/logs", "", (409, "[]"), ""), ("PUT", "/indices/BAD", "", (400, "[]"), ""),
    ("GET", "/indices", "", (200, '[[{"name": "logs", "segment_count": 0}]]'), "indices"), ("POST", "/indices/none/_doc", "{}", (404, "[]"), ""), ("POST", "/indices/BAD/_doc", "{}", (400, "[]"), ""),
    ("POST", "/indices/logs/_doc", '{"_id":"x","code":500,"message":"boom two"}', (201, '["x", 0]'), "_id,_seq"), ("POST", "/indices/logs/_doc", '{"_id":"x","code":500,"message":"boom two"}', (200, '["x", 1]'), "_id,_seq"), ("POST", "/indices/logs/_doc", '{"a":{}}', (400, '["nested values are not supported"]'), "error"),
    ("POST", "/indices/logs/_bulk", '{"message":"one two"}\n\n{"_id":"x","message":"two three"}\nnot-json\n', (200, '[true, [{"_id": "1", "status": 201, "_seq": 2}, {"_id": "x", "status": 200, "_seq": 3}, {"status": 400, "error": "invalid JSON body"}]]'), "errors,items"),
    ("GET", "/indices/logs/_search?q=two&limit=1", "", (200, "[1, 1, 0]"), "docs_examined,postings_lookups,segments_searched"), ("GET", "/indices/logs/_search?q=two&limit=--5", "", (400, "[]"), ""), ("GET", "/indices/logs/_search?q=two&limit=-1", "", (400, "[]"), ""), ("GET", "/indices/logs/_search?q=two&limit=x", "", (400, "[]"), ""),
    ("GET", "/indices/logs/_search?q=two&sort=up", "", (400, "[]"), ""), ("GET", "/indices/logs/_search?q=", "", (400, "[]"), ""), ("GET", "/indices/none/_search?q=aa", "", (404, "[]"), ""), ("POST", "/indices/logs/_flush", "", (200, '[true, "seg-000001", 2, 3, 1]'), "flushed,segment,docs,terms,generation"),
    ("GET", "/indices/logs/_search?q=two&sort=tf&limit=0", "", (200, "[[], 1, 1]"), "hits,postings_lookups,segments_searched"), ("GET", "/indices/logs/_stats", "", (200, '[1, 2, 0, 0]'), "generation,docs,deleted,ram_docs"), ("DELETE", "/indices/logs/_doc/x", "", (200, '["x", 1]'), "_id,deleted"), ("DELETE", "/indices/logs/_doc/x", "", (404, "[]"), ""),
    ("POST", "/indices/logs/_forcemerge", "", (200, "[false, 1, 1]"), "merged,segments_before,segments_after"), ("GET", "/nowhere", "", (404, "[]"), ""),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (index_hits, index_counters, index_stats, index_lifecycle, index_snapshot, index_docs, scan_vs_index, lifecycle_small, query_errors, query_trees, ndjson_lines, http_routes)
    out = {f.__name__: f for f in named}
    return out | {f"index_{k}": _found(live, *v[:3]) for k, v in SEARCHES.items()} | {f"merged_{k}": _found(merged, *v[:3]) for k, v in SEARCHES.items()}


def _text(x) -> str:
    return "NULL::VARCHAR" if x is None else "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: str(x) if isinstance(x, int) else _text(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


def oracle_sql() -> dict[str, str]:
    import hashlib

    tail = {"top_tf": f" ORDER BY score DESC, {ORDER} LIMIT 10", "first": f" ORDER BY {ORDER} LIMIT 7"}
    local = f"s AS (SELECT doc_id, {SEG} AS seg, row_number() OVER (PARTITION BY {SEG} ORDER BY doc_id) - 1 AS doc FROM documents)"
    sized = f"""g AS (SELECT s.seg, s.doc, key, count(*) AS tf, list(pos ORDER BY pos) AS ps FROM p JOIN s USING (doc_id) GROUP BY ALL),
      e AS (SELECT seg, key, doc - lag(doc, 1, 0) OVER (PARTITION BY seg, key ORDER BY doc) AS dd, tf, ps FROM g),
      z AS (SELECT seg, key, {_vi("dd")} + {_vi("tf")} + list_sum(list_transform(range(1, len(ps) + 1), lambda i: {_vi("(ps[i] - CASE WHEN i > 1 THEN ps[i - 1] ELSE 0 END)")})) AS n FROM e),
      t1 AS (SELECT seg, key, ({_vi("count(*)")} + sum(n))::BIGINT AS bytes FROM z GROUP BY ALL)"""
    near = r"starts_with(key, 'message:') AND levenshtein(regexp_replace(substr(key, 9), '[^\x00-\x7F]', chr(1), 'g'), 'attion') <= 1"
    live_ram = f"s2 AS (SELECT DISTINCT seg, key FROM p JOIN s USING (doc_id) WHERE doc_id <> 42)"
    counters = " UNION ALL ".join(
        f"""SELECT '{q}' AS query, {lookups} AS lookups, least(5, (SELECT count(*) FROM ({_live_sql(leaves, where, 'a')})))::BIGINT AS examined, 2::BIGINT AS segments,
          (SELECT count(*) FROM t1 WHERE seg <> '_ram' AND ({keys}))::BIGINT AS decoded, (SELECT coalesce(sum(bytes), 0) FROM t1 WHERE seg <> '_ram' AND ({keys}))::BIGINT AS bytes, true AS sane"""
        for q, lookups, leaves, where, keys in (
            ("the", "3::BIGINT", [THE], "a > 0", "key = 'message:the'"), ("the OR the", "6::BIGINT", [THE], "a > 0", "key = 'message:the'"), ("attion~1", f"(SELECT count(*) FROM s2 WHERE {near})::BIGINT", [_near("message", "attion", 1)], "a > 0", near),
            ('"the of"', "6::BIGINT", [_phrase("message", "the", ("of", 1))], "a > 0", "key IN ('message:the', 'message:of')"), ("the AND lang:en AND nowhere", "9::BIGINT", [THE, EN, _tf("message:nowhere")], "a > 0 AND b > 0 AND c > 0", "key IN ('message:the', 'lang:en')"),
        )
    )
    dead = ", ".join(DELETED)
    per = f"SELECT {SEG} AS seg, count(*) AS docs, count(*) FILTER (doc_id IN ({dead})) AS deleted, count(*) FILTER (doc_id NOT IN ({dead})) AS live FROM documents WHERE doc_id >= {BUFFERED} GROUP BY 1"
    terms = f"SELECT {SEG} AS seg, count(DISTINCT key) AS terms FROM p WHERE doc_id <> 42 GROUP BY 1"
    kept = f"WITH x AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) - 1 AS doc FROM documents WHERE doc_id NOT IN ({dead}))"
    out = {
        "index_hits": f"SELECT _id, _seg, score::VARCHAR AS _score, lang, source FROM ({_sql([_tf('source:src7'), OF], 'a > 0 AND b > 0', 'a + b', ALIVE, '', f'doc_id::VARCHAR AS _id, {SEG} AS _seg, lang, source')})",
        "index_counters": f"{BASE}, {local}, {sized}, {live_ram} {counters}",
        "index_stats": f"{BASE}, y AS ({per}), k AS ({terms}) SELECT seg, docs, deleted, live, terms, true AS sane FROM y JOIN k USING (seg) UNION ALL SELECT 'total', (SELECT count(*) FROM documents WHERE doc_id NOT IN ({dead})), 2, (SELECT count(*) FROM documents WHERE doc_id < {BUFFERED} AND doc_id <> 42), (SELECT terms FROM k WHERE seg = '_ram'), true",
        "index_lifecycle": f"""{BASE}, y AS (SELECT {SEG} AS seg, count(*) AS docs FROM documents WHERE doc_id <> 42 GROUP BY 1), k AS ({terms}), x AS (SELECT y.seg, docs, terms FROM y JOIN k USING (seg))
          SELECT 'empty flush' AS step, '' AS segment, 0::BIGINT AS docs, 0::BIGINT AS terms, 0::BIGINT AS generation UNION ALL SELECT 'bulk 0', seg, docs, terms, 1 FROM x WHERE seg = 'seg-000001' UNION ALL SELECT 'bulk 1', seg, docs, terms, 2 FROM x WHERE seg = 'seg-000002'
          UNION ALL SELECT 'flush', 'seg-000003', docs, terms, 3 FROM x WHERE seg = '_ram' UNION ALL SELECT 'force merge of one', '', 0, 0, 4 UNION ALL SELECT 'present', 'merged', 0, 1, 4""",
        "index_snapshot": f"SELECT doc_id::VARCHAR AS _id, (row_number() OVER (ORDER BY doc_id) - 1 + CASE WHEN doc_id > 42 THEN 1 ELSE 0 END)::BIGINT AS seq, lang FROM documents WHERE doc_id < {BUFFERED} AND doc_id <> 42",
        "index_docs": f"{kept} SELECT doc, doc_id::VARCHAR AS _id, sha256(coalesce(text, '')) AS message, lang FROM x",
        "scan_vs_index": "SELECT _id, unnest(['index', 'scan']) AS by FROM (" + _live_sql([OF, EN, SRC3], "a > 0 AND (b > 0 OR c > 0)", "a") + ")",
        "lifecycle_small": _values([(i, *x) for i, x in enumerate(LIFECYCLE)], "n, step, said").replace("SELECT *", "SELECT n::BIGINT AS n, step, said", 1),
        "query_errors": _values(REJECTED, "query, error"),
        "query_trees": _values(PARSED, "query, tree, terms").replace("SELECT *", "SELECT query, tree, terms::BIGINT AS terms", 1),
        "ndjson_lines": _values([(hashlib.sha256(x.encode()).hexdigest(), i, f, e) for x, i, f, e in [*LINES, ('{"a":"' + "x" * (1 << 20) + '"}', None, None, "line too long")]], "line, _id, fields, error"),
        "http_routes": _values([(i, m, u, *x) for i, (m, u, _, x, _) in enumerate(ROUTES)], "n, method, url, status, said").replace("SELECT *", "SELECT n::BIGINT AS n, method, url, status::BIGINT AS status, said", 1),
    }
    out |= {f"index_{k}": _live_sql(*v[3:], tail.get(k, "")) for k, v in SEARCHES.items()}
    return out | {f"merged_{k}": _merged_sql(*v[3:], tail.get(k, "")) for k, v in SEARCHES.items()}
