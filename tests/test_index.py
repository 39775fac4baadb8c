import json
import os

import pytest

from siftwell.plans import compile as plan
from siftwell.sources.index import BadName, Corrupt, Exists, Manager, NotFound, read_commit
from siftwell.sources.server import handle

BOOLEAN = [("a1", "api", "error", "timeout calling db"), ("a2", "api", "info", "request ok"), ("w1", "worker", "error", "disk full"), ("a3", "api", "error", "connection reset"), ("d1", "db", "warn", "slow query timeout"), ("sv", "timeout", "info", "hello there")]
PHRASES = [("adj", "error", "", "timeout calling db"), ("swap", "error", "", "calling timeout"), ("gap", "info", "", "timeout db"), ("short", "info", "", "timeout a db"), ("punct", "info", "", "timeout, db"), ("repeat", "warn", "", "foo foo"), ("apart", "warn", "", "foo bar foo"), ("other", "error", "timeout calling", "request ok")]
FUZZY = [("near", "api", "error", "timeout calling db"), ("also", "api", "info", "timeots in the log"), ("other", "worker", "error", "disk full"), ("swap", "api", "info", "from the cache"), ("exactish", "api", "", "timeot once")]


def ids(index, q, **k):
    return [h["_id"] for h in index.search(q, **k)["hits"]]


def filled(spark, path, rows, names=("service", "level", "message")):
    index = Manager(spark, str(path)).create("x")
    for r in rows:
        index.index_document(r[0], {k: v for k, v in zip(names, r[1:]) if v})
    return index


@pytest.mark.parametrize("flushed", [False, True])
def test_boolean(spark, tmp_path, flushed):
    index = filled(spark, tmp_path, BOOLEAN)
    if flushed:
        index.flush()
    for q, want in {
        "level:error AND service:api": "a1 a3", "level:info OR service:db": "a2 d1 sv", "level:error AND service:api OR service:db": "a1 a3 d1", "level:error AND (service:api OR service:db)": "a1 a3",
        "message:timeout!": "a1 d1", "service:timeout": "sv", " level:ERROR and service:API ": "a1 a3", "level:debug": "", "(level:missing AND service:api) OR service:db": "d1",
    }.items():
        assert ids(index, q) == want.split(), q
    got = index.search("level:error AND service:api AND message:timeout")
    assert got["postings_lookups"] == 3 and got["docs_examined"] == 1 and got["segments_searched"] == int(flushed)
    assert ids(index, "timeout", limit=0) == [] and ids(index, "level:error", limit=2) == ["a1", "w1"]


def test_phrases(spark, tmp_path):
    index = filled(spark, tmp_path, PHRASES, ("level", "service", "message"))
    for _ in range(2):
        for q, want in {'"timeout calling"': "adj", '"timeout db"': "gap punct", 'service:"timeout calling"': "other", 'level:info AND "timeout db"': "gap punct", '"foo foo"': "repeat", '"disk full"': "", '"timeout a db"': "adj short"}.items():
            assert ids(index, q) == want.split(), q
        index.flush()


def test_fuzzy(spark, tmp_path):
    index = filled(spark, tmp_path, FUZZY)
    for q, want, n in (("timeot~1", "near also exactish", 3), ("timeout~0", "near", 1), ("zzzz~1", "", 0), ("level:eror~1", "near other", 1), ("form~1", "", 0), ("form~2", "swap", 1)):
        got = index.search(q)
        assert [h["_id"] for h in got["hits"]] == want.split() and got["postings_lookups"] == n, q


def test_rank_across_segments(spark, tmp_path):
    index = filled(spark, tmp_path, [])
    index.index_document("low", {"message": "timeout once"})
    index.flush()
    index.index_document("high", {"message": "timeout timeout timeots"})
    index.flush()
    index.index_document("ram", {"message": "timeot"})
    assert ids(index, "timeot~1") == ["low", "high", "ram"] and index.search("timeot~1")["postings_lookups"] == 4
    got = index.search("timeot~1", rank=True)["hits"]
    assert [(h["_id"], h["_score"], h["_seg"]) for h in got] == [("high", "3", "seg-000002"), ("low", "1", "seg-000001"), ("ram", "1", "_ram")]


def test_lifecycle(spark, tmp_path):
    m = Manager(spark, str(tmp_path))
    index = m.create("logs")
    assert not index.flush()["flushed"]
    for i, x in enumerate("abc"):
        index.index_document(x, {"message": f"word{x} common"})
        got = index.flush()
        assert (got["segment"], got["generation"]) == (f"seg-00000{i + 1}", i + 1)
    assert [s["id"] for s in read_commit(index.path)["segments"]] == ["seg-000004"] and read_commit(index.path)["generation"] == 4
    os.makedirs(os.path.join(index.path, "segments", "seg-000099"))
    index.index_document("a", {"message": "common again"})
    assert ids(index, "common") == ["a", "b", "c", "a"]
    assert index.flush()["segment"] == "seg-000100"
    assert index.delete("a") == 2 and ids(index, "common") == ["b", "c"]
    with pytest.raises(NotFound):
        index.delete("a")
    stats = index.stats()
    assert stats["docs"] == 2 and stats["deleted"] == 2 and [s["live"] for s in stats["segments"]] == [2, 0]
    merged = index.force_merge()
    assert merged["merged"] and merged["docs"] == 2 and merged["dropped"] == 2 and merged["segments_after"] == 1
    assert ids(index, "worda") == [] and ids(Manager(spark, str(tmp_path)).get("logs"), "common") == ["b", "c"]
    index.delete("b"), index.delete("c")
    index.index_document("z", {"message": "zz top"})
    index.flush(), index.delete("z")
    assert index.force_merge()["segment"] == "" and ids(index, "common") == []
    assert m.list() == [("logs", 0)]
    with pytest.raises(Exists):
        m.create("logs")
    for bad in ("", "A", "a/b", "..", "a" * 256, "a\n"):
        with pytest.raises(BadName):
            m.create(bad)
    with pytest.raises(NotFound):
        m.get("none")


def test_missing_segment(spark, tmp_path):
    import shutil

    index = filled(spark, tmp_path, BOOLEAN)
    index.flush()
    shutil.rmtree(os.path.join(index.path, "segments", "seg-000001"))
    with pytest.raises(FileNotFoundError):
        index.search("timeout")


def test_ids(spark, tmp_path):
    index = filled(spark, tmp_path, [])
    assert index.index_document("1", {"message": "one"})[0] == "1" and index.index_document("", {"message": "two"})[0] == "2"
    index.index_document("42", {"message": "old words"})
    assert index.index_document("42", {"message": "new words"}) == ("42", 3, True)
    assert ids(index, "old") == [] and ids(index, "new") == ["42"]


def test_bulk_segment_and_stream(spark, tmp_path):
    from siftwell.streaming.ingest import follow

    index = filled(spark, tmp_path / "i", [])
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"_id":"p","message":"hello stream"}\n\n{"message":"hello again"}\nnot json\n')
    follow(spark, str(tmp_path / "in"), index, str(tmp_path / "c")).awaitTermination()
    got = ids(index, "hello")
    assert len(got) == 2 and "p" in got


def test_http(spark, tmp_path):
    m = Manager(spark, str(tmp_path))
    call = lambda *a: handle(m, *a)
    assert call("GET", "/healthz") == (200, {"status": "ok"}) and call("GET", "/")[0] == 200
    assert call("PUT", "/indices/logs")[0] == 201 and call("PUT", "/indices/logs")[0] == 409 and call("PUT", "/indices/BAD")[0] == 400
    assert call("POST", "/indices/none/_doc", "{}")[0] == 404
    assert call("POST", "/indices/logs/_doc", '{"_id":"x","code":500,"price":1.50,"message":"boom"}') == (201, {"_id": "x", "_seq": 0})
    assert call("POST", "/indices/logs/_doc", '{"_id":"x","code":500,"price":1.50,"message":"boom"}')[0] == 200
    assert call("POST", "/indices/logs/_doc", '{"a":{"b":1}}')[0] == 400 and call("POST", "/indices/logs/_doc", "{")[0] == 400 and call("POST", "/indices/logs/_doc", "null")[1]["error"] == "JSON body must be an object"
    status, got = call("POST", "/indices/logs/_bulk", '{"message":"one two"}\n\n{"message":"two three"}\nnot-json\n')
    assert status == 200 and got["errors"] and [x["status"] for x in got["items"]] == [201, 201, 400]
    assert call("POST", "/indices/logs/_bulk", "x" * (1 << 21))[0] == 400
    status, got = call("GET", "/indices/logs/_search?q=code:500")
    assert status == 200 and got["hits"][0]["price"] == "1.50" and json.dumps(got)
    assert call("GET", "/indices/logs/_search?q=two&limit=-1")[0] == 400 and call("GET", "/indices/logs/_search?q=two&sort=up")[0] == 400 and call("GET", "/indices/logs/_search?q=")[0] == 400
    assert len(call("GET", "/indices/logs/_search?q=two&sort=tf&limit=1")[1]["hits"]) == 1
    assert call("POST", "/indices/logs/_flush")[1]["docs"] == 3 and call("GET", "/indices/logs/_stats")[1]["docs"] == 3
    assert call("DELETE", "/indices/logs/_doc/x")[1] == {"_id": "x", "deleted": 1} and call("DELETE", "/indices/logs/_doc/x")[0] == 404
    assert call("POST", "/indices/logs/_forcemerge")[1]["merged"] is False and call("GET", "/indices")[1] == {"indices": [{"name": "logs", "segment_count": 1}]}


def test_work_is_small(spark, tmp_path):
    """Of 150 documents a selective query looks up two lists and examines four; of long documents it reads less than a hundredth."""
    index = Manager(spark, str(tmp_path)).create("w")
    pad = " ".join(f"pad{k}" for k in range(512))
    for i in range(150):
        level, service = ("error" if i % 10 == 0 else "info"), ("api" if i % 37 == 0 or i % 10 == 0 and i < 40 else "db")
        index.index_document(f"d{i:03d}", {"level": level, "service": service, "message": f"needle{i % 75} {pad}"})
    want = [f"d{i:03d}" for i in range(150) if i % 10 == 0 and (i % 37 == 0 or i < 40)]
    got = index.search("level:error AND service:api")
    assert [h["_id"] for h in got["hits"]] == want and (got["postings_lookups"], got["docs_examined"], got["io"]["postings_decoded"]) == (2, 4, 0)
    index.flush()
    whole = index.tables()
    all_postings, all_docs = whole.terms.agg({"encoded_len": "sum"}).first()[0], 150 * len(pad)
    for q, lists, n in (("needle7", 1, 2), ("needle7 OR needle7", 1, 2), ("needle7 AND level:error", 2, 0), ("needl7~1", 1, 2)):
        got = index.search(q)
        assert got["docs_examined"] == n and got["io"]["postings_decoded"] == lists, q
        assert got["io"]["postings_bytes_read"] < all_postings / 100 and got["io"]["docs_bytes_read"] <= n * (len(pad) + 200) < all_docs / 50, q
        assert got["io"]["metadata_bytes_read"] > 0


def test_rare_key_first(spark, tmp_path, monkeypatch):
    index = filled(spark, tmp_path, [(str(i), "api" if i == 7 else "db", "error", "common words here") for i in range(40)])
    index.flush()
    t = index.tables()
    assert t.deletes is None
    text = plan.matched(t, plan.parse("service:api AND common"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "LeftSemi" in text and "SortMergeJoin" not in text
    text = plan.matched(t, plan.parse("level:error AND common"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text  # without deletes, and with keys alike, nothing is joined
    assert ids(index, "service:api AND common") == ["7"] and ids(index, "service:nobody AND common") == []
    monkeypatch.setattr(plan, "MOST_KEYS", 0)
    assert ids(index, "comon~1 AND service:api") == ["7"]


def test_many_indexers_while_flushing_and_searching(spark, tmp_path):
    import threading

    index = Manager(spark, str(tmp_path)).create("x")
    index.index_document("first", {"message": "common"})
    seen, errors = [], []

    def write(k):
        for j in range(5):
            index.index_document(f"{k}-{j}", {"message": "common words"})

    def look():
        try:
            for _ in range(3):
                seen.append(ids(index, "common", limit=1000))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(32)] + [threading.Thread(target=look), threading.Thread(target=index.flush), threading.Thread(target=index.flush)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and all(len(x) == len(set(x)) and "first" in x for x in seen)
    index.flush()
    got = ids(index, "common", limit=1000)
    assert len(got) == len(set(got)) == 161
    index.verify()


def test_documents_indexed_during_a_flush_stay_buffered(spark, tmp_path, monkeypatch):
    index = Manager(spark, str(tmp_path)).create("x")
    index.index_document("a", {"message": "old words"})
    index.index_document("b", {"message": "old words"})
    write = index._write

    def slow(*args):
        index.index_document("a", {"message": "new words"})
        index.index_document("c", {"message": "new words"})
        assert ids(index, "words") == ["b", "a", "c"]
        write(*args)

    monkeypatch.setattr(index, "_write", slow)
    index.flush()
    assert ids(index, "old") == ["a", "b"] and ids(index, "new") == ["a", "c"] and [i for _, i, _ in index.snapshot()] == ["a", "c"]


def test_searches_outlive_a_merge(spark, tmp_path):
    index = filled(spark, tmp_path, BOOLEAN)
    index.flush()
    index.index_document("later", {"message": "timeout"})
    index.flush()
    with index._reading() as (commit, ram):
        tables = index.tables(commit, ram)
        index.force_merge()
        assert plan.search(tables, "timeout", None).count() == 3 and len(index.trash) == 2
    assert not index.trash and os.listdir(os.path.join(index.path, "segments")) == ["seg-000003"]


@pytest.mark.parametrize("bad", ["{", "[]", '{"id": "seg-000009", "docs": 6, "terms": 1, "created_ns": 1}', '{"id": "seg-000001", "docs": -1, "terms": 1, "created_ns": 1}'])
def test_refuses_a_segment_of_another_name(spark, tmp_path, bad):
    index = filled(spark, tmp_path, BOOLEAN)
    index.flush()
    with open(os.path.join(index.path, "segments", "seg-000001", "meta.json"), "w") as f:
        f.write(bad)
    with pytest.raises(Corrupt):
        index.search("timeout")


def test_verify_finds_lost_rows(spark, tmp_path):
    index = filled(spark, tmp_path, BOOLEAN)
    index.flush()
    index.verify()
    path = os.path.join(index.path, "segments", "seg-000001", "postings")
    spark.read.parquet(path).where("key <> 'level:error'").write.parquet(path + ".new")
    os.rename(path, path + ".old"), os.rename(path + ".new", path)
    with pytest.raises(Corrupt):
        index.verify()


def test_a_replayed_batch_is_indexed_once(spark, tmp_path):
    index = filled(spark, tmp_path, [])
    docs = spark.createDataFrame([("p", {"message": "hello"})], "_id string, fields map<string,string>")
    assert index.index_all(docs, ("c", 0))["flushed"] and not index.index_all(docs, ("c", 0))["flushed"] and index.index_all(docs, ("c", 1))["flushed"]
    assert ids(index, "hello") == ["p", "p"]


def test_bulk_over_a_socket(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from siftwell.sources.server import serve

    m = Manager(spark, str(tmp_path))
    index = m.create("logs")
    server = serve(m, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/indices/logs/_bulk"
    got = json.load(urllib.request.urlopen(urllib.request.Request(url, b'{"message":"one"}\n\n{"message":"two"}', method="POST")))
    assert [x["status"] for x in got["items"]] == [201, 201]
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(urllib.request.Request(url, b'{"message":"three"}\n{"message":"' + b"x" * (1 << 20) + b'"}\n{"message":"four"}\n', method="POST"))
    assert e.value.code == 400 and sorted(index.ram) == ["1", "2", "3"]
    server.shutdown()
