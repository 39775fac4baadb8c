"""Indices on disk: committed Parquet segments, an in-memory buffer, deletes, flush and merge.

``segments.json`` names the segments in order, with the version of each one's deletes; it is
replaced by a rename, so readers see the old or the new list. Paths are on a local or mounted
file system, where a rename is atomic.

A search takes its snapshot (commit and buffer) under a short lock and runs without it. Flush,
delete and merge exclude each other, not searches or new documents: what is indexed while a flush
writes stays in the buffer. Merged segments are removed when no search that may read them is left.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.analysis import analyze, scoped
from siftwell.operators import build
from siftwell.plans import compile as plan
from siftwell.plans.query import Fuzzy, Phrase, leaves, parse

AUTO_MERGE, FORCE_MERGE = 3, 2
RAM = "_ram"
DOCS = "seg_ord int, seg string, doc long, _id string, fields map<string,string>"
POSTINGS = ", ".join(["seg_ord int", "seg string", "key string", *build.FORMS["full"]])
CODEC = "zstd"
TERMS = "seg_ord int, seg string, key string, field string, term string, term_len int, df long, cf long, encoded_len long"


class NotFound(KeyError):
    """No such index or document."""


class Exists(ValueError):
    """The index exists already."""


class Corrupt(ValueError):
    """A committed segment that isn't what a writer leaves."""


class BadName(ValueError):
    """A name that no index can have."""


def check_name(name: str) -> None:
    if not re.fullmatch(r"[a-z0-9_-]{1,255}", name):
        raise BadName(f"invalid index name {name!r}")


class Manager:
    """Indices below one folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.root, self.live, self.lock = spark, os.path.join(base, "indices"), {}, threading.RLock()
        os.makedirs(self.root, exist_ok=True)

    def create(self, name: str) -> Index:
        check_name(name)
        path = os.path.join(self.root, name)
        with self.lock:
            if os.path.exists(path):
                raise Exists(f"index {name} already exists")
            os.makedirs(os.path.join(path, "segments"))
            write_commit(path, {"generation": 0, "segments": []})
            return self.get(name)

    def get(self, name: str) -> Index:
        """The open index; all callers share its buffer."""
        check_name(name)
        path = os.path.join(self.root, name)
        with self.lock:
            if not os.path.isdir(path):
                raise NotFound(f"index {name} not found")
            return self.live.setdefault(name, Index(self.spark, name, path))

    def list(self) -> list[tuple[str, int]]:
        """(name, number of segments), sorted; an unreadable commit has none."""
        out = []
        for name in sorted(os.listdir(self.root)):
            try:
                check_name(name)
                out.append((name, len(read_commit(os.path.join(self.root, name))["segments"])))
            except BadName:
                continue
            except (OSError, ValueError):
                out.append((name, 0))
        return out


def read_commit(path: str) -> dict:
    with open(os.path.join(path, "segments.json"), encoding="utf-8") as f:
        return json.load(f)


def _sync(path: str) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def _save_json(path: str, value: dict) -> None:
    """Replace a file, whole and durably."""
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(value, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + ".tmp", path)
    _sync(os.path.dirname(path))


def write_commit(path: str, commit: dict) -> None:
    _save_json(os.path.join(path, "segments.json"), commit)


class Index:
    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path
        self.lock, self.writer, self.counter, self.next_doc = threading.RLock(), threading.RLock(), 0, 0
        self.ram: dict[str, tuple[int, dict[str, str]]] = {}
        self.readers, self.trash = 0, []

    # buffer

    def index_document(self, doc_id: str, fields: dict[str, str]) -> tuple[str, int, bool]:
        """(_id, sequence, whether it replaced a buffered copy)."""
        with self.lock:
            if not doc_id:
                self.counter += 1
                while str(self.counter) in self.ram:
                    self.counter += 1
                doc_id = str(self.counter)
            replaced = self.ram.pop(doc_id, None) is not None
            seq, self.next_doc = self.next_doc, self.next_doc + 1
            self.ram[doc_id] = seq, {k: v for k, v in fields.items() if k != "_id"}
            return doc_id, seq, replaced

    def index_all(self, docs: DataFrame, batch: tuple[str, int] | None = None, order: str | None = None) -> dict:
        """Write a DataFrame (_id, fields) as a segment of its own, without the buffer: the way in for bulk data. Ids must not be empty.

        ``order`` names a column of whole numbers in whose order the documents stand; it is read once before the texts
        are, so ``docs`` must give the same rows again. Without it they stand as the partitions of ``docs`` bring them,
        which for files is by their sizes, and are written aside first.

        ``batch`` is a stream's name and the number of its batch: the commit keeps the last number of each
        stream, and a batch up to that isn't written again."""
        with self.writer:
            commit = read_commit(self.path)
            if batch is not None and batch[1] <= commit.get("batches", {}).get(batch[0], -1):
                return {"flushed": False, "segment": "", "docs": 0, "terms": 0, "generation": commit["generation"]}
            seg = self._next_id(commit)
            fields = F.map_concat(F.map_filter("fields", lambda k, v: k != "_id"), F.create_map(F.lit("_id"), F.col("_id"))).alias("fields")
            if order:
                body = docs.select("_id", fields, F.coalesce(F.col(order).cast("long"), F.lit(build.NONE)).alias("_m"))
                self._write(seg, build.renumber(body, "_m", size=build.DEAL).select(F.col("new_doc").alias("doc"), "_id", "fields"), None)
            else:
                # partition and place in it give each row its order; partitions are numbered by their counts
                stage = self._seg(seg) + ".stage"
                docs.select("_id", fields).withColumn("_m", F.monotonically_increasing_id()).write.mode("overwrite").parquet(stage, compression=CODEC)
                placed = self.spark.read.parquet(stage)
                at, offsets = 0, []
                for r in sorted(placed.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("n")).collect()):
                    offsets.append((r._p, at))
                    at += r.n
                begins = self.spark.createDataFrame(offsets, "_p long, _o long")
                numbered = placed.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(begins), "_p")  # a row for each partition
                self._write(seg, numbered.select((F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("doc"), "_id", "fields"), None)
                shutil.rmtree(stage)
            if batch is not None:
                commit.setdefault("batches", {})[batch[0]] = batch[1]
            return self._publish(commit, seg)

    def _buffer(self, ram: dict[str, tuple[int, dict[str, str]]]) -> DataFrame:
        rows = sorted((seq, i, {**f, "_id": i}) for i, (seq, f) in ram.items())
        return self.spark.createDataFrame([(2**31 - 1, RAM, seq, i, f) for seq, i, f in rows], DOCS)

    def snapshot(self) -> list[tuple[int, str, dict[str, str]]]:
        """All buffered documents in order: (sequence, _id, fields)."""
        with self.lock:
            return sorted((seq, i, dict(f)) for i, (seq, f) in self.ram.items())

    @contextmanager
    def _reading(self) -> Iterator[tuple[dict, dict]]:
        """The commit and the buffer as they are now; segments merged meanwhile stay readable."""
        with self.lock:
            self.readers += 1
            seen = read_commit(self.path), dict(self.ram)
        try:
            yield seen
        finally:
            with self.lock:
                self.readers -= 1
                self._sweep()

    def _sweep(self) -> None:
        if not self.readers:
            for seg in self.trash:
                shutil.rmtree(self._seg(seg), ignore_errors=True)
            self.trash.clear()

    # tables

    def _seg(self, seg: str) -> str:
        return os.path.join(self.path, "segments", seg)

    def meta(self, seg: str) -> dict:
        """What a segment says of itself; a segment without it, or of another name, is refused."""
        try:
            with open(os.path.join(self._seg(seg), "meta.json"), encoding="utf-8") as f:
                meta = json.load(f)
            if meta["id"] != seg or min(meta["docs"], meta["terms"], meta["created_ns"]) < 0:
                raise ValueError(f"segment {seg} names itself {meta['id']!r}")
        except FileNotFoundError:
            raise
        except (KeyError, TypeError, ValueError) as e:
            raise Corrupt(f"segment {seg}: bad meta.json: {e}") from e
        return meta

    def _read(self, commit: dict, table: str, schema: str) -> DataFrame:
        """Only committed folders are read, in commit order."""
        out = None
        for n, s in enumerate(commit["segments"]):
            self.meta(s["id"])
            path = os.path.join(self._seg(s["id"]), table)
            if not os.path.isdir(path):
                raise FileNotFoundError(path)
            part = self.spark.read.parquet(path).select(F.lit(n).alias("seg_ord"), F.lit(s["id"]).alias("seg"), *[c.split()[0] for c in schema.split(", ")[2:]])
            out = part if out is None else out.union(part)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _deletes(self, commit: dict) -> DataFrame | None:
        """(seg, doc) of all deletes; None where no segment has any."""
        out = None
        for s in commit["segments"]:
            if s.get("deletes"):
                part = self.spark.read.parquet(f"{self._seg(s['id'])}/deletes-{s['deletes']}").select(F.lit(s["id"]).alias("seg"), "doc")
                out = part if out is None else out.union(part)
        return out

    def tables(self, commit: dict | None = None, ram: dict | None = None) -> plan.Tables:
        """The committed segments of ``commit`` (the present one if None), and the buffer ``ram`` after them."""
        if commit is None:
            with self.lock:
                commit, ram = read_commit(self.path), dict(self.ram)
        docs, posts, terms = self._read(commit, "docs", DOCS), self._read(commit, "postings", POSTINGS), self._read(commit, "terms", TERMS)
        if ram:
            buffered = self._buffer(ram)
            own = build.lists(buffered.select("seg_ord", "seg", "doc", "fields"), laid=True)
            docs, posts = docs.unionByName(buffered), posts.unionByName(own)
            terms = terms.unionByName(_terms(own).withColumn("seg_ord", F.lit(2**31 - 1)))
        return plan.Tables(docs, build.rows(posts), terms, self._deletes(commit), sum(s.get("n_deleted", 0) for s in commit["segments"]), True)

    def verify(self) -> None:
        """Read all committed segments and refuse what no writer leaves: counts unlike meta.json's, ids with gaps, postings out of order or of no document."""
        with self._reading() as (commit, _):
            t = self.tables(commit)
            for s in commit["segments"]:
                meta, mine = self.meta(s["id"]), F.col("seg") == s["id"]
                d = t.docs.where(mine).agg(F.count("*").alias("n"), F.count_distinct("doc").alias("u"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).first()
                if (d.n, d.u) != (meta["docs"],) * 2 or d.n and (d.lo, d.hi) != (0, d.n - 1) or t.terms.where(mine).count() != meta["terms"]:
                    raise Corrupt(f"segment {s['id']}: documents or terms aren't those of meta.json")
            lists = self._read(commit, "postings", POSTINGS)
            n = {s["id"]: self.meta(s["id"])["docs"] for s in commit["segments"]}
            far = F.lit(False)
            for seg, docs in n.items():  # documents are 0..n-1, as was seen above
                far = far | ((F.col("seg") == seg) & ((F.col("first") < 0) | (F.col("last") >= docs)))
            if any(build.faults(lists, t.terms, sum(n.values()))) or lists.where(far).limit(1).count():
                raise Corrupt("postings and dictionary disagree")

    # search

    def search(self, query: str, limit: int = 10, rank: bool = False) -> dict:
        """Hits in order and the counters of the search."""
        began = time.monotonic()
        if limit < 0:
            raise ValueError("limit must be >= 0")
        node = parse(query)
        with self._reading() as (commit, ram):
            tables = self.tables(commit, ram)
            rows = [r.asDict() for r in plan.hits(tables, query, limit, rank).collect()] if limit else []
            found = [{**r.pop("fields"), **r} for r in rows]
            n = len(commit["segments"])
            wide = {x for x in leaves(node) if isinstance(x, Fuzzy) and x.distance}
            looked = sum(0 if x in wide else len(x.terms) if isinstance(x, Phrase) else 1 for x in leaves(node)) * (n + bool(ram))
            chosen = tables.terms.where(F.col("key").isin(plan.exact_keys(node))).select("seg", "key", "encoded_len", F.lit(0).alias("times"))
            for x in wide:
                near = plan.fuzzy_keys(tables.terms, x)
                times = sum(y == x for y in leaves(node))  # a repeated leaf is looked up again
                chosen = chosen.union(tables.terms.join(near, ["seg", "key"], "left_semi").select("seg", "key", "encoded_len", F.lit(times).alias("times")))
            each = chosen.groupBy("seg", "key").agg(F.first("encoded_len").alias("b"), F.sum("times").alias("times"))
            disk = F.col("seg") != RAM
            io = each.agg(F.count_if(disk).alias("n"), F.coalesce(F.sum(F.when(disk, F.col("b"))), F.lit(0)).alias("b"), F.coalesce(F.sum("times"), F.lit(0)).alias("near")).first()
            body = [len(json.dumps({k: v for k, v in h.items() if k not in ("_seg", "_doc", "_score")}, ensure_ascii=False, separators=(",", ":")).encode()) for h in found if h["_seg"] != RAM]
            docs_bytes = sum(b + max(1, -(-b.bit_length() // 7)) for b in body)
            meta = os.path.getsize(os.path.join(self.path, "segments.json")) + sum(_bytes(os.path.join(self._seg(s["id"]), "terms")) + os.path.getsize(os.path.join(self._seg(s["id"]), "meta.json")) for s in commit["segments"])
        return {
            "hits": found, "took_ms": int((time.monotonic() - began) * 1000), "postings_lookups": looked + io.near, "docs_examined": len(found), "segments_searched": n,
            "io": {"metadata_bytes_read": meta, "postings_bytes_read": io.b, "docs_bytes_read": docs_bytes, "postings_decoded": io.n},
        }

    # lifecycle

    def _next_id(self, commit: dict) -> str:
        names = [s["id"] for s in commit["segments"]] + os.listdir(os.path.join(self.path, "segments"))
        return f"seg-{max([0, *(int(m[1]) for x in names if (m := re.match(r'seg-(\d+)', x)))]) + 1:06d}"

    def _write(self, seg: str, docs: DataFrame, posts: DataFrame | None) -> None:
        """docs(doc, _id, fields) and their postings, as packed lists, as a segment: written aside, then renamed.

        Documents are written where they lie. Lists are dealt by key and sorted inside each file, so that pages are skipped by key."""
        part = self._seg(seg) + ".partial"
        shutil.rmtree(part, ignore_errors=True)
        docs.write.parquet(f"{part}/docs", compression=CODEC)
        stored = self.spark.read.parquet(f"{part}/docs")
        n = stored.count()
        if posts is None:
            posts = build.lists(stored.select("doc", "fields"), True, "packed")
        build.gathered(posts, n).write.parquet(f"{part}/postings", compression=CODEC)
        _terms(self.spark.read.parquet(f"{part}/postings").withColumn("seg", F.lit(seg)), n).drop("seg").sortWithinPartitions("key").write.parquet(f"{part}/terms", compression=CODEC)
        terms = self.spark.read.parquet(f"{part}/terms").count()
        _save_json(os.path.join(part, "meta.json"), {"id": seg, "docs": n, "terms": terms, "created_ns": time.time_ns()})
        os.rename(part, self._seg(seg))
        _sync(os.path.join(self.path, "segments"))

    def _publish(self, commit: dict, seg: str, frozen: dict | None = None) -> dict:
        commit["generation"] += 1
        commit["segments"].append({"id": seg, "generation": commit["generation"]})
        with self.lock:  # searches see the documents in the buffer or in the segment, never in both or none
            write_commit(self.path, commit)
            for i, row in (frozen or {}).items():
                if self.ram.get(i) is row:  # what was indexed again meanwhile stays
                    del self.ram[i]
            self.next_doc = self.next_doc if self.ram else 0
        meta = self.meta(seg)
        out = {"flushed": True, "segment": seg, "docs": meta["docs"], "terms": meta["terms"], "generation": commit["generation"]}
        self._merge(AUTO_MERGE)
        return out

    def flush(self) -> dict:
        """The buffer as a segment; from three segments on, all are merged. What is returned is from before the merge."""
        with self.writer:
            commit = read_commit(self.path)
            with self.lock:
                frozen = dict(self.ram)
            if not frozen:
                return {"flushed": False, "segment": "", "docs": 0, "terms": 0, "generation": commit["generation"]}
            seg = self._next_id(commit)
            rows = sorted((seq, i, {**f, "_id": i}) for i, (seq, f) in frozen.items())
            self._write(seg, self.spark.createDataFrame([(n, i, f) for n, (_, i, f) in enumerate(rows)], "doc long, _id string, fields map<string,string>"), None)
            return self._publish(commit, seg, frozen)

    def delete(self, doc_id: str) -> int:
        """Delete all live copies, buffered and committed; their number."""
        with self.writer:
            n = 0
            with self.lock:
                if doc_id and self.ram.pop(doc_id, None) is not None:
                    n = 1
                    self.next_doc = self.next_doc if self.ram else 0
            commit = read_commit(self.path)
            gone = self._deletes(commit)
            found = self._read(commit, "docs", DOCS).where(F.col("_id") == doc_id).select("seg", "doc")
            found = found if gone is None else found.join(gone, ["seg", "doc"], "left_anti")
            counts = {r.seg: r.n for r in found.groupBy("seg").agg(F.count("*").alias("n")).collect()} if doc_id else {}
            for s in commit["segments"]:
                if s["id"] in counts:
                    version = s.get("deletes", 0) + 1
                    both = found.where(F.col("seg") == s["id"])
                    both = both if gone is None else gone.where(F.col("seg") == s["id"]).union(both)
                    both.select("doc").write.mode("overwrite").parquet(f"{self._seg(s['id'])}/deletes-{version}")
                    s["deletes"], s["n_deleted"] = version, s.get("n_deleted", 0) + counts[s["id"]]
            if counts:
                with self.lock:
                    write_commit(self.path, commit)
            n += sum(counts.values())
            if not n:
                raise NotFound(f"document {doc_id!r} not found")
            return n

    def force_merge(self) -> dict:
        with self.writer:
            return self._merge(FORCE_MERGE)

    def _merge(self, least: int) -> dict:
        commit = read_commit(self.path)
        old = commit["segments"]
        if len(old) < least:
            return {"merged": False, "segment": "", "segments_before": len(old), "segments_after": len(old), "docs": 0, "dropped": 0, "generation": commit["generation"]}
        t = self.tables(commit)
        docs, posts = build.merge(t.docs, self._read(commit, "postings", POSTINGS), t.deletes, "packed")
        dropped = sum(s.get("n_deleted", 0) for s in old)
        seg = self._next_id(commit)
        n = sum(self.meta(s["id"])["docs"] for s in old) - dropped
        if n:
            self._write(seg, docs, posts)
        else:
            seg = ""
        commit["generation"] += 1
        commit["segments"] = [{"id": seg, "generation": commit["generation"]}] if seg else []
        with self.lock:
            write_commit(self.path, commit)
            self.trash += [s["id"] for s in old]
            self._sweep()
        return {"merged": True, "segment": seg, "segments_before": len(old), "segments_after": len(commit["segments"]), "docs": n, "dropped": dropped, "generation": commit["generation"]}

    def stats(self) -> dict:
        """Counts of the segments, by their own words and the commit's, and of the buffer; no table is read."""
        with self._reading() as (commit, ram):
            segments = []
            for s in commit["segments"]:
                meta, gone = self.meta(s["id"]), s.get("n_deleted", 0)
                segments.append({"id": s["id"], "docs": meta["docs"], "deleted": gone, "live": meta["docs"] - gone, "terms": meta["terms"], "bytes": _bytes(self._seg(s["id"]))})
            ram_terms = len({scoped(k, t) for _, f in ram.values() for k, v in f.items() if k not in ("", "_id") for t in analyze(v)})
            return {
                "name": self.name, "generation": commit["generation"], "docs": sum(s["live"] for s in segments) + len(ram), "deleted": sum(s["deleted"] for s in segments),
                "ram_docs": len(ram), "ram_terms": ram_terms, "segments": segments,
            }


def _terms(lists: DataFrame, docs: int = 0) -> DataFrame:
    d = build.dictionary(lists.select("seg", "key", *build.NUMBERS), docs)
    cut = F.instr("key", ":")
    return d.select("seg", "key", F.substring("key", F.lit(1), cut - 1).alias("field"), F.substring("key", cut + 1, F.length("key")).alias("term"), (F.length("key") - cut).cast("int").alias("term_len"), "df", "cf", "encoded_len")


def segment_stats(docs: DataFrame, terms: DataFrame, deletes: DataFrame) -> DataFrame:
    """(seg, docs, deleted, live, terms): three small aggregates joined."""
    d = docs.groupBy("seg").agg(F.count("*").alias("docs"))
    x = deletes.groupBy("seg").agg(F.count("*").alias("deleted"))
    t = terms.groupBy("seg").agg(F.count("*").alias("terms"))
    out = d.join(x, "seg", "left").join(t, "seg", "left").na.fill(0, ["deleted", "terms"])
    return out.select("seg", "docs", "deleted", (F.col("docs") - F.col("deleted")).alias("live"), "terms")


def _bytes(path: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)
