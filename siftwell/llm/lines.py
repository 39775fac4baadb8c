"""Line dedup with two Bloom filters, once-seen and twice-seen, and exact confirmation of suspects.

1. Each task hashes the keys of its lines (once a document) to bits and sends the bits it saw
   once and those it saw again, by segment of the filter. The filter has some 16 bits a line
   whatever the input; a task merges one segment at a time: a bit that comes twice is twice-seen.
2. Suspects are the keys whose bit is twice-seen. If their bits are few (MOST_SUSPECTS, 8 bytes
   each) they are broadcast, so that no other key is shuffled; beyond that, the keys, counted in
   each task, meet the bits in a join. Suspects are counted as whole keys.
3. Keys in at least ``least`` documents are repeats. They are broadcast as hashes if few
   (MOST_KEYS); beyond that, each document's suspects are joined with them. All paths make keys
   by the same function and give the same rows.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.textbatch import forget, fresh, small_batches, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits of the smallest filter, and of a segment.
LEAST_BITS, SEGMENT = 1 << 22, 1 << 22
#: Bits for each byte of text: some 16 for a line of 64 bytes.
BITS_PER_BYTE = 0.25
MOST_SUSPECTS, MOST_KEYS = 4_000_000, 1_000_000
#: Keys whose counts a task holds before it sends them on.
HELD = 100_000
STRIP = b" \t\n\x0b\x0c\r"


def keys_of(text: str | None) -> list[bytes]:
    """The key of each line: stripped of ASCII white space at both ends, A-Z lower-cased."""
    return [x.strip(STRIP).lower() for x in (text or "").encode().split(b"\n")]


def _long(k: bytes, least_len: int) -> bool:
    return len(k) >= least_len and (least_len < 2 or len(k.decode()) >= least_len)


def _bits(least_len: int, n_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []

        def rows() -> pa.RecordBatch:
            at, n = np.unique(np.array(held, np.uint64) % np.uint64(n_bits), return_counts=True)
            seg = (at // np.uint64(SEGMENT)).astype(np.int64)
            own, cut = np.unique(seg, return_index=True)
            low, cut = (at % np.uint64(SEGMENT)).astype(np.uint32), np.append(cut, len(seg))
            parts = [(low[a:b].tobytes(), low[a:b][n[a:b] > 1].tobytes()) for a, b in zip(cut, cut[1:])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *(pa.array([p[j] for p in parts], pa.binary()) for j in (0, 1))], ["seg", "once", "twice"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held += [xxhash.xxh3_64_intdigest(k) for k in set(keys_of(t)) if _long(k, least_len)]
                if len(held) > 2_000_000:
                    yield rows()
        if held:
            yield rows()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment to each segment's twice-seen bits."""
    now, once, twice = None, None, None

    def out():
        at = np.flatnonzero(twice)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([at.astype(np.uint32).tobytes()], pa.binary())], ["seg", "n", "bits"])

    for b in batches:
        for s, o, t in zip(*(c.to_pylist() for c in b.columns)):
            if s != now:
                if now is not None:
                    yield out()
                now, once, twice = s, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
            o, t = np.frombuffer(o, np.uint32), np.frombuffer(t, np.uint32)
            twice[o[once[o]]] = True
            once[o] = True
            twice[t] = True
    if now is not None:
        yield out()


def twice_seen(docs: DataFrame, text: str, least_len: int) -> tuple[DataFrame, int]:
    """The twice-seen bits as a written table (seg, n, bits), and the filter's size, which follows the input."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    n_bits = LEAST_BITS
    while n_bits < size * BITS_PER_BYTE:
        n_bits *= 2
    sent = docs.select(F.col(f"`{text}`")).mapInArrow(_bits(least_len, n_bits), "seg long, once binary, twice binary")
    merged = sent.repartition("seg").sortWithinPartitions("seg").mapInArrow(_merge, "seg long, n long, bits binary")
    return written(merged, "bits"), n_bits


def repeats(docs: DataFrame, text: str = "text", least: int = 10, least_len: int = 1, order: str | None = None, row: str | None = None) -> DataFrame:
    """Keys of ``least_len`` characters or more in at least ``least`` rows: (key binary, n, first_row).

    ``first_row`` is column ``row`` (a bigint of its own in each row) of the first of those rows: by column
    ``order`` (a bigint, nulls last), then a hash of the text, then ``row``. It is null if no ``order`` is given. Counts are
    exact; each row counts as a document, so repeated rows count again."""
    spark = docs.sparkSession
    small_batches(spark)
    bits, n_bits = twice_seen(docs, text, least_len)
    few = (bits.agg(F.sum("n")).first()[0] or 0) <= MOST_SUSPECTS
    if few:
        places = [np.frombuffer(b, np.uint32).astype(np.uint64) + np.uint64(seg * SEGMENT) for seg, b in bits.select("seg", "bits").toLocalIterator()]
        filter_ = spark.sparkContext.broadcast(np.sort(np.concatenate(places)) if places else np.zeros(0, np.uint64))
        forget(spark, bits)
    else:
        filter_ = spark.sparkContext.broadcast(None)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = filter_.value, {}

        def rows():
            keys = list(held)
            at = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64) % np.uint64(n_bits)
            out = pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(keys, pa.binary()), *(pa.array([held[k][j] for k in keys], pa.int64()) for j in range(5))], ["bit", "key", "n", "none", "at", "h", "row"])
            held.clear()
            return out

        for b in batches:
            keys, of, own = [], [], list(zip(*(c.to_pylist() for c in b.columns[:4])))
            for i, t in enumerate(b.column(4).to_pylist()):
                mine = [k for k in set(keys_of(t)) if _long(k, least_len)]
                keys += mine
                of += [i] * len(mine)
            hit = range(len(keys))
            if known is not None:
                at = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64) % np.uint64(n_bits)
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, at), len(known) - 1)] == at).tolist() if len(known) else []
            for j in hit:
                n, *first = held.get(keys[j], (0, *own[of[j]]))
                held[keys[j]] = n + 1, *min(tuple(first), own[of[j]])
                if len(held) > HELD:
                    yield rows()
        if held:
            yield rows()

    t, at, zero = F.col(f"`{text}`"), F.col(f"`{order}`").cast("long") if order else F.lit(0), F.lit(0).cast("long")
    place = (at.isNull().cast("long"), F.coalesce(at, zero), F.xxhash64(F.coalesce(t, F.lit(""))), F.col(f"`{row}`")) if order else (zero,) * 4
    counted = docs.select(*(c.alias(x) for c, x in zip(place, ("none", "at", "h", "row"))), t.alias("text")).mapInArrow(suspects, "bit long, key binary, n long, none long, at long, h long, row long")
    if not few:
        counted = counted.join(bits.mapInArrow(_places, "bit long"), "bit", "left_semi")
    first = F.min(F.struct("none", "at", "h", "row"))["row"] if order else F.first(F.lit(None).cast("long"))
    return counted.groupBy("key").agg(F.sum("n").alias("n"), first.alias("first_row")).where(F.col("n") >= least)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for seg, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.uint32).astype(np.int64) + seg * SEGMENT)], ["bit"])


def _own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(me, text) to (me, key) for each of its distinct keys."""
    for b in batches:
        for me, t in zip(*(c.to_pylist() for c in b.columns)):
            keys = [k for k in set(keys_of(t)) if k]
            for i in range(0, len(keys), HELD):
                yield pa.RecordBatch.from_arrays([pa.array([me] * len(keys[i : i + HELD]), pa.int64()), pa.array(keys[i : i + HELD], pa.binary())], ["me", "key"])


OUT = "n_lines long, n_dropped long, kept string"


def dedup_lines(docs: DataFrame, text: str = "text", least: int = 10, least_len: int = 1, keep_first: bool = False, order: str = "doc_id") -> DataFrame:
    """Add n_lines, n_dropped and kept (the text of the lines that stay) to each row.

    A line goes if its key has ``least_len`` characters and is in at least ``least`` rows; with
    ``keep_first`` it stays in its first place, always one: the first line of the row with the
    smallest ``order``, nulls last; of such rows that with the smallest hash of its text, and of
    equal texts one. Null and empty texts are one empty line. Existing columns of the three names
    are replaced; all others stay. With ``keep_first`` the rows are written with a number first."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept")]
    row, at_, hot_, me_, text_ = fresh(docs, "_row", "_at", "_hot", "_me", "_text")
    if keep_first:
        docs = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hot = written(repeats(docs, text, least, least_len, *((order, row) if keep_first else ())), "lines")
    few = hot.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    at, t = F.col(row) if keep_first else F.lit(None).cast("long"), F.col(f"`{text}`")
    own = [F.col(f"`{c}`") for c in names]
    if few:
        found = spark.sparkContext.broadcast({(r.key if len(r.key) < 16 else hashlib.blake2b(r.key, digest_size=16).digest()): r.first_row for r in hot.toLocalIterator()})
        forget(spark, hot)
        rows = docs.select(*own, at.alias(at_), F.lit(None).cast("array<struct<key:binary,first_row:bigint>>").alias(hot_), t.alias(text_))
    else:
        # each text's repeats come to it by a join on the keys, and by a second one on the text's own hash (equal texts share them)
        found = spark.sparkContext.broadcast(None)
        me = F.xxhash64(t)
        pairs = docs.where(t.isNotNull()).select(me.alias("me"), t).mapInArrow(_own_keys, "me long, key binary").distinct().join(hot, "key")
        lists = pairs.groupBy("me").agg(F.collect_list(F.struct("key", "first_row")).alias(hot_)).withColumnRenamed("me", me_)
        rows = docs.withColumn(me_, me).join(lists, me_, "left").select(*own, at.alias(at_), hot_, t.alias(text_))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen_here = found.value, object()
        for b in batches:
            n_lines, n_dropped, kept = [], [], []
            for i, own, t in zip(*(c.to_pylist() for c in b.columns[-3:])):
                drop = known if known is not None else {(x["key"] if len(x["key"]) < 16 else hashlib.blake2b(x["key"], digest_size=16).digest()): x["first_row"] for x in own or ()}
                lines, keys, seen = (t or "").split("\n"), keys_of(t), set()
                stay = []
                for x, k in zip(lines, keys):
                    first = drop.get(k if len(k) < 16 else hashlib.blake2b(k, digest_size=16).digest(), seen_here) if k else seen_here
                    if first is seen_here or keep_first and first is not None and first == i and k not in seen:
                        stay.append(x)
                        seen.add(k)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            columns = b.columns[:-3]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], [*names, "n_lines", "n_dropped", "kept"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), OUT])
    return rows.mapInArrow(cut, schema)


def op4(docs: DataFrame) -> DataFrame:
    """The contract's digest: keys in at least 10 documents lose all their lines."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (SELECT d.rid, d.doc_id, u.line, u.i, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
  LATERAL (SELECT unnest(d.ls) AS line, generate_subscripts(d.ls, 1) AS i) u),
hot AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(h.k)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN h.k IS NULL THEN l.line END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM lines l LEFT JOIN hot h ON l.k = h.k GROUP BY l.rid, l.doc_id
"""
