"""MinHash near-dedup: BagMinHash signatures of word shingles, banding, exact multiset overlap, components.

Equal texts are one class by hash from the start. Each distinct text gets a BagMinHash: for the
dyadic intervals of a shingle's weight axis, [0,1), [1,2), [2,4), ..., a Poisson process of
points (time, register, level) is drawn from the shingle's hash; points below the weight count,
and a process ends when its time exceeds the largest register. So equal registers have the
probability of the weighted Jaccard similarity. Texts that agree in a band are candidates:

* round 1 compares each with the smallest text of its bucket, and links become components;
* round 2 takes the buckets that still hold several components and compares what is not in one
  component yet: a small bucket at once; the texts of all large ones lie in blocks of bounded size,
  and each pair of blocks that some large bucket meets in is compared once, whatever the buckets.

Each link is verified on the whole multisets; in round 2 for all texts of two blocks at once, as
products of matrices. No pairs are capped, and no group is in one task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.textbatch import forget, fresh, mix, shingles, small_batches, text_bytes, text_hash, word_hashes, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
WORDS, SIMILAR = 5, 0.8
#: Texts of a block in round 2 (one of more bytes than PIECE counts as several), and of ids that are broadcast (32 bytes each).
BLOCK, PIECE, MOST_IDS = 512, 4096, 500_000
#: Texts of a block pair from which a shingle's column is multiplied instead of listed, and columns that are multiplied at once.
COMMON, COLUMNS = 8, 4096


def bag_minhash(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n, REGISTERS) signatures of the multisets of hashes ``h``, of documents ``doc``; inf where a document has none."""
    m = REGISTERS
    regs = np.full((n, m), np.inf)
    if not len(h):
        return regs
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    w = np.diff(np.append(new, len(h)))
    h, doc = h[new], doc[new]
    parts, low, level = [(h, doc, w, np.zeros(len(h)), np.ones(len(h)))], 1, 1
    while (more := w > low).any():
        h, doc, w = h[more], doc[more], w[more]
        parts.append((mix(h + np.uint64(level)), doc, w, np.full(len(h), float(low)), np.full(len(h), float(low))))
        low, level = low * 2, level + 1
    key, doc, w, begin, width = (np.concatenate(x) for x in zip(*parts))
    time, step, flat = np.zeros(len(key)), 0, regs.ravel()
    while len(key):
        a = mix(key + np.uint64((0x9E3779B97F4A7C15 * (step + 1)) % 2**64))
        b = mix(a ^ np.uint64(0xD1B54A32D192ED03))
        time = time - np.log(((a >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / (width * m)
        k = (b & np.uint64(m - 1)).astype(np.int64)
        lev = begin + width * ((b >> np.uint64(11)) * 2.0**-53)
        ok = lev < w
        np.minimum.at(flat, doc[ok] * m + k[ok], time[ok])
        keep = time <= regs.max(1)[doc]
        key, doc, w, begin, width, time = (x[keep] for x in (key, doc, w, begin, width, time))
        step += 1
    return regs


def signatures(texts: pa.Array) -> np.ndarray:
    """(rows, REGISTERS) 32-bit signatures; a text without words has zeros."""
    h, at = word_hashes(*text_bytes(texts))
    s, doc = shingles(h, at, WORDS)
    regs = bag_minhash(s, doc, len(texts))
    return np.where(np.isinf(regs), 0, mix(regs.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def bands(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS) hashes, each of its band's number and registers."""
    x = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(sig), 0)
    for j in range(ROWS):
        out = mix(out ^ x[:, :, j] + np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = signatures(b.column(3))
        some = sig.any(1)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(bands(sig).ravel()), BANDS).cast(pa.list_(pa.int64()))
        lists = pa.compute.if_else(pa.array(some), lists, pa.array([[]] * len(sig), pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists], ["doc_id", "h", "h2", "bands"])


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a text, sorted, and how often each occurs."""
    h, at = word_hashes(*text_bytes(pa.array([text])))
    return np.unique(shingles(h, at, WORDS)[0], return_counts=True)


def overlap(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two bags; 0 if both are empty."""
    i, p, q = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][p], b[1][q]).sum())
    return both / max(1, int(a[1].sum() + b[1].sum()) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text_a, text_b) sorted by b: the links among them."""
    last, kept = None, None
    for x in batches:
        out = []
        for a, b, ta, tb in zip(*(c.to_pylist() for c in x.columns)):
            if b != last:
                last, kept = b, bag(tb)
            if overlap(bag(ta), kept) >= SIMILAR:
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def similarities(texts: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each text of ``a`` (rows) and each of ``b`` (columns), indices of ``texts``."""
    h, at = word_hashes(*text_bytes(texts))
    s, doc = shingles(h, at, WORDS)
    size = np.bincount(doc, minlength=len(texts))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])])[: len(s)]
    nth = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    # the nth of equal shingles in a text is an item of its own, so multisets overlap in the items that both have
    _, item, held = np.unique(np.where(nth > 0, mix(s ^ mix(nth.astype(np.uint64))), s), return_inverse=True, return_counts=True)
    order = np.argsort(item, kind="stable")
    doc, item, begin = doc[order], item[order], np.concatenate([[0], np.cumsum(held)])
    row, col = np.full(len(texts), -1), np.full(len(texts), -1)
    row[a], col[b] = np.arange(len(a)), np.arange(len(b))
    both = np.zeros((len(a), len(b)))
    for k in range(1, COMMON):
        of = doc[begin[:-1][held == k][:, None] + np.arange(k)]
        x, y = np.broadcast_arrays(row[of][:, :, None], col[of][:, None, :])
        good = (x >= 0) & (y >= 0)
        both += np.bincount(x[good] * len(b) + y[good], minlength=both.size).reshape(both.shape)
    many = held >= COMMON
    number = np.cumsum(many) - 1
    doc, item = doc[many[item]], number[item[many[item]]]
    for first in range(0, int(many.sum()), COLUMNS):
        lo, hi = np.searchsorted(item, [first, first + COLUMNS])
        has = np.zeros((len(texts), int(item[hi - 1]) - first + 1), np.float32)
        has[doc[lo:hi], item[lo:hi] - first] = 1
        both += has[a] @ has[b].T
    return both / np.maximum(1, size[a][:, None] + size[b][None, :] - both)


def _within(group: pd.DataFrame) -> pd.DataFrame:
    """Links that join components: among the texts of a bucket or block, or between those of two blocks."""
    g = group.drop_duplicates("t").sort_values("t").reset_index(drop=True)
    sides = [np.flatnonzero(g.side == i) for i in (0, 1)]
    a, b = sides if len(sides[1]) else (sides[0], sides[0])
    names, comp = np.unique(g.comp, return_inverse=True)
    x, y = np.nonzero((similarities(pa.array(g.text), a, b) >= SIMILAR) & (comp[a][:, None] != comp[b][None, :]))
    x, y = a[x], b[y]
    _, one = np.unique(np.minimum(comp[x], comp[y]) * len(names) + np.maximum(comp[x], comp[y]), return_index=True)
    top = list(range(len(names)))

    def find(c):
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    out = []
    for i, j in zip(x[one], y[one]):
        p, q = find(comp[i]), find(comp[j])
        if p != q:
            top[p] = q
            out.append((g.t[i], g.t[j]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _compared(mixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, y, side, t, comp): the texts of each group that is compared, and a table to forget. ``mixed``: (bucket, n, t, comp, w), w: pieces of the text.

    A bucket of at most BLOCK pieces is a group. A text of larger ones lies in a block of its largest
    bucket, beside others of its component; two blocks are a group if a large bucket holds texts of both
    and not of one component only. So a text goes to as many groups as there are blocks that it meets."""
    mixed = mixed.withColumn("whole", F.sum("w").over(_by("bucket")))
    small = mixed.where(F.col("whole") <= BLOCK).select(F.col("bucket").alias("x"), F.col("bucket").alias("y"), F.lit(0).alias("side"), "t", "comp")
    hot = mixed.where(F.col("whole") > BLOCK)
    home = hot.groupBy("t", "comp", "w").agg(F.max(F.struct("n", "bucket")).getField("bucket").alias("home"))
    before = F.sum("w").over(_by("home").orderBy("comp", "t")) - F.col("w")
    placed = written(home.select("t", "comp", F.xxhash64("home", F.floor(before / BLOCK)).alias("block")), "blocks")
    spans = hot.select("bucket", "t").join(placed, "t").groupBy("bucket", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    other = spans.select("bucket", F.col("block").alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = spans.withColumnRenamed("block", "x").join(other, "bucket").where((F.col("x") <= F.col("y")) & (F.least("lo", "lo2") != F.greatest("hi", "hi2"))).select("x", "y").distinct()
    met = met.withColumn("side", F.explode(F.when(F.col("x") == F.col("y"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    met = met.withColumn("block", F.when(F.col("side") == 0, F.col("x")).otherwise(F.col("y")))
    return small.union(met.join(placed, "block").select("x", "y", "side", "t", "comp")), placed


def components(links: DataFrame) -> DataFrame:
    """(t, comp): each linked text and the smallest of its component. Smallest neighbours and pointer jumping, each round written."""
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    now = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("t"), F.least("a", "m").alias("comp")), "comp")
    while True:
        near = both.join(now, both.b == now.t).groupBy("a").agg(F.min("comp").alias("near"))
        step = now.join(near, now.t == near.a, "left").select("t", F.least("comp", F.coalesce("near", "comp")).alias("c"), "comp")
        up = now.select(F.col("t").alias("c"), F.col("comp").alias("cc"))
        new = written(step.join(up, "c", "left").select("t", F.least("c", F.coalesce("cc", "c")).alias("comp"), F.col("comp").alias("old")), "comp")
        moved = new.where("comp <> old").limit(1).count()
        forget(now.sparkSession, now)
        now = new.select("t", "comp")
        if not moved:
            forget(now.sparkSession, both)
            return now


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, h2, comp, class_id, n_copies) for each row: class_id is the smallest key of the class, comp a number of its own, h and h2 hashes of the text.

    Texts are near duplicates if the multisets of their five-word shingles overlap by 0.8 or more
    (fewer than five words: one shingle of all); classes are the components of such links. Equal
    texts, null as empty, are always in one class; texts without words only with equal ones.
    Repeated rows and ties are rows of their own in one class. Null keys never name a class that
    has another key; classes may have one class_id (null, or a repeated key), but never one comp. ``n_copies``: rows of equal text and key."""
    spark = docs.sparkSession
    small_batches(spark)
    t, t2 = text_hash(text)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), t.alias("h"), t2.alias("h2"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    sketch = written(rows.mapInArrow(_sketch, "doc_id long, h long, h2 long, bands array<bigint>"), "sketch")
    # both hashes tell texts apart (128 bits); t is a number for each text, fixed as the table is written
    distinct = sketch.groupBy("h", "h2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    distinct = written(distinct.withColumn("t", F.monotonically_increasing_id()), "distinct")
    buckets = written(distinct.select("t", F.explode("bands").alias("bucket")).withColumn("n", F.count("*").over(_by("bucket"))).withColumn("least", F.min("t").over(_by("bucket"))).where("n > 1"), "buckets")
    texts_of = lambda ids: _texts(rows, ids)
    pairs = buckets.where("t <> least").select(F.col("t").alias("a"), F.col("least").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    ids = written(buckets.select("t").distinct().join(distinct.select("t", "h", "h2", "rep"), "t"), "ids")
    texts = written(texts_of(ids), "texts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = pairs.join(texts.select(F.col("t").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("t").alias("b"), F.col("text").alias("tb")), "b")
    links = written(ready.select("a", "b", "ta", "tb").repartition(n, "a", "b").sortWithinPartitions("b").mapInArrow(_verify, "a long, b long"), "links1")
    comp = components(links)
    placed = buckets.join(comp, "t", "left").select("bucket", "t", "n", F.coalesce("comp", "t").alias("comp"))
    mixed = placed.withColumn("lo", F.min("comp").over(_by("bucket"))).withColumn("hi", F.max("comp").over(_by("bucket"))).where("lo <> hi and n > 2")
    pieces = texts.select("t", F.greatest(F.lit(1.0), F.octet_length("text") / PIECE).alias("w"))
    mixed = written(mixed.join(pieces, "t").select("bucket", "n", "t", "comp", "w"), "mixed")
    dealt, placed = _compared(mixed)
    more = dealt.join(texts, "t").groupBy("x", "y").applyInPandas(_within, "a long, b long")
    more = written(more, "links2")
    forget(spark, buckets, pairs, ids, texts, comp, mixed, placed)
    comp = components(links.union(more))
    forget(spark, links, more)
    placed = distinct.select("h", "h2", "t").join(comp, "t", "left").select("h", "h2", F.coalesce("comp", "t").alias("comp"))
    named = sketch.select("doc_id", "h", "h2").join(placed, ["h", "h2"])
    classes = named.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    copies = named.groupBy("doc_id", "h", "h2", "comp").agg(F.count("*").alias("n_copies"))
    one = copies.join(classes, "comp")
    return one.select("doc_id", "h", "h2", "comp", "class_id", "n_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("_")).drop("_")


def _by(name: str):
    from pyspark.sql import Window

    return Window.partitionBy(name)


def _texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(t, text) of the texts in ``ids``, each once; read from the row with the smallest key."""
    few = ids.limit(MOST_IDS + 1).count() <= MOST_IDS
    wanted = ids.select("t", F.col("h").alias("_h"), F.col("h2").alias("_h2"), F.col("rep").alias("_rep"))
    wanted = F.broadcast(wanted) if few else wanted
    return rows.join(wanted, (rows.h == F.col("_h")) & (rows.h2 == F.col("_h2")) & rows.doc_id.eqNullSafe(F.col("_rep"))).select("t", "text").dropDuplicates(["t"])


def op8(docs: DataFrame) -> DataFrame:
    return near_classes(docs).select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the row with the smallest doc_id (nulls last, then the smallest text hash), once. Columns as they are, whatever their names."""
    classes = written(near_classes(docs), "classes")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "h2", "n_copies")).alias("least")
    id_, h_, h2_, n_ = fresh(docs, "_id", "_h", "_h2", "_n")
    kept = classes.groupBy("comp").agg(least).select(*(F.col(f"least.{c}").alias(x) for c, x in (("doc_id", id_), ("h", h_), ("h2", h2_), ("n_copies", n_))))
    t, t2 = text_hash("text")
    names = [F.col(f"`{c}`") for c in docs.columns]
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (t == F.col(h_)) & (t2 == F.col(h2_))
    single = docs.join(kept.where(F.col(n_) == 1), same).select(*names)
    repeated = kept.where(F.col(n_) > 1)
    if not repeated.limit(1).count():
        return single
    again = docs.join(repeated, same).dropDuplicates([id_, h_, h2_]).select(*names)
    return single.union(again)
