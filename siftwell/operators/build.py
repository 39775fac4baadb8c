"""Index build: documents to postings and dictionary, renumbering, merge, checks.

Postings are made and moved as lists (``operators/lists.py``): a row for a key and a run of documents. Texts are
dealt by blocks of documents, once, and lists by key, once; nothing here sorts single postings, or puts all
postings of a key, or all documents of a segment, into one task. What passes from run to run or from block to block is
computed from one small row for each of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.analysis import tokens
from siftwell.operators import lists as kernels
from siftwell.operators.lists import ARRAYS, DEAL, NONE, NUMBERS, Numbering

#: Documents of a block.
BLOCK = 1 << 16
#: Blocks whose live documents are sent to all tasks as bits (8 KB each), at most.
MOST_BLOCKS = 4096


def block(name: str = "doc"):
    return F.floor(F.col(name) / BLOCK).cast("long")


def spread(df: DataFrame, docs: int, *by) -> DataFrame:
    """Dealt by the hashes of ``by``, to so many partitions that each has the share of DEAL documents, whatever the session's number is."""
    n = math.ceil(docs / DEAL)
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*by)


#: Columns of lists after the key, as they are, by their sizes alone, and as they are shuffled.
FORMS = {"full": [*(f"{k} long" for k in NUMBERS), *(f"{k} array<int>" for k in ARRAYS)], "sizes": [f"{k} long" for k in NUMBERS], "packed": ["first long", "list binary"]}


def lists(docs: DataFrame, laid: bool = False, form: str = "full") -> DataFrame:
    """(group columns, key, NUMBERS, ARRAYS) of ``docs``: group columns, the document's number, and fields. For other forms see FORMS.

    The documents are dealt by their numbers, as texts, so that a task has whole blocks of them; ``laid`` says that
    partitions lie in document order already and share no range of numbers that has no gap."""
    *group, doc = [c for c in docs.columns if c not in ("fields", "_id")]
    if not laid:
        docs = spread(docs, docs.count(), *group, F.shiftright(F.col(doc).cast("long"), DEAL.bit_length() - 1)).sortWithinPartitions(*group, doc)
    kept = F.map_filter("fields", lambda k, v: (k != "") & (k != "_id") & v.isNotNull())
    each = docs.select(*group, F.col(doc).cast("long").alias("doc"), F.explode_outer(kept).alias("field", "value"))  # a document without fields leaves no gap
    cut = each.select(*group, "doc", "field", tokens(F.col("value")).alias("toks"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in group), "key string", *FORMS[form]])
    return cut.mapInArrow(lambda it: kernels.build(it, group, laid, form), schema)


def gathered(of: DataFrame, docs: int) -> DataFrame:
    """Packed lists (key, first, list) of about ``docs`` documents as lists, dealt by key and sorted by it in each partition, their parts joined."""
    dealt = spread(of.select("key", "first", "list"), docs, "key").sortWithinPartitions("key", "first")
    return dealt.mapInArrow(kernels.unpacked, ", ".join(["key string", *FORMS["full"]]))


def rows(of: DataFrame, doc: str = "doc", *more: str) -> DataFrame:
    """(group columns, doc, key, and of pos and tf what ``more`` names, or both): a row for each posting of the lists."""
    group = of.columns[: of.columns.index("key")]
    more = more or ("pos", "tf")

    def posting(d, i):
        start = F.coalesce(F.get("ends", i - 1), F.lit(0))
        n = F.get("ends", i) - start
        has = {"pos": F.slice("pos", start + 1, n), "tf": n.cast("long")}
        return F.struct(F.nullif(F.col("first") + d, F.lit(NONE)).alias("doc"), *(has[k].alias(k) for k in more))

    return of.select(*group, "key", F.explode(F.transform("docs", posting)).alias("_x")).select(*group, F.col("_x.doc").alias(doc), "key", *(F.col(f"_x.{k}").alias(k) for k in more))


def single(posts: DataFrame) -> DataFrame:
    """The inverse of ``rows``, with a list for each posting."""
    one = encoded(posts.withColumn("delta", F.lit(None).cast("long")))
    return one.select(*[c for c in posts.columns if c not in ("doc", "key", "pos", "tf")], "key", F.col("doc").alias("first"), F.col("doc").alias("last"), F.lit(1).cast("long").alias("df"), F.col("tf").alias("cf"), "bytes", F.array(F.lit(0)).alias("docs"), F.array(F.col("tf").cast("int")).alias("ends"), "pos")


def postings(docs: DataFrame, laid: bool = False) -> DataFrame:
    """(id columns, key, pos, tf): positions of each key in each document, ascending."""
    return rows(lists(docs, laid), [c for c in docs.columns if c not in ("fields", "_id")][-1])


def dictionary(posts: DataFrame, docs: int = 0) -> DataFrame:
    """(seg, key, df, cf), and the encoded size of each postings list. ``posts`` are lists or single postings of about ``docs`` documents.

    The parts of a list know their sizes but for their first deltas, which follow from the part before."""
    if "docs" not in posts.columns and "df" not in posts.columns:
        posts = single(posts)
    one = spread(posts.select("seg", "key", *NUMBERS), docs, "key")
    before = F.lag("last").over(Window.partitionBy("seg", "key").orderBy("first"))  # a row for each part
    whole = one.withColumn("bytes", F.col("bytes") + varint(F.col("first") - F.coalesce(before, F.lit(0).cast("long"))))
    out = whole.groupBy("seg", "key").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.sum("bytes").alias("b"))
    return out.select("seg", "key", "df", "cf", (varint("df") + F.col("b")).alias("encoded_len"))


def varint(name):
    """Bytes of an unsigned number in groups of seven bits."""
    c = F.col(name) if isinstance(name, str) else name
    return sum((F.when(c >= 1 << 7 * k, 1).otherwise(0) for k in range(1, 9)), F.lit(1)).cast("long")


def deltas(pos):
    """Each position less the one before it; the first as it is."""
    return F.transform(pos, lambda p, i: p - F.when(i > 0, F.get(pos, i - 1)).otherwise(F.lit(0)))


def encoded(posts: DataFrame) -> DataFrame:
    """Add ``bytes``, what (delta, frequency, position deltas) take as varints; needs ``delta``, which takes none where null."""
    body = F.aggregate(deltas(F.col("pos")), F.lit(0).cast("long"), lambda s, v: s + varint(v))
    return posts.withColumn("bytes", F.when(F.col("delta").isNull(), F.lit(0)).otherwise(varint("delta")) + varint("tf") + body)


def encoded_lists(of: DataFrame) -> DataFrame:
    """(seg, key, bytes): each list as bytes."""
    return of.select("seg", "key", "first", *ARRAYS).mapInArrow(lambda it: kernels.encoded(it, ["seg", "key"]), "seg string, key string, bytes binary")


def decoded(data: DataFrame) -> DataFrame:
    """The inverse of ``encoded_lists``; bytes that are no list fail the job."""
    return data.mapInArrow(lambda it: kernels.decoded(it, ["seg", "key"]), ", ".join(["seg string", "key string", *FORMS["full"]]))


def renumber(docs: DataFrame, order: str, group: str | None = None, size: int = BLOCK) -> DataFrame:
    """Add ``new_doc``, 0..n-1 in the order of ``group``, then ``order`` (both whole numbers).

    Rows are counted by blocks of ``size`` numbers of ``order``; the counts give each block its offset, so no task sorts
    more than a block. Ties are numbered in any order."""
    by = ["_g", "_b"] if group else ["_b"]
    placed = (docs.withColumn("_g", F.col(group).cast("long")) if group else docs).withColumn("_b", F.shiftright(F.col(order).cast("long"), size.bit_length() - 1))
    counts = placed.groupBy(*by).agg(F.count("*").alias("_n"))  # a row for each block
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    if size < BLOCK:  # whole documents, not ids alone
        placed = spread(placed, docs.count(), *by)
    local = placed.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    return local.join(offsets, by).withColumn("new_doc", (F.col("_k") + F.col("_o")).cast("long")).drop(*by, "_k", "_o")


def integrity(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """One row of violation counts: documents of a key out of order or twice, positions out of order, documents that don't exist.

    Rows have no order of their own: a document that a key has twice is the violation that can be stored. Postings
    are dealt by document once; a document's are counted where they lie, and only the counts meet ``docs``."""
    rising = F.forall(F.transform(F.col("pos"), lambda p, i: (i == 0) | (p > F.get(F.col("pos"), i - 1))), lambda x: x)
    dealt = spread(posts.select("seg", "doc", "key", F.when(rising, 0).otherwise(1).alias("bad")), docs.count(), "seg", "doc")
    each = dealt.groupBy("seg", "doc", "key").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    per = each.groupBy("seg", "doc").agg(F.sum(F.col("n") - 1).alias("twice"), F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    known = docs.select("seg", "doc").distinct().withColumn("known", F.lit(True))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.join(known, ["seg", "doc"], "left").agg(total("twice").alias("doc_order"), total("bad").alias("pos_order"), total(F.when(F.col("known").isNull(), F.col("n"))).alias("orphans"))


def faults(of: DataFrame, terms: DataFrame, docs: int) -> tuple[int, int]:
    """Faults in stored lists (seg, key, NUMBERS, ARRAYS) of about ``docs`` documents by themselves, and of keys whose parts meet or aren't as (seg, key, df) of ``terms`` says."""
    inside = of.mapInArrow(kernels.faults, "doc_order long, pos_order long").agg(F.coalesce(F.sum(F.col("doc_order") + F.col("pos_order")), F.lit(0))).first()[0]
    none = F.lit(None).cast("long")
    both = of.select("seg", "key", "first", "last", "df", none.alias("was")).union(terms.select("seg", "key", none, none, none, "df"))
    before = F.lag("last").over(Window.partitionBy("seg", "key").orderBy("first"))  # nulls come first
    each = spread(both, docs, "key").withColumn("meet", before >= F.col("first")).groupBy("seg", "key").agg(F.sum("df").alias("df"), F.sum("was").alias("was"), F.count("was").alias("n"), F.count_if("meet").alias("meet"))
    return inside, each.where("df is null or was is null or df <> was or n > 1 or meet > 0").count()


def numbering(ids: DataFrame) -> Numbering | None:
    """Fresh ids, 0..n-1 by segment and document, of live documents (seg_ord, seg, doc); None where bits can't tell: an id twice, or too many blocks."""

    def pack(x):
        doc = x["doc"].to_numpy()
        return x.iloc[:1][["seg_ord", "seg", "b"]].assign(n=len(doc), bits=kernels.bits(doc, BLOCK))

    blocks = ids.where("doc is not null").select("seg_ord", "seg", "doc", block().alias("b"))
    if len(blocks.select("seg", "b").distinct().limit(MOST_BLOCKS + 1).collect()) > MOST_BLOCKS:
        return None
    packed = sorted(blocks.groupBy("seg_ord", "seg", "b").applyInPandas(pack, "seg_ord int, seg string, b long, n long, bits binary").collect(), key=lambda r: (r.seg_ord, r.b))
    out: dict[str, list] = {}
    at = 0
    for r in packed:
        there = np.frombuffer(r.bits, np.uint8)
        if np.bitwise_count(there).sum() != r.n:
            return None
        out.setdefault(r.seg, []).append((r.b, at, there))
        at += r.n
    return Numbering(BLOCK, {seg: (np.array([b for b, _, _ in x]), np.array([o for _, o, _ in x]), np.stack([t for _, _, t in x])) for seg, x in out.items()})


def merge(docs: DataFrame, posts: DataFrame, deletes: DataFrame | None, form: str = "full") -> tuple[DataFrame, DataFrame]:
    """Live documents of all segments with fresh ids in segment order, and their postings: lists as ``posts`` are, given in a form. Positions stay; ids aren't deduplicated.

    Only ids are shuffled. Bits of the live documents go to all tasks, which renumber texts and lists where they lie."""
    ids = docs.select("seg_ord", "seg", "doc")
    ids = ids if deletes is None else ids.join(deletes, ["seg", "doc"], "left_anti")
    new = numbering(ids)
    if new is None:  # an id that is there twice has two new ones
        dense = renumber(ids, "doc", "seg_ord").select("seg", "doc", "new_doc")
        live = docs if deletes is None else docs.join(deletes, ["seg", "doc"], "left_anti")
        body = renumber(live.where("doc is not null"), "doc", "seg_ord", DEAL).select(F.col("new_doc").alias("doc"), "_id", "fields")
        found = single(rows(posts).join(dense, ["seg", "doc"]).select("key", F.col("new_doc").alias("doc"), "pos", "tf"))
        return body, found if form != "packed" else found.mapInArrow(kernels.repacked, ", ".join(["key string", *FORMS["packed"]]))

    @F.pandas_udf("long")
    def fresh(seg: pd.Series, doc: pd.Series) -> pd.Series:
        code, names = pd.factorize(seg)
        got = new.all(code, list(names), doc.fillna(NONE).to_numpy(np.int64))
        return pd.Series(got).astype("Int64").mask(got < 0)

    body = docs.withColumn("new_doc", fresh("seg", "doc")).where("new_doc is not null").select(F.col("new_doc").alias("doc"), "_id", "fields")
    moved = posts.select("seg", "key", "first", *ARRAYS).mapInArrow(lambda it: kernels.moved(it, new, form), ", ".join(["key string", *FORMS[form]]))
    return body, moved
