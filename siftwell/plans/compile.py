"""Queries to DataFrames: one scan of the postings that the leaves need, one aggregation by document.

Every leaf (a term, a fuzzy term, a phrase) becomes one aggregate over the postings of a
document, and the tree a Boolean expression over them, so a query of any size has one
shuffle. The language has no negation: a document without postings for a leaf can't match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.analysis import scoped
from siftwell.plans.query import And, Fuzzy, Or, Phrase, leaves, parse


#: Rows (of two numbers each) that a search broadcasts, at most, and keys that it pushes down to the scan.
MOST_ROWS, MOST_KEYS = 1_000_000, 1_000
#: How much rarer than the rest the rarest required key must be for the rest to be cut to its documents.
RARER = 8


@dataclass(frozen=True)
class Tables:
    """docs(seg_ord, seg, doc, _id, fields), postings(seg_ord, seg, key, doc, pos, tf), terms(seg, key), deletes(seg, doc)."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    deletes: DataFrame | None = None
    n_deletes: int | None = None
    #: Whether the tables are files, so that a look at the dictionary before the search is cheap.
    stored: bool = False


def fuzzy_keys(terms: DataFrame, leaf: Fuzzy) -> DataFrame:
    """(seg, key) of the dictionary within the leaf's distance. What follows the field's prefix is compared, whatever colons it has."""
    prefix = leaf.field + ":"
    rest = F.substring("key", F.lit(len(prefix) + 1), F.length("key"))
    close = F.abs(F.length(rest) - len(leaf.term)) <= leaf.distance
    return terms.where(F.col("key").startswith(prefix) & close & (F.levenshtein(rest, F.lit(leaf.term), leaf.distance) >= 0)).select("seg", "key")


def exact_keys(node) -> list[str]:
    """Distinct keys that are looked up as they are."""
    out = []
    for x in leaves(node):
        if isinstance(x, Phrase):
            out += [scoped(x.field, t) for t, _ in x.terms]
        elif not isinstance(x, Fuzzy) or x.distance == 0:
            out.append(scoped(x.field, x.term))
    return list(dict.fromkeys(out))


def _wide(node) -> list[Fuzzy]:
    return list(dict.fromkeys(x for x in leaves(node) if isinstance(x, Fuzzy) and x.distance))


def required(node) -> set[str]:
    """Keys that every match has."""
    if isinstance(node, And):
        return set().union(*map(required, node.kids))
    if isinstance(node, Phrase):
        return {scoped(node.field, t) for t, _ in node.terms}
    if isinstance(node, Or) or isinstance(node, Fuzzy) and node.distance:
        return set()
    return {scoped(node.field, node.term)}


def frequencies(tables: Tables, keys: list[str]) -> dict[str, int]:
    """Documents of each key, by the dictionary; 0 where it isn't."""
    rows = tables.terms.where(F.col("key").isin(keys)).groupBy("key").agg(F.sum("df").alias("df")).collect()
    return dict.fromkeys(keys, 0) | {r.key: r.df for r in rows}


def _exact(tables: Tables, node, keys: list[str]) -> DataFrame:
    """Postings of the exact keys. If one that every match needs is rare, all others are cut to its documents before any shuffle."""
    posts = tables.postings.where(F.col("key").isin(keys))
    need = required(node)
    if not (tables.stored and need and len(keys) > 1):
        return posts
    df = frequencies(tables, keys)
    rare = min(need, key=lambda k: (df[k], k))
    if not df[rare]:
        return posts.where(F.col("key") == rare)  # no document matches
    if df[rare] > MOST_ROWS or df[rare] * RARER > sum(df.values()):
        return posts
    first = tables.postings.where(F.col("key") == rare)
    rest = tables.postings.where(F.col("key").isin([k for k in keys if k != rare]))
    return first.union(rest.join(F.broadcast(first.select("seg", "doc")), ["seg", "doc"], "left_semi").select(*first.columns))


def _near(tables: Tables, leaf: Fuzzy) -> DataFrame:
    """Postings of all keys near a fuzzy term: few keys are pushed down to the scan, more meet it in a join."""
    near = fuzzy_keys(tables.terms, leaf).select("key").distinct()
    if tables.stored and len(rows := near.limit(MOST_KEYS + 1).collect()) <= MOST_KEYS:
        return tables.postings.where(F.col("key").isin([r.key for r in rows])) if rows else tables.postings.where(F.lit(False))
    return tables.postings.join(near, "key", "left_semi")


def _starts(places: list[Column], terms) -> Column:
    """Number of places where all terms of a phrase stand at their distances."""
    out = places[0]
    for p, (_, d) in zip(places[1:], terms[1:]):
        out = F.array_intersect(out, _shifted(p, d))
    return F.coalesce(F.size(out), F.lit(0)).cast("long")


def _shifted(p: Column, d: int) -> Column:
    return F.transform(p, lambda s: s - d)


def matched(tables: Tables, node) -> DataFrame:
    """(seg_ord, seg, doc, score) of every live match; the score is the frequency summed over all leaves, matching branch or not."""
    keys, wide = exact_keys(node), _wide(node)
    columns = ["seg_ord", "seg", "doc"]
    used = None
    phrases = any(isinstance(x, Phrase) for x in leaves(node))
    pos = F.col("pos") if phrases else F.lit(None).cast("array<int>")
    if keys:
        used = _exact(tables, node, keys).select(*columns, "key", F.lit(-1).alias("leaf"), "tf", pos.alias("pos"))
    for i, leaf in enumerate(wide):
        found = _near(tables, leaf).select(*columns, "key", F.lit(i).alias("leaf"), "tf", F.lit(None).cast("array<int>").alias("pos"))
        used = found if used is None else used.union(found)
    if tables.deletes is not None:
        small = tables.n_deletes is not None and tables.n_deletes <= MOST_ROWS
        used = used.join(F.broadcast(tables.deletes) if small else tables.deletes, ["seg", "doc"], "left_anti").select(*used.columns)
    at = {k: i for i, k in enumerate(keys)}
    is_key = lambda k: (F.col("leaf") == -1) & (F.col("key") == k)
    sums = [F.sum(F.when(is_key(k), F.col("tf")).otherwise(F.lit(0).cast("long"))).alias(f"k{i}") for k, i in at.items()]
    sums += [F.max(F.when(is_key(k), F.col("pos"))).alias(f"p{i}") for k, i in at.items()] if phrases else []
    sums += [F.sum(F.when(F.col("leaf") == i, F.col("tf")).otherwise(F.lit(0).cast("long"))).alias(f"f{i}") for i in range(len(wide))]
    by = used.groupBy(*columns).agg(*sums)

    def number(x) -> Column:
        if isinstance(x, Phrase):
            return _starts([F.col(f"p{at[scoped(x.field, t)]}") for t, _ in x.terms], x.terms)
        if isinstance(x, Fuzzy) and x.distance:
            return F.col(f"f{wide.index(x)}")
        return F.col(f"k{at[scoped(x.field, x.term)]}")

    def holds(x) -> Column:
        if isinstance(x, (And, Or)):
            first, *rest = map(holds, x.kids)
            for c in rest:
                first = first & c if isinstance(x, And) else first | c
            return first
        return number(x) > 0

    score = sum((number(x) for x in leaves(node)[1:]), number(leaves(node)[0]))
    return by.where(holds(node)).select(*columns, score.cast("long").alias("score"))


def search(tables: Tables, query: str, limit: int | None = 10, rank: bool = False) -> DataFrame:
    """The first ``limit`` matches in document order, or by score (ties in document order): (seg_ord, seg, doc, score)."""
    if limit is not None and limit < 0:
        raise ValueError("limit must be >= 0")
    found = matched(tables, parse(query))
    ordered = found.orderBy(F.desc("score"), "seg_ord", "doc") if rank else found.orderBy("seg_ord", "doc")
    return ordered if limit is None else ordered.limit(limit)


def hits(tables: Tables, query: str, limit: int | None = 10, rank: bool = False) -> DataFrame:
    """Matches with their stored fields. The limit comes before the join, so only hits are fetched; the order is kept by the caller's sort."""
    found = search(tables, query, limit, rank)
    out = found.join(tables.docs.select("seg_ord", "doc", "_id", "fields"), ["seg_ord", "doc"])
    order = [F.desc("score"), "seg_ord", "doc"] if rank else ["seg_ord", "doc"]
    out = out.orderBy(*order).select("_id", F.col("seg").alias("_seg"), F.col("doc").cast("string").alias("_doc"), F.col("score").cast("string").alias("_score"), "fields")
    return out if rank else out.drop("_score")


def lookups(tables: Tables, query: str, n_segments: int) -> DataFrame:
    """One row: postings_lookups and postings_decoded of a query."""
    node = parse(query)
    exact = sum(len(x.terms) if isinstance(x, Phrase) else 1 for x in leaves(node) if not (isinstance(x, Fuzzy) and x.distance))
    counted = tables.terms.where(F.col("key").isin(exact_keys(node))).select("seg", "key")
    wide = [x for x in leaves(node) if isinstance(x, Fuzzy) and x.distance]
    n = tables.terms.select(F.lit(exact * n_segments).cast("long").alias("n")).limit(1)
    each = [fuzzy_keys(tables.terms, x) for x in wide]
    total = n.select(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"))
    for e in each:
        total = total.union(e.agg(F.count("*").alias("n")))
        counted = counted.union(e)
    decoded = counted.distinct().agg(F.count("*").alias("postings_decoded"))
    return total.agg(F.sum("n").alias("postings_lookups")).crossJoin(decoded)  # two single rows
