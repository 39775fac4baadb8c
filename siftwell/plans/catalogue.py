"""Queries over the test tables, with the SQL that gives the same rows.

The corpus is ``documents`` with the fields message (text), lang and source, as three segments
(doc_id mod 3) whose local ids keep the order of doc_id; deletes are the ids divisible by 11.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import analysis
from siftwell.operators import build
from siftwell.plans import compile as plan
from siftwell.plans.query import Fuzzy, leaves, parse
from siftwell.sources.index import segment_stats
from siftwell.sources.ingest import last_wins, parse_json

SEGMENTS = 3


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """docs(seg_ord, seg, doc, _id, fields)."""
    fields = F.map_from_arrays(F.array(F.lit("message"), F.lit("lang"), F.lit("source")), F.array("text", "lang", "source"))
    seg = (F.col("doc_id") % SEGMENTS).cast("int")
    return _table(spark, d, "documents").select(seg.alias("seg_ord"), seg.cast("string").alias("seg"), F.expr(f"doc_id div {SEGMENTS}").alias("doc"), F.col("doc_id").cast("string").alias("_id"), fields.alias("fields"))


def tables(spark: SparkSession, d: str, live: bool = False) -> plan.Tables:
    """Documents and their postings, as lists."""
    docs = corpus(spark, d)
    gone = docs.where(F.col("_id").cast("long") % 11 == 0).select("seg", "doc") if live else None
    return plan.Tables(docs, _lists(spark, d), _lists(spark, d, "sizes").select("seg", "key").distinct(), gone)


def _search(query: str, limit: int | None = None, rank: bool = False, live: bool = False) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        # a search needs few keys: they are filtered before the postings are grouped
        found = plan.search(_narrow(spark, d, query, live), query, limit, rank)
        return found.select(F.col("seg_ord").cast("long").alias("seg_ord"), "doc", "score")

    return run


def _narrow(spark: SparkSession, d: str, query: str, live: bool = False) -> plan.Tables:
    """Tables with only the tokens that a query can use, so that others are never shuffled."""
    docs = corpus(spark, d)
    node = parse(query)
    at = analysis.positions(docs.select("seg_ord", "seg", "doc", "fields")).withColumn("key", F.concat("field", F.lit(":"), "term"))
    use = F.col("key").isin(plan.exact_keys(node))
    for x in leaves(node):
        if isinstance(x, Fuzzy) and x.distance:
            use = use | (F.col("key").startswith(x.field + ":") & (F.abs(F.length("term") - len(x.term)) <= x.distance))
    posts = at.where(use).groupBy("seg_ord", "seg", "doc", "key").agg(F.sort_array(F.collect_list("pos")).alias("pos")).withColumn("tf", F.size("pos").cast("long"))
    gone = docs.where(F.col("_id").cast("long") % 11 == 0).select("seg", "doc") if live else None
    return plan.Tables(docs, posts, posts.select("seg", "key").distinct(), gone)


F_SQL = "f AS (SELECT doc_id, unnest(['message', 'lang', 'source']) AS field, unnest([text, lang, source]) AS v FROM documents)"
T_SQL = r"t AS (SELECT doc_id, field, unnest(toks) AS term, generate_subscripts(toks, 1)::BIGINT - 1 AS pos FROM (SELECT doc_id, field, regexp_extract_all(lower(v), '[\p{L}\p{Nd}]+') AS toks FROM f))"
P_SQL = "p AS (SELECT doc_id, field, term, field || ':' || term AS key, pos FROM t WHERE length(term) >= 2)"
BASE = f"WITH {F_SQL}, {T_SQL}, {P_SQL}"




# The searches' SQL is written by hand, leaf by leaf, so that the query parser is on one side only.


def _near_sql(field: str, term: str, distance: int) -> str:
    rest = f"regexp_replace(substr(key, {len(field) + 2}), '[^\\x00-\\x7F]', chr(1), 'g')"
    return f"starts_with(key, '{field}:') AND levenshtein({rest}, '{term}') <= {distance}"


def _tf(key: str) -> str:
    return f"SELECT doc_id, count(*) AS n FROM p WHERE key = '{key}' GROUP BY 1"


def _near(field: str, term: str, distance: int) -> str:
    return f"SELECT doc_id, count(*) AS n FROM p WHERE {_near_sql(field, term, distance)} GROUP BY 1"


def _phrase(field: str, first: str, *rest: tuple[str, int]) -> str:
    joins = "".join(f" JOIN p p{i} ON p{i}.doc_id = p.doc_id AND p{i}.key = '{field}:{t}' AND p{i}.pos = p.pos + {g}" for i, (t, g) in enumerate(rest, 1))
    return f"SELECT p.doc_id, count(*) AS n FROM p{joins} WHERE p.key = '{field}:{first}' GROUP BY 1"


def _sql(leaves_: list[str], where: str, score: str, more: str = "", tail: str = "", select: str = f"doc_id % {SEGMENTS} AS seg_ord, doc_id // {SEGMENTS} AS doc") -> str:
    """Documents with the counts of leaves a, b, c ... for which ``where`` holds, and their score."""
    names = "abcdefgh"[: len(leaves_)]
    joins = "".join(f" LEFT JOIN ({x}) {c}_ ON {c}_.doc_id = d.doc_id" for c, x in zip(names, leaves_))
    counts = "".join(f", coalesce({c}_.n, 0) AS {c}" for c in names)
    return f"{BASE}, m AS (SELECT d.doc_id, d.lang, d.source{counts} FROM documents d{joins}) SELECT {select}, ({score})::BIGINT AS score FROM m WHERE ({where}){more}{tail}"


THE, OF, EN, FR, DE, ES, SRC3 = (_tf(k) for k in ("message:the", "message:of", "lang:en", "lang:fr", "lang:de", "lang:es", "source:src3"))
SEARCH_SQL = {
    "search_term": _sql([THE], "a > 0", "a"),
    "search_field_term": _sql([EN], "a > 0", "a"),
    "search_and": _sql([THE, EN], "a > 0 AND b > 0", "a + b"),
    "search_or": _sql([FR, DE], "a > 0 OR b > 0", "a + b"),
    "search_grouped": _sql([EN, FR, SRC3], "(a > 0 OR b > 0) AND c > 0", "a + b + c"),
    "search_precedence": _sql([FR, SRC3, DE], "(a > 0 AND b > 0) OR c > 0", "a + b + c"),
    "search_phrase": _sql([_phrase("message", "the", ("the", 1))], "a > 0", "a"),
    "search_phrase_gap": _sql([_phrase("message", "the", ("of", 2))], "a > 0", "a"),
    "search_phrase_field": _sql([EN, _phrase("message", "the", ("of", 1))], "a > 0 AND b > 0", "a + b"),
    "search_phrase_repeat": _sql([_phrase("message", "of", ("of", 1), ("of", 2))], "a > 0", "a"),
    "search_fuzzy": _sql([_near("message", "attion", 1)], "a > 0", "a"),
    "search_fuzzy_zero": _sql([THE], "a > 0", "a"),
    "search_fuzzy_and": _sql([_near("message", "attion", 2), EN], "a > 0 AND b > 0", "a + b"),
    "search_tf": _sql([THE], "a > 0", "a"),
    "search_tf_or_branch": _sql([THE, FR, OF], "(a > 0 AND b > 0) OR c > 0", "a + b + c + c"),
    "search_tf_phrase": _sql([_phrase("message", "the", ("of", 1)), _tf("message:in")], "a > 0 OR b > 0", "a + b"),
    "search_tf_fuzzy": _sql([_near("message", "attion", 1)], "a > 0", "a"),
    "search_limit": _sql([OF], "a > 0", "a", tail=" ORDER BY seg_ord, doc LIMIT 10"),
    "search_top_k_tf": _sql([THE, OF], "a > 0 OR b > 0", "a + b", tail=" ORDER BY score DESC, seg_ord, doc LIMIT 10"),
    "search_live": _sql([THE, OF], "a > 0 AND b > 0", "a + b", " AND doc_id % 11 <> 0"),
    "search_multi_segment": _sql([_tf("message:in"), ES], "a > 0 OR b > 0", "a + b"),
}


#: name: (query, limit, rank, live)
SEARCHES = {
    "search_term": ("the",), "search_field_term": ("lang:en",), "search_and": ("the AND lang:en",), "search_or": ("lang:fr OR lang:de",),
    "search_grouped": ("(lang:en OR lang:fr) AND source:src3",), "search_precedence": ("lang:fr AND source:src3 OR lang:de",),
    "search_phrase": ('"the the"',), "search_phrase_gap": ('"the a of"',), "search_phrase_field": ('lang:en AND message:"the of"',), "search_phrase_repeat": ('"of of of"',),
    "search_fuzzy": ("attion~1",), "search_fuzzy_zero": ("the~0",), "search_fuzzy_and": ("attion~2 AND lang:en",),
    "search_tf": ("the", None, True), "search_tf_or_branch": ("(the AND lang:fr) OR of OR of", None, True), "search_tf_phrase": ('"the of" OR in', None, True), "search_tf_fuzzy": ("attion~1", None, True),
    "search_limit": ("of", 10), "search_top_k_tf": ("the OR of", 10, True), "search_live": ("the AND of", None, False, True), "search_multi_segment": ("in OR lang:es",),
}


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return build.postings(corpus(spark, d).select("seg_ord", "seg", "doc", "fields"))


def _lists(spark: SparkSession, d: str, form: str = "full") -> DataFrame:
    return build.lists(corpus(spark, d).select("seg_ord", "seg", "doc", "fields"), form=form)


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    return build.dictionary(_lists(spark, d, "sizes"), _table(spark, d, "documents").count())


def _joined(c: str) -> F.Column:
    return F.concat_ws(",", F.transform(F.col(c), lambda p: p.cast("string")))


def analyze_tokens(s, d):
    return analysis.positions(corpus(s, d).select("_id", "seg_ord", "doc", "fields")).select(F.expr(f"doc * {SEGMENTS} + seg_ord").alias("doc_id"), "field", F.col("pos").cast("long").alias("pos"), "term")


def field_terms(s, d):
    return analysis.field_terms(corpus(s, d).select(F.col("_id").cast("long").alias("doc_id"), "fields"))


def field_positions(s, d):
    return build.postings(corpus(s, d).select(F.col("_id").cast("long").alias("doc_id"), "fields")).select("doc_id", "key", _joined("pos").alias("positions"))


def build_postings(s, d):
    return build.rows(_lists(s, d), "doc", "tf").select("seg", "doc", "key", "tf")


def term_dictionary(s, d):
    return _dictionary(s, d).select("seg", "key", "df", "cf")


def docid_remap(s, d):
    live = corpus(s, d).where(F.col("_id").cast("long") % 11 != 0).select(F.col("_id").cast("long").alias("doc_id"))
    return build.renumber(live, "doc_id").select("doc_id", "new_doc")


def postings_integrity(s, d):
    """Violations that are put in: postings twice (doc_id divisible by 50), positions reversed (by 60), documents missing (by 97)."""
    posts, docs = _posts(s, d), corpus(s, d)
    doc_id = F.col("doc") * SEGMENTS + F.col("seg_ord")
    turned = posts.withColumn("pos", F.when(doc_id % 60 == 0, F.reverse("pos")).otherwise(F.col("pos")))
    return build.integrity(turned.union(turned.where(doc_id % 50 == 0)), docs.where(doc_id % 97 != 0))


def fuzzy_expand(leaf: str):
    def run(s, d):
        return plan.fuzzy_keys(_narrow(s, d, leaf).terms, parse(leaf)).select("key").distinct()

    return run


def search_hits(s, d):
    q = "source:src7 AND of"
    found = plan.hits(_narrow(s, d, q), q, None, True)
    return found.select("_id", "_seg", "_doc", "_score", F.col("fields")["lang"].alias("lang"), F.col("fields")["source"].alias("source"))


def search_stats(s, d):
    q = "attion~1 OR the OR the"
    t = _narrow(s, d, q)
    return plan.lookups(t, q, SEGMENTS).select("postings_lookups", "postings_decoded", F.lit(SEGMENTS).cast("long").alias("segments_searched"))


def _merged(s, d, form="full"):
    t = tables(s, d, True)
    return build.merge(t.docs, t.postings, t.deletes, form)


def merge_docs(s, d):
    return _merged(s, d)[0].select("doc", "_id")


def merge_postings(s, d):
    return build.rows(_merged(s, d)[1], "doc", "tf").select("doc", "key", "tf")


def merge_dictionary(s, d):
    merged = _merged(s, d, "sizes")[1].withColumn("seg", F.lit("merged"))
    return build.dictionary(merged, _table(s, d, "documents").count()).select("key", "df", "cf", "encoded_len")


def segments(s, d):
    t = tables(s, d, True)
    return segment_stats(t.docs, t.terms, t.deletes)


def upsert_last_wins(s, d):
    return last_wins(_table(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def json_field_text(s, d):
    got = parse_json(_table(s, d, "events").select("event_id", "props"), "props")
    return got.select("event_id", F.col("fields")["k"].alias("k"))


def delta_encode(s, d):
    return _posts(s, d).select("seg", "doc", "key", F.concat_ws(",", F.transform(build.deltas(F.col("pos")), lambda p: p.cast("string"))).alias("deltas"))


def encoded_size(s, d):
    return _dictionary(s, d).select("seg", "key", "encoded_len")


def decode_postings(s, d):
    """Postings as bytes, by key and run of documents, and back."""
    return build.rows(build.decoded(build.encoded_lists(_lists(s, d))), "doc", "pos").select("seg", "key", "doc", _joined("pos").alias("positions"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        analyze_tokens, field_terms, field_positions, build_postings, term_dictionary, docid_remap, postings_integrity, search_hits, search_stats,
        merge_docs, merge_postings, merge_dictionary, upsert_last_wins, json_field_text, delta_encode, encoded_size, decode_postings,
    )
    return {f.__name__: f for f in named} | {"segment_stats": segments, "fuzzy_expand_1": fuzzy_expand("attion~1"), "fuzzy_expand_2": fuzzy_expand("attion~2")} | {k: _search(*v) for k, v in SEARCHES.items()}


def _vi(x: str) -> str:
    return "(1 + " + " + ".join(f"({x} >= {1 << 7 * k})::INT" for k in range(1, 9)) + ")"


def oracle_sql() -> dict[str, str]:
    seg = f"(doc_id % {SEGMENTS})::VARCHAR AS seg, doc_id // {SEGMENTS} AS doc"
    live = "live AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 3, doc_id) - 1 AS doc FROM documents WHERE doc_id % 11 <> 0)"
    sized = f"""{BASE}, g AS (SELECT doc_id % {SEGMENTS} AS s, doc_id // {SEGMENTS} AS doc, key, count(*) AS tf, list(pos ORDER BY pos) AS ps FROM p GROUP BY ALL),
      e AS (SELECT s, key, doc - lag(doc, 1, 0) OVER (PARTITION BY s, key ORDER BY doc) AS dd, tf, ps FROM g),
      b AS (SELECT s, key, {_vi("dd")} + {_vi("tf")} + list_sum(list_transform(range(1, len(ps) + 1), lambda i: {_vi("(ps[i] - CASE WHEN i > 1 THEN ps[i - 1] ELSE 0 END)")})) AS n FROM e)"""
    one = _near_sql("message", "attion", 1)
    out = {
        "analyze_tokens": f"{BASE} SELECT doc_id, field, pos, term FROM p",
        "field_terms": f"{BASE} SELECT DISTINCT doc_id, key FROM p",
        "field_positions": f"{BASE} SELECT doc_id, key, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p GROUP BY ALL",
        "build_postings": f"{BASE} SELECT {seg}, key, count(*)::BIGINT AS tf FROM p GROUP BY doc_id, key",
        "term_dictionary": f"{BASE} SELECT (doc_id % {SEGMENTS})::VARCHAR AS seg, key, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf FROM p GROUP BY 1, 2",
        "docid_remap": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS new_doc FROM documents WHERE doc_id % 11 <> 0",
        "postings_integrity": f"{BASE}, g AS (SELECT doc_id, key, count(*) AS n FROM p GROUP BY ALL) SELECT count(*) FILTER (doc_id % 50 = 0)::BIGINT AS doc_order, coalesce(sum(CASE WHEN doc_id % 60 = 0 AND n > 1 THEN CASE WHEN doc_id % 50 = 0 THEN 2 ELSE 1 END ELSE 0 END), 0)::BIGINT AS pos_order, coalesce(sum(CASE WHEN doc_id % 97 = 0 THEN CASE WHEN doc_id % 50 = 0 THEN 2 ELSE 1 END ELSE 0 END), 0)::BIGINT AS orphans FROM g",
        "search_hits": f"SELECT d.doc_id::VARCHAR AS _id, x.seg_ord::VARCHAR AS _seg, x.doc::VARCHAR AS _doc, x.score::VARCHAR AS _score, d.lang, d.source FROM ({_sql([_tf('source:src7'), OF], 'a > 0 AND b > 0', 'a + b')}) x JOIN documents d ON d.doc_id = x.doc * {SEGMENTS} + x.seg_ord",
        "search_stats": f"{BASE}, k AS (SELECT DISTINCT doc_id % {SEGMENTS} AS s, key FROM p), x AS (SELECT * FROM k WHERE {one}) SELECT ({2 * SEGMENTS} + (SELECT count(*) FROM x))::BIGINT AS postings_lookups, (SELECT count(*) FROM (SELECT * FROM x UNION SELECT * FROM k WHERE key = 'message:the'))::BIGINT AS postings_decoded, {SEGMENTS}::BIGINT AS segments_searched",
        "merge_docs": f"WITH {live} SELECT doc, doc_id::VARCHAR AS _id FROM live",
        "merge_postings": f"{BASE}, {live} SELECT live.doc, p.key, count(*)::BIGINT AS tf FROM p JOIN live USING (doc_id) GROUP BY ALL",
        "merge_dictionary": f"""{BASE}, {live}, g AS (SELECT live.doc, p.key, count(*) AS tf, list(pos ORDER BY pos) AS ps FROM p JOIN live USING (doc_id) GROUP BY ALL),
          e AS (SELECT key, doc - lag(doc, 1, 0) OVER (PARTITION BY key ORDER BY doc) AS dd, tf, ps FROM g),
          b AS (SELECT key, tf, {_vi("dd")} + {_vi("tf")} + list_sum(list_transform(range(1, len(ps) + 1), lambda i: {_vi("(ps[i] - CASE WHEN i > 1 THEN ps[i - 1] ELSE 0 END)")})) AS n FROM e)
          SELECT key, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf, ({_vi('count(*)')} + sum(n))::BIGINT AS encoded_len FROM b GROUP BY key""",
        "decode_postings": f"{BASE} SELECT {seg}, key, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p GROUP BY doc_id, key",
        "segment_stats": f"{BASE}, k AS (SELECT doc_id % {SEGMENTS} AS s, count(DISTINCT key) AS terms FROM p GROUP BY 1) SELECT s::VARCHAR AS seg, count(*)::BIGINT AS docs, count(*) FILTER (doc_id % 11 = 0)::BIGINT AS deleted, count(*) FILTER (doc_id % 11 <> 0)::BIGINT AS live, any_value(terms)::BIGINT AS terms FROM documents JOIN k ON k.s = doc_id % {SEGMENTS} GROUP BY s",
        "upsert_last_wins": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
        "json_field_text": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
        "delta_encode": f"{BASE}, x AS (SELECT doc_id, key, pos, pos - lag(pos, 1, 0) OVER (PARTITION BY doc_id, key ORDER BY pos) AS dp FROM p) SELECT {seg}, key, string_agg(dp::VARCHAR, ',' ORDER BY pos) AS deltas FROM x GROUP BY doc_id, key",
        "encoded_size": f"{sized} SELECT s::VARCHAR AS seg, key, ({_vi('count(*)')} + sum(n))::BIGINT AS encoded_len FROM b GROUP BY s, key",
        "fuzzy_expand_1": f"{BASE} SELECT DISTINCT key FROM p WHERE {one}",
        "fuzzy_expand_2": f"{BASE} SELECT DISTINCT key FROM p WHERE {_near_sql('message', 'attion', 2)}",
    }
    return out | SEARCH_SQL
