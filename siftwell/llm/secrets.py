"""Secret scans with a trigram index, in DataFrame functions only.

Every rule is a regular expression. :func:`siftwell.llm.trigrams.derive` turns it into a
Boolean query over trigrams. :func:`index` writes the inverted index: postings (trigram, text) of
the trigrams that any rule asks for, a text being named by its hash. :func:`candidates` reads the
postings of a query's trigrams and intersects them by text. Texts that satisfy a rule's query are
searched for the rule itself; rules without a mandatory trigram scan every text. Texts of equal
hash share their candidacy, which can only add texts that the rule's own search turns down.
Texts are not shuffled while the candidates are few (MOST_TEXTS, 16 bytes each).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.textbatch import forget, fresh, written
from siftwell.llm.trigrams import Query, derive

BITS = 62
#: Candidate texts that are broadcast, at most; beyond that they are joined.
MOST_TEXTS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern`` must mean the same in Java and Python; a match counts if its ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),  # the runs of [0-9a-f]+ that are long enough
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


def trigrams_of(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that any rule asks for, in a fixed order."""
    return sorted(set().union(*(derive(r.pattern).trigrams() for r in rules)))


def satisfied(query: Query, words: list[Column], trigrams: list[str]) -> Column:
    """A Boolean query as bit tests; runs of AND become one mask per bitmap."""
    if query.kind == "all":
        return F.lit(True)
    if query.kind == "or":
        out = F.lit(False)
        for k in query.kids:
            out = out | satisfied(k, words, trigrams)
        return out
    kids = query.kids if query.kind == "and" else (query,)
    masks: dict[int, int] = {}
    out = F.lit(True)
    for k in kids:
        if k.kind == "tri":
            i, j = divmod(trigrams.index(k.tri), BITS)
            masks[i] = masks.get(i, 0) | 1 << j
        else:
            out = out & satisfied(k, words, trigrams)
    for i, m in masks.items():
        out = out & (words[i].bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long"))
    return out


def prefix_sums(a: Column) -> Column:
    """Sum of all elements before each. Blocks of sqrt(n) keep the work of appending at n ** 1.5."""
    n = F.size(a)
    b = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    starts = F.when(n > 0, F.sequence(F.lit(1), n, b)).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda s: F.slice(a, s, b))
    zero = F.lit(0).cast("long")

    def running(values: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, begin, lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    before = running(F.transform(blocks, lambda x: F.aggregate(x, zero, lambda s, v: s + v)), zero)
    return F.flatten(F.zip_with(blocks, before, running))


def found(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches as an array of (start, rank, end), in code points.

    What lies between the matches and the matches themselves alternate, so their lengths give
    the positions: the JVM's split and find stop at the same places."""
    p = F.lit(rule.pattern)
    long = lambda x: F.length(x).cast("long")
    matches = F.transform(F.regexp_extract_all(text, p, F.lit(0)), long)
    counted = matches if rule.group == 0 else F.transform(F.regexp_extract_all(text, p, F.lit(rule.group)), long)
    gaps = F.slice(F.transform(F.split(text, rule.pattern, -1), long), F.lit(1), F.size(matches))
    before = prefix_sums(F.zip_with(gaps, matches, lambda g, m: g + m))
    starts = F.zip_with(before, gaps, lambda s, g: s + g)
    spans = F.zip_with(F.zip_with(starts, matches, lambda s, m: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + m).alias("end"))), counted, lambda s, c: F.struct(s.alias("span"), c.alias("n")))
    return F.transform(F.filter(spans, lambda x: x["n"] >= rule.least), lambda x: x["span"])


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def index(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index as a written table, sorted by trigram: (trigram, h), once for each text and trigram of a rule's query that it holds."""
    low = docs.select(text_key(text).alias("h"), F.lower(F.col(f"`{text}`")).alias("low"))
    held = F.filter(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams_of(rules))), lambda x: x.isNotNull())
    each = low.select("h", F.explode_outer(held).alias("trigram")).where("trigram is not null").distinct()
    return written(each.select("trigram", "h").sortWithinPartitions("trigram"), "trigrams")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(h, rules) of each text that satisfies a rule's query; bit k of ``rules`` is rule k. Postings are joined into bits of each text, and the queries are bit tests."""
    asked = [derive(r.pattern) for r in rules]
    trigrams = sorted(set().union(*(q.trigrams() for q in asked)))
    table = lambda f, kind: F.element_at(F.create_map(*(x for j, t in enumerate(trigrams) for x in (F.lit(t), F.lit(f(j)).cast(kind)))), F.col("trigram"))
    placed = postings.where(F.col("trigram").isin(trigrams)).select("h", table(lambda j: j // BITS, "int").alias("word"), table(lambda j: 1 << j % BITS, "long").alias("bit"))
    words = [f"w{i}" for i in range(-(-len(trigrams) // BITS))]
    texts = placed.groupBy("h").agg(*(F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("bit"))), F.lit(0).cast("long")).alias(w) for i, w in enumerate(words)))
    mask = F.lit(0).cast("long")
    for k, q in enumerate(asked):
        if q.kind != "all":
            mask = mask.bitwiseOR(F.when(satisfied(q, [F.col(w) for w in words], trigrams), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return texts.select("h", mask.alias("rules")).where("rules <> 0")


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "secrets") -> DataFrame:
    """Add ``out``: an array of (start, rank, end) structs, sorted; rank is the rule's place in ``rules``.

    Null and empty texts have none. Columns named like the temporary ones are kept, as those
    are not selected; an ``out`` that exists already is replaced. Repeated rows are each scanned.
    A text of any length is scanned whole."""
    asked = [derive(r.pattern) for r in rules]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    h, mask = fresh(docs, "_h", "_rules")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    if any(q.kind != "all" for q in asked):
        postings = index(docs, text, rules)
        some = written(candidates(postings, rules), "candidates").select(F.col("h").alias(h), F.col("rules").alias(mask))
        forget(docs.sparkSession, postings)
        few = some.limit(MOST_TEXTS + 1).count() <= MOST_TEXTS
        joined = docs.withColumn(h, text_key(text)).join(F.broadcast(some) if few else some, h, "left")
    else:
        joined = docs.withColumn(mask, F.lit(0).cast("long"))
    may = lambda k: F.lit(True) if asked[k].kind == "all" else F.coalesce(F.col(mask).bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.lit(False))
    each = [F.when(may(k) & t.rlike(r.pattern), found(t, r, k)).otherwise(empty) for k, r in enumerate(rules)]
    return joined.select(*kept, F.array_sort(F.flatten(F.array(*each))).alias(out))


def as_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


def op10(docs: DataFrame) -> DataFrame:
    """The contract's digest of :func:`scan`: counts of the base kinds, the hash of their spans, all spans."""
    n = len(BASE)
    base = F.filter(F.col("secrets"), lambda s: s["rank"] < n)
    count = lambda k: F.size(F.filter(F.col("secrets"), lambda s: s["rank"] == k)).cast("long")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", *(count(k).alias(f"n_{BASE[k].kind}") for k in range(n)), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("secrets")).alias("spans")
    )


def _sql() -> str:
    """The contract's rows in DuckDB: matches and what lies between them give the places, as in :func:`found`."""
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"SELECT rid, {k} AS rank, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {r.group}) AS v FROM d WHERE regexp_matches(text, '{p}')")
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
x AS ({" UNION ALL ".join(parts)}),
y AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM x),
z AS (SELECT rid, rank, kind, length(m[i]) AS n, list_sum(list_transform(g[1:i], lambda t: length(t))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda t: length(t))), 0) AS s FROM y WHERE length(v[i]) >= least),
w AS (SELECT rid, rank, s, kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span, s + n AS e FROM z)
SELECT any_value(d.doc_id) AS doc_id, {", ".join(f"(count(*) FILTER (w.rank = {k}))::BIGINT AS n_{r.kind}" for k, r in enumerate(BASE))},
  sha256(coalesce(string_agg(w.span, ',' ORDER BY w.s, w.rank, w.e) FILTER (w.rank < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg(w.span, ',' ORDER BY w.s, w.rank, w.e), '') AS spans
FROM d LEFT JOIN w USING (rid) GROUP BY d.rid"""


SQL = _sql()
