"""License scans with a positional rare-token index, in DataFrame functions only.

Templates are license texts, from two words to a sentence. One pass over all documents counts
the document frequency of each template word; of each template the RAREST words (highest IDF)
are indexed as postings word -> (template, position). The second pass looks up every license
word that a document holds: each posting gives a template and the place where it would begin
there. Postings that agree on that place are intersected by position, and a template is reported
if they make SHARE of its indexed IDF and its mandatory key phrase stands at its relative place.
Base phrases are given with all their places. The index is a constant of the plan, as large as
the templates; nothing but the frequencies of license words is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between words, once A-Z are lower-cased. The JVM matches this class much faster than its complement.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: (label, template text, mandatory key phrase in it)
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "apache license", "apache license"),
    ("apache-grant", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "mit license", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-3", "general public license version 3", "general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl", "mozilla public license", "mozilla public license"),
)
#: Rarest words of a template that are indexed, and the share of their IDF found in line that it takes.
RAREST, SHARE = 4, 0.5
#: A place is kept as template * SPAN + start + OFFSET in one number.
SPAN, OFFSET = 1 << 40, 1 << 10


#: Words of templates that aren't license words: they are never indexed.
COMMON = set("2 3 4 0 a all and any are by except for form forms free in is may nc not of or person sa source subject terms the this to under use v version with without work you".split())


def vocabulary() -> list[str]:
    return sorted({w for t in [*(t for _, t, _ in TEMPLATES), *BASE.values()] for w in t.split()} - COMMON)


def any_of(low: Column, words: list[str]) -> Column:
    """True of every text with one of the words (and of some others): a cheap test that spares most rows all else."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def word_count(low: Column) -> Column:
    """Number of words, without keeping them."""
    edge = lambda at: F.substring(low, at, 1).rlike(BETWEEN).cast("int")
    return F.when(low == "", F.lit(0)).otherwise(F.size(F.split(low, BETWEEN)) - edge(1) - edge(-1)).cast("long")


def lowered(text: str) -> Column:
    """The text in lower case, null as empty. Beyond A-Z, lower-casing makes ASCII letters of the Kelvin sign alone, so words are as many as before and phrases without a k stand where they did."""
    return F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def words_of(low: Column) -> Column:
    """The words of a lower-cased text."""
    return F.array_remove(F.split(low, BETWEEN), "")


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """Documents with each license word, and all documents, in one pass; a row for each word comes to the driver."""
    vocab, low = vocabulary(), F.col("low")
    held = F.when(any_of(low, vocab), F.array_intersect(words_of(low), F.array(*map(F.lit, vocab)))).otherwise(F.array().cast("array<string>"))
    held = F.array_append(held, F.lit(""))
    n = {r.w: r.n for r in docs.select(lowered(text).alias("low")).select(F.explode_outer(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return n, n.pop("", 0)  # the outer explode spares a filter that would make the words again


def index(df: dict[str, int], n: int) -> list[list[tuple[str, int, float]]]:
    """Of each template the postings (word, position, IDF) of its rarest words, rarest first; a word's first place counts."""
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1
    out = []
    for _, text, _ in TEMPLATES:
        words = text.split()
        first = {w: i for i, w in reversed(list(enumerate(words)))}
        out.append([(w, first[w], idf(w)) for w in sorted(first.keys() - COMMON, key=lambda w: (-idf(w), w))[:RAREST]])
    return out


def places(words: Column, phrase: str) -> Column:
    """All positions where the phrase's words stand consecutively."""
    p = phrase.split()
    at = F.filter(F.transform(words, lambda w, i: F.when(w == p[0], i)), lambda i: i.isNotNull())

    def whole(i: Column) -> Column:
        ok = F.lit(True)
        for j, w in enumerate(p[1:], 1):
            ok = ok & F.coalesce(F.get(words, i + j) == w, F.lit(False))
        return ok

    return F.filter(at, whole)


def labelled(label: str, at: Column) -> Column:
    return F.transform(at, lambda i: F.struct(F.lit(label).alias("label"), i.alias("place")))


def _templates(postings: list[list[tuple[str, int, float]]]) -> Column:
    """The templates as an array of structs: label, indexed words with places and weights (shares), key phrase and its place."""
    out = []
    for (label, text, key), own in zip(TEMPLATES, postings):
        total = sum(v for _, _, v in own)
        w, k = text.split(), key.split()
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        rare = F.array(*(F.struct(F.lit(x).alias("word"), F.lit(p).alias("pos"), F.lit(v / total).alias("share")) for x, p, v in own))
        out.append(F.struct(F.lit(label).alias("label"), rare.alias("rare"), F.array(*map(F.lit, k)).alias("key"), F.lit(at).alias("key_at")))
    return F.array(*out)


def matches(words: Column, postings: list[list[tuple[str, int, float]]]) -> Column:
    """(label, start, share) of every template whose indexed words agree in place by SHARE and whose key phrase stands there."""
    by_word: dict[str, list[tuple[int, int]]] = {}
    for t, own in enumerate(postings):
        for w, p, _ in own:
            by_word.setdefault(w, []).append((t, p))
    lookup = F.create_map(*(x for w, own in by_word.items() for x in (F.lit(w), F.array(*(F.lit(t * SPAN + OFFSET - p) for t, p in own)))))
    known, templates = F.array(*map(F.lit, by_word)), _templates(postings)
    hits = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(known, w), F.transform(F.element_at(lookup, w), lambda b: b + i))), lambda x: x.isNotNull())
    places = F.array_distinct(F.flatten(hits))  # a template's postings that agree on its start meet here

    def judged(code: Column) -> Column:
        start = (F.pmod(code, F.lit(SPAN)) - OFFSET).cast("int")
        t = F.get(templates, (code / SPAN).cast("int"))
        share = F.aggregate(t["rare"], F.lit(0.0), lambda s, r: s + F.when(F.get(words, start + r["pos"]) == r["word"], r["share"]).otherwise(0.0))
        first = start + t["key_at"]
        key = F.when(first >= 0, F.coalesce(F.slice(words, first + 1, F.size(t["key"])) == t["key"], F.lit(False))).otherwise(F.lit(False))
        return F.struct(t["label"].alias("label"), start.alias("start"), share.alias("share"), key.alias("key"))

    return F.filter(F.transform(places, judged), lambda x: x["key"] & (x["share"] >= SHARE))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``license``: struct(n_words, base: array of (label, place), found: array of (label, start, share), labels, score).

    ``labels`` holds base labels and those of ``found``; ``score`` is the largest share, 1 for a
    base phrase, else 0. Null and empty texts have no words. All columns but ``license`` stay;
    repeated rows are each scanned; the empty table gives no rows. Texts of any length are scanned whole."""
    df, n = document_frequencies(docs, text)
    postings = index(df, n)
    taken = {c.lower() for c in docs.columns}
    name = lambda x: x + "_" * sum(c.startswith(x) for c in taken)
    l, w, n_words, b, m = map(name, ("_low", "_words", "_n_words", "_base", "_found"))
    low, words = F.col(l), F.col(w)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "license"]
    rarest = lambda phrase: min(set(phrase.split()) - COMMON, key=lambda x: (df.get(x, 0), x))
    # a phrase's rarest word is in the text wherever the phrase is, so most rows end here, without words
    keys = sorted({rarest(k) for _, _, k in TEMPLATES} | {rarest(p) for p in BASE.values()})
    base = F.flatten(F.array(*(labelled(label, places(words, p)) for label, p in BASE.items())))
    none, some = F.array().cast("array<struct<label:string,place:int>>"), F.size(words) > 0
    lower = docs.select("*", lowered(text).alias(l))  # a column of its own, so that it is made once a row
    worded = lower.select("*", F.when(any_of(low, keys), words_of(low)).otherwise(F.array().cast("array<string>")).alias(w))
    found = F.when(some, matches(words, postings)).otherwise(F.array().cast("array<struct<label:string,start:int,share:double,key:boolean>>"))
    a = worded.select(*kept, word_count(low).alias(n_words), F.when(some, base).otherwise(none).alias(b), found.alias(m))
    label = lambda x: F.transform(F.col(x), lambda y: y["label"])
    labels = F.array_sort(F.array_distinct(F.concat(label(b), label(m))))
    score = F.when(F.size(b) > 0, F.lit(1.0)).otherwise(F.least(F.coalesce(F.array_max(F.transform(F.col(m), lambda x: x["share"])), F.lit(0.0)), F.lit(1.0)))
    own = F.transform(F.col(m), lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["share"].alias("share")))
    return a.select(*kept, F.struct(F.col(n_words).alias("n_words"), F.col(b).alias("base"), own.alias("found"), labels.alias("labels"), score.alias("score")).alias("license"))


def op3(docs: DataFrame) -> DataFrame:
    """The contract's digest of :func:`scan`."""
    x = F.col("license")
    at = F.transform(x["base"], lambda b: b["place"].cast("long"))
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", x["n_words"].alias("n_words"), F.size(x["base"]).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(x["base"], lambda b: b["label"])))).alias("base_labels"), F.concat_ws(",", x["labels"]).alias("labels"), x["score"].alias("score"),
    )
