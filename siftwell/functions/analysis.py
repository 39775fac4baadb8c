"""Text analysis: the same tokens as Column expressions and, for query text, in Python."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_FIELD = "message"
MIN_TOKEN = 2
#: What separates tokens: splitting there is several times faster than finding each token.
BETWEEN = r"[^\p{L}\p{Nd}]+"


def lower(text: Column) -> Column:
    """Lower case letter by letter: without it, the JVM would look at a sigma's neighbours and give two characters for a dotted I."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def tokens(text: Column) -> Column:
    """All tokens in order; a token's place in the array is its position."""
    return F.array_remove(F.split(lower(text), BETWEEN), "")


def placed(text: str) -> list[tuple[int, str]]:
    """(position, token) of a query's text, short tokens too."""
    out: list[str] = []
    inside = False
    for c in text:
        if c in "İΣ":
            c = {"İ": "i", "Σ": "σ"}[c]
        c = c.lower()
        ok = unicodedata.category(c[0])[0] == "L" or unicodedata.category(c[0]) == "Nd"
        if ok:
            out[-1:] = [out[-1] + c] if inside else [*out[-1:], c]
        inside = ok
    return list(enumerate(out))


def analyze(text: str) -> list[str]:
    """Tokens that are long enough to be indexed."""
    return [t for _, t in placed(text) if len(t) >= MIN_TOKEN]


def scoped(field: str, term: str) -> str:
    return f"{field}:{term}"


def positions(docs: DataFrame) -> DataFrame:
    """(id columns, field, term, pos) of every indexed token of ``docs`` with a map column ``fields``.

    Positions count all tokens, short ones too, so a dropped token leaves a gap."""
    ids = [c for c in docs.columns if c not in ("fields", "_id")]
    each = docs.select(*ids, F.explode("fields").alias("field", "value")).where("field <> '' and field <> '_id' and value is not null")
    return each.select(*ids, "field", F.posexplode(tokens(F.col("value"))).alias("pos", "term")).where(F.length("term") >= MIN_TOKEN)


def field_terms(docs: DataFrame) -> DataFrame:
    """Distinct keys of each document."""
    ids = [c for c in docs.columns if c not in ("fields", "_id")]
    return positions(docs).select(*ids, F.concat("field", F.lit(":"), "term").alias("key")).distinct()
