import pytest

from siftwell.functions.analysis import analyze
from siftwell.plans.query import And, BadQuery, Fuzzy, Or, Phrase, Term, edit_distance, matches, parse, term_count


@pytest.mark.parametrize("text, want", [
    ("ERROR", ["error"]), ("Timeout Calling DB", ["timeout", "calling", "db"]), ("foo...bar, baz!", ["foo", "bar", "baz"]), ("foo_bar", ["foo", "bar"]), ("a b cc d", ["cc"]), ("A", []),
    ("OK", ["ok"]), ("7", []), ("42", ["42"]), ("timeout123", ["timeout123"]), ("", []), ("...", []), ("don't", ["don"]), ("Café!", ["café"]), ("ΑΣ", ["ας".replace("ς", "σ")]), ("İstanbul", ["istanbul"]),
])
def test_analyze(text, want):
    assert analyze(text) == want


@pytest.mark.parametrize("query, message", [
    ("", "query is empty"), ("  ", "query is empty"), ("a1 b1", "unexpected token"), ('foo"bar"', "unexpected quote"), (':"x y"', "unexpected quote"), ("NOT xx", "NOT queries"), ("-level", "NOT queries"), ("!level", "NOT queries"),
    ("level:-x", "NOT queries"), ("aa && bb", "is not supported; use AND or OR"), ("aa || bb", "is not supported"), ('""', "empty phrase"), ('"open', "unclosed phrase"), ("()", "empty parentheses"), ("(aa", "missing closing parenthesis"),
    ("AND", "unexpected operator AND"), (")", "unexpected closing parenthesis"), ("aa AND", "unexpected end of query"), (":x", "missing field name in"), ("level:", "missing term in"), ("level:e", "below the minimum length of 2"),
    ("foo-bar", "produces multiple tokens"), ("aa:bb:cc", "produces multiple tokens"), ("xx~3", "fuzzy distance"), ("xx~", "fuzzy distance"), ("~1", "fuzzy distance"), ("aa~1~2", "fuzzy distance"), ("aa~bb", "fuzzy distance"), ('"timeout"', "needs at least two terms"), ('"  "', "needs at least two terms"), ('"-aa bb"', "NOT queries"),
])
def test_rejects(query, message):
    with pytest.raises(BadQuery, match=message.replace("(", r"\(")):
        parse(query)


def test_trees():
    a, b, c = (Term("message", x) for x in ("aa", "bb", "cc"))
    assert parse("aa and bb OR cc") == Or((And((a, b)), c))
    assert parse("aa AND (bb or cc)") == And((a, Or((b, c))))
    assert parse("a:b:cc") == Term("a", "cc")
    assert parse("timeot~1") == Fuzzy("message", "timeot", 1)
    assert parse('"timeout a db"') == Phrase("message", (("timeout", 0), ("db", 2)))
    assert parse('-level:"aa bb"').field == "-level"
    assert parse("message:and") == Term("message", "and") and parse("and~0") == Fuzzy("message", "and", 0)
    assert term_count(parse('aa OR "bb cc" OR aa')) == 4
    assert matches(parse("aa AND (bb OR cc~1)"), {"message:aa", "message:cd"}) and not matches(parse("aa AND bb"), {"message:aa"})


@pytest.mark.parametrize("a, b, n", [("timeot", "timeout", 1), ("timeot", "timeots", 1), ("timeot", "timeot", 0), ("form", "from", 2), ("eror", "error", 1), ("kitten", "sitting", 3), ("", "ab", 2)])
def test_edit_distance(a, b, n):
    assert edit_distance(a, b) == n
