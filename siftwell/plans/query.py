"""The query language: lexer, recursive-descent parser and syntax tree."""

from __future__ import annotations

from dataclasses import dataclass

from siftwell.functions.analysis import DEFAULT_FIELD, MIN_TOKEN, analyze, placed, scoped


class BadQuery(ValueError):
    """The query can't be parsed; the message says why."""


@dataclass(frozen=True)
class Term:
    field: str
    term: str


@dataclass(frozen=True)
class Fuzzy:
    field: str
    term: str
    distance: int


@dataclass(frozen=True)
class Phrase:
    """Terms with their distance from the first."""

    field: str
    terms: tuple[tuple[str, int], ...]


@dataclass(frozen=True)
class And:
    kids: tuple


@dataclass(frozen=True)
class Or:
    kids: tuple


SPACES = frozenset(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
NO_NOT = "NOT queries are not supported"


def _quoted(text: str, at: int) -> tuple[str, int]:
    end = text.find('"', at + 1)
    if end < 0:
        raise BadQuery("unclosed phrase")
    if end == at + 1:
        raise BadQuery("empty phrase")
    return text[at + 1 : end], end + 1


def lex(text: str) -> list[tuple[str, str, str]]:
    """(kind, text, field); kinds are ( ) AND OR term phrase."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c in SPACES:
            i += 1
        elif c in "()":
            out.append((c, c, ""))
            i += 1
        elif c == '"':
            body, i = _quoted(text, i)
            out.append(("phrase", body, ""))
        else:
            start = i
            while i < len(text) and text[i] not in SPACES and text[i] not in '()"':
                i += 1
            word = text[start:i]
            if text[i : i + 1] == '"':
                if len(word) < 2 or word[-1] != ":":
                    raise BadQuery("unexpected quote")
                body, i = _quoted(text, i)
                out.append(("phrase", body, word[:-1]))
            elif word.upper() in ("AND", "OR"):
                out.append((word.upper(), word, ""))
            elif word in ("&&", "||"):
                raise BadQuery(f'operator "{word}" is not supported; use AND or OR')
            elif word.upper() == "NOT" or word[0] in "-!":
                raise BadQuery(NO_NOT)
            else:
                out.append(("term", word, ""))
    return out


def _term(raw: str) -> Term | Fuzzy:
    field, colon, value = raw.partition(":")
    if not colon:
        field, value = DEFAULT_FIELD, raw
    elif not field:
        raise BadQuery(f'missing field name in "{raw}"')
    elif value[:1] in ("-", "!"):
        raise BadQuery(NO_NOT)
    if not value:
        raise BadQuery(f'missing term in "{raw}"')
    distance = None
    if "~" in value:
        value, _, number = value.rpartition("~")
        if not value or "~" in value or number not in ("0", "1", "2"):
            raise BadQuery("fuzzy distance must be 0, 1, or 2")
        distance = int(number)
    found = analyze(value)
    if not found:
        raise BadQuery(f'term "{raw}" is below the minimum length of {MIN_TOKEN}')
    if len(found) > 1:
        raise BadQuery(f'term "{raw}" produces multiple tokens; use AND or OR between single terms')
    return Term(field, found[0]) if distance is None else Fuzzy(field, found[0], distance)


def _phrase(field: str, raw: str) -> Phrase:
    if raw[:1] in ("-", "!"):
        raise BadQuery(NO_NOT)
    kept = [(t, p) for p, t in placed(raw) if len(t) >= MIN_TOKEN]
    if len(kept) < 2:
        raise BadQuery(f'phrase "{raw}" needs at least two terms')
    return Phrase(field or DEFAULT_FIELD, tuple((t, p - kept[0][1]) for t, p in kept))


class _Parser:
    def __init__(self, found: list[tuple[str, str, str]]):
        self.found, self.at = found, 0

    def peek(self) -> str:
        return self.found[self.at][0] if self.at < len(self.found) else ""

    def many(self, word: str, part, node):
        kids = [part()]
        while self.peek() == word:
            self.at += 1
            kids.append(part())
        return kids[0] if len(kids) == 1 else node(tuple(kids))

    def any_of(self):
        return self.many("OR", self.all_of, Or)

    def all_of(self):
        return self.many("AND", self.one, And)

    def one(self):
        if not (kind := self.peek()):
            raise BadQuery("unexpected end of query")
        _, text, field = self.found[self.at]
        self.at += 1
        if kind == "term":
            return _term(text)
        if kind == "phrase":
            return _phrase(field, text)
        if kind == "(":
            if self.peek() == ")":
                raise BadQuery("empty parentheses")
            inner = self.any_of()
            if self.peek() != ")":
                raise BadQuery("missing closing parenthesis")
            self.at += 1
            return inner
        raise BadQuery("unexpected closing parenthesis" if kind == ")" else f"unexpected operator {kind}")


def parse(text: str):
    """The tree of a query; raises :class:`BadQuery`."""
    found = lex(text)
    if not found:
        raise BadQuery("query is empty")
    p = _Parser(found)
    node = p.any_of()
    if p.at < len(found):
        raise BadQuery(f'unexpected token "{found[p.at][1]}"; expected AND, OR, or end of query')
    return node


def leaves(node) -> list:
    """Terms, fuzzy terms and phrases, repeated ones too, left to right."""
    return [x for k in node.kids for x in leaves(k)] if isinstance(node, (And, Or)) else [node]


def term_count(node) -> int:
    """Leaves, a phrase counted once for each of its terms."""
    return sum(len(x.terms) if isinstance(x, Phrase) else 1 for x in leaves(node))


def matches(node, keys: set[str]) -> bool:
    """Whether a document with these keys matches; phrases never do here."""
    if isinstance(node, And):
        return all(matches(k, keys) for k in node.kids)
    if isinstance(node, Or):
        return any(matches(k, keys) for k in node.kids)
    if isinstance(node, Fuzzy):
        prefix = node.field + ":"
        return any(k.startswith(prefix) and edit_distance(k[len(prefix) :], node.term) <= node.distance for k in keys)
    return isinstance(node, Term) and scoped(node.field, node.term) in keys


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and substitutions."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]
