"""Trigram queries: what trigrams a text must hold if a regular expression matches anywhere in it."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as P

#: Strings that an alternative may spell out before it is cut into pieces.
MOST = 64


@dataclass(frozen=True)
class Query:
    """``kind`` is 'all' (everything matches), 'tri', 'and' or 'or'."""

    kind: str
    tri: str = ""
    kids: tuple["Query", ...] = ()

    def trigrams(self) -> set[str]:
        return {self.tri} if self.kind == "tri" else set().union(*(k.trigrams() for k in self.kids))

    def holds(self, present: set[str]) -> bool:
        if self.kind == "tri":
            return self.tri in present
        return all(k.holds(present) for k in self.kids) if self.kind != "or" else any(k.holds(present) for k in self.kids)


ALL = Query("all")


def both(*qs: Query) -> Query:
    flat = list(dict.fromkeys(k for q in qs if q.kind != "all" for k in (q.kids if q.kind == "and" else (q,))))
    return ALL if not flat else flat[0] if len(flat) == 1 else Query("and", kids=tuple(flat))


def either(*qs: Query) -> Query:
    if not qs or any(q.kind == "all" for q in qs):
        return ALL
    leaves = {q: frozenset(k for k in (q.kids if q.kind == "and" else (q,))) for q in qs}
    flat = [q for q in leaves if not any(leaves[o] < leaves[q] for o in leaves)]  # an alternative that needs more than another adds nothing
    return flat[0] if len(flat) == 1 else Query("or", kids=tuple(flat))


def of_string(s: str) -> Query:
    return both(*(Query("tri", s[i : i + 3]) for i in range(len(s) - 2)))


def derive(pattern: str) -> Query:
    """The query of a pattern, over lower-cased text; ALL where no trigram is mandatory."""
    need, exact = _sequence(P.parse(pattern))
    return both(need, either(*map(of_string, exact)) if exact else ALL)


def _chars(items) -> set[str] | None:
    """Lower-cased members of a character class, if they are few."""
    out: set[str] = set()
    for op, v in items:
        if op is C.LITERAL:
            out.add(chr(v).lower())
        elif op is C.RANGE and v[1] - v[0] < 8:
            out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _node(op, v) -> tuple[Query, set[str] | None]:
    """What a node needs in any case, and all strings that it can be (None: too many)."""
    if op is C.LITERAL:
        return ALL, {chr(v).lower()}
    if op is C.IN:
        return ALL, _chars(v)
    if op is C.SUBPATTERN:
        need, strings = _sequence(v[3])
        return need, strings
    if op is C.BRANCH:
        kids = [_sequence(x) for x in v[1]]
        if all(s is not None for _, s in kids) and len(u := set().union(*(s for _, s in kids))) <= MOST:
            return either(*(n for n, _ in kids)), u
        return either(*(both(n, either(*map(of_string, s)) if s else ALL) for n, s in kids)), None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, body = v
        need, strings = _sequence(body)
        if high == 1 and low == 0:
            return ALL, None if strings is None else strings | {""}
        if low == high == 1:
            return need, strings
        if low and strings and low <= 8 and len(strings) ** low <= MOST:
            repeated = {"".join(p) for p in product(strings, repeat=low)}
            return (need, repeated) if low == high else (both(need, either(*map(of_string, repeated))), None)
        return (need if low else ALL), None
    if op is C.AT:
        return ALL, {""}
    return ALL, None


def _sequence(nodes) -> tuple[Query, set[str] | None]:
    need, run, whole = ALL, {""}, True
    for op, v in nodes:
        n, strings = _node(op, v)
        need = both(need, n)
        if strings is not None and len(joined := {a + b for a in run for b in strings}) <= MOST:
            run = joined
            continue
        need, whole = both(need, either(*map(of_string, run))), False
        run = strings if strings is not None else {""}
    return (need, run) if whole else (both(need, either(*map(of_string, run))), None)
