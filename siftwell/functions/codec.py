"""Postings lists as bytes: counts, document deltas, frequencies and position deltas in groups of seven bits.

The Parquet segments don't need this coding; it is what sizes are counted in, and an exchange format.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST = 2**32 - 1
LIST = "array<struct<doc:bigint,pos:array<int>>>"


class BadPostings(ValueError):
    """Bytes that are no postings list."""


def put(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def take(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data):
            raise BadPostings("the list ends inside a number")
        if shift > 63:
            raise BadPostings("a number has too many bytes")
        n |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return n, at
        shift += 7


def encode(postings: list[tuple[int, list[int]]]) -> bytes:
    """(document, positions) in ascending order, both."""
    out, last = bytearray(), -1
    put(out, len(postings))
    for doc, pos in postings:
        if doc <= last or doc > MOST or not pos or any(b <= a for a, b in zip([-1, *pos], pos)) or pos[-1] > MOST:
            raise BadPostings("documents and positions must ascend, and each document has one")
        put(out, doc - max(last, 0))
        put(out, len(pos))
        for a, b in zip([0, *pos], pos):
            put(out, b - a)
        last = doc
    return bytes(out)


def decode(data: bytes) -> list[tuple[int, list[int]]]:
    """The inverse of ``encode``; what it can't have made is refused: counts beyond the bytes, numbers out of range or order, bytes left over."""
    count, at = take(data, 0)
    if count > len(data):
        raise BadPostings("more documents than bytes")
    out, doc = [], -1
    for i in range(count):
        delta, at = take(data, at)
        if i and not delta:
            raise BadPostings("documents don't ascend")
        doc = max(doc, 0) + delta
        freq, at = take(data, at)
        if doc > MOST or not 0 < freq <= len(data) - at:
            raise BadPostings("a document or its frequency is out of range")
        pos: list[int] = []
        for j in range(freq):
            step, at = take(data, at)
            if j and not step or (pos[-1] if pos else 0) + step > MOST:
                raise BadPostings("positions don't ascend or are out of range")
            pos.append((pos[-1] if pos else 0) + step)
        out.append((doc, pos))
    if at != len(data):
        raise BadPostings("bytes after the list")
    return out


def _inner(n: int, starts: np.ndarray) -> np.ndarray:
    out = np.ones(n, bool)
    out[starts] = False
    return out


def _steps(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.diff(v, prepend=0)
    out[starts] = v[starts]
    return out


def encode_all(starts: np.ndarray, doc: np.ndarray, tf: np.ndarray, pos: np.ndarray) -> pa.Array:
    """``encode`` of many lists: the first posting of each, and each posting's document, number of positions and positions."""
    begins = np.cumsum(tf) - tf
    step, move = _steps(doc, starts), _steps(pos, begins)
    if (tf < 1).any() or (step < _inner(len(doc), starts)).any() or (doc > MOST).any() or (move < _inner(len(pos), begins)).any() or (pos > MOST).any():
        raise BadPostings("documents and positions must ascend, and each document has one")
    df = np.diff(starts, append=len(doc))
    of = np.repeat(np.arange(len(starts)), df)
    head = begins + 2 * np.arange(len(doc)) + of + 1  # where a posting's numbers begin among all numbers
    v = np.empty(len(starts) + 2 * len(doc) + len(pos), np.int64)
    v[head[starts] - 1], v[head], v[head + 1] = df, step, tf
    v[np.repeat(head + 2 - begins, tf) + np.arange(len(pos))] = move
    size = np.ones(len(v), np.int64)
    for k in range(1, 5):
        size += v >= 1 << 7 * k
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(5):
        on = size > k
        if not on.any():
            break
        out[at[on] + k] = (v[on] >> 7 * k & 127) | (size[on] > k + 1) * 128
    offsets = np.append(at[head[starts] - 1], len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def decode_all(data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The inverse of ``encode_all``. Lists that can't be read at once are read one by one, which refuses what ``decode`` refuses."""
    lists = data.to_pylist()
    raw = np.frombuffer(b"".join(lists), np.uint8)
    found = _decode_all(raw, np.cumsum([0, *map(len, lists)]))
    if found is None:
        each = [decode(x) for x in lists]
        if not all(each):
            raise BadPostings("a list without documents")
        rows = [*chain.from_iterable(each)]
        of, doc, tf, pos = [0, *map(len, each[:-1])], [d for d, _ in rows], [len(p) for _, p in rows], [*chain.from_iterable(p for _, p in rows)]
        found = np.cumsum(of), *(np.array(x, np.int64) for x in (doc, tf, pos))
    return found


def _decode_all(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    last = np.flatnonzero(raw < 128)
    size = np.diff(last, prepend=-1)
    if not len(last) or last[-1] != len(raw) - 1 or size.max() > 5 or (np.diff(bounds) < 1).any() or (raw[bounds[1:] - 1] > 127).any():
        return None
    begin = last - size + 1
    v = np.zeros(len(last), np.int64)
    for k in range(int(size.max())):
        on = size > k
        v[on] |= (raw[begin[on] + k] & 127).astype(np.int64) << 7 * k
    first = np.searchsorted(begin, bounds[:-1])
    edges, values, heads = [*first.tolist(), len(v)], v.tolist(), []
    try:
        for a, end in zip(edges, edges[1:]):
            i = a + 1
            for _ in range(min(values[a], end - a)):
                heads.append(i)
                i += 2 + values[i + 1]
            if i != end or not values[a] or values[a] > end - a:
                return None
    except IndexError:
        return None
    head = np.array(heads)
    step, tf, df = v[head], v[head + 1], v[first]
    other = np.ones(len(v), bool)
    other[first] = other[head] = other[head + 1] = False
    move, starts, begins = v[other], np.cumsum(df) - df, np.cumsum(tf) - tf
    if (tf < 1).any() or (step < _inner(len(step), starts)).any() or (move < _inner(len(move), begins)).any():
        return None
    whole = lambda x, at, n: (c := np.cumsum(x)) - np.repeat(c[at] - x[at], n)
    doc, pos = whole(step, starts, df), whole(move, begins, tf)
    return None if doc.max() > MOST or pos.max() > MOST else (starts, doc, tf, pos)


def encoded(postings: Column) -> Column:
    """A column of (doc, pos) arrays as bytes; keep arrays bounded, as by blocks of documents."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([encode([(p["doc"], [*map(int, p["pos"])]) for p in x]) for x in s], dtype=object)

    return run(postings)


def decoded(data: Column) -> Column:
    """The inverse of ``encoded``; a list that isn't one fails the job."""

    @F.pandas_udf(LIST)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[{"doc": d, "pos": p} for d, p in decode(x)] for x in s], dtype=object)

    return run(data)
