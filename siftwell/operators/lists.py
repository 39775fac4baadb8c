"""Postings lists as flat arrays: built, renumbered, checked and coded batch by batch, without a loop per posting.

A row is the part of a key's list that lies in one run of documents: ``first`` and ``last`` document, ``df``, ``cf``,
``bytes`` (what the part takes as varints, without its first document's delta), the documents as distances
from the first (``docs``), the end of each one's positions (``ends``) and the positions (``pos``). Runs of different
tasks never overlap, so the whole list is its parts in the order of ``first``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from siftwell.functions import codec

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this library

#: Documents of a run, where documents are dealt by their numbers.
DEAL = 1 << 12
#: Tokens that are sorted, and positions and bytes that are moved at once: about 100 MB of a Python worker each.
TOKENS, PLACES, BYTES = 500_000, 500_000, 1 << 20
#: Documents from which on a stored list goes on in another row.
LONG = 1 << 13
MIN_TOKEN = 2
#: Stands for a document without a number.
NONE = -(2**63)
NUMBERS = ("first", "last", "df", "cf", "bytes")
ARRAYS = ("docs", "ends", "pos")


def sizes(v: np.ndarray) -> np.ndarray:
    """Bytes of each unsigned number in groups of seven bits."""
    out = np.ones(len(v), np.int64)
    for k in range(1, 9):
        more = v >= 1 << 7 * k
        if not more.any():
            break
        out += more
    return out


def gaps(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each number less the one before it; at a start the number itself."""
    out = np.diff(v, prepend=0)
    out[starts] = v[starts]
    return out


def part(starts: np.ndarray, doc: np.ndarray, tf: np.ndarray, pos: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of lists; ``starts`` are the lists' first postings, of which each has ``tf`` positions."""
    df = np.diff(starts, append=len(doc))
    ends = np.cumsum(tf)
    begins = ends - tf
    cost = sizes(tf) + np.add.reduceat(sizes(gaps(pos, begins)), begins) if len(tf) else tf
    step = sizes(gaps(doc, starts))
    step[starts] = 0
    total = lambda v: np.add.reduceat(v, starts) if len(starts) else v[:0]
    return {"first": doc[starts], "last": doc[starts + df - 1], "df": df, "cf": total(tf), "bytes": total(cost + step), "docs": doc - np.repeat(doc[starts], df), "ends": ends - np.repeat(begins[starts], df), "pos": pos}


def pieces(b: pa.RecordBatch, weights, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most``, or one row, by the rows' weights."""
    w = np.cumsum(_numpy(weights).astype(np.int64)) // most
    edges = [0, *(np.flatnonzero(np.diff(w)) + 1).tolist(), len(b)]
    for i, j in zip(edges, edges[1:]):
        if j > i:
            yield b.slice(i, j - i)


def columns(x: dict[str, np.ndarray], full: bool) -> dict[str, pa.Array]:
    out = {k: pa.array(x[k], pa.int64()) for k in NUMBERS}
    if full:
        lists = pa.array(np.append(0, np.cumsum(x["df"])), pa.int32())
        places = pa.array(np.append(0, np.cumsum(x["cf"])), pa.int32())
        for k in ARRAYS:
            out[k] = pa.ListArray.from_arrays(places if k == "pos" else lists, pa.array(x[k].astype(np.int32)))
    return out


def postings(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, doc, tf, pos) of a batch of lists, as ``part`` takes them."""
    first, df = _numpy(b["first"]), _numpy(pc.list_value_length(b["docs"]))
    doc = np.repeat(first, df) + _numpy(pc.list_flatten(b["docs"]))
    starts = np.cumsum(df) - df
    return starts, doc, gaps(_numpy(pc.list_flatten(b["ends"])).astype(np.int64), starts), _numpy(pc.list_flatten(b["pos"])).astype(np.int64)


def _numpy(a) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False) if isinstance(a, pa.Array) else a.to_numpy()


def _codes(a: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    d = pc.dictionary_encode(_whole(a), null_encoding="encode")
    return _numpy(d.indices), d.dictionary


def _whole(a):
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
        if isinstance(a, pa.ChunkedArray):
            a = pa.concat_arrays(a.chunks)
    return a


def _build(t: pa.Table, group: list[str], laid: bool, form: str) -> pa.RecordBatch | None:
    """Lists of the rows (group, doc, field, toks), which lie in document order: all columns, without arrays (``sizes``) or as bytes (``packed``)."""
    doc = _numpy(t["doc"].fill_null(NONE))
    step = doc[1:] != doc[:-1]
    cut = doc[1:] < doc[:-1]
    cut = cut | (step & (doc[1:] != doc[:-1] + 1)) if laid else cut | (doc[1:] // DEAL != doc[:-1] // DEAL)
    for g in group:
        c = _codes(t[g])[0]
        cut = cut | (c[1:] != c[:-1])
    run, number = np.append(0, np.cumsum(cut)), np.append(0, np.cumsum(cut | step))
    toks = _whole(t["toks"])
    n = _numpy(pc.fill_null(pc.list_value_length(toks), 0)).astype(np.int64)
    code, words = _codes(pc.list_flatten(toks))
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    pos = np.arange(len(code), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
    long = _numpy(pc.greater_equal(pc.utf8_length(words), MIN_TOKEN))[code] if len(code) else np.zeros(0, bool)
    code, row, pos = code[long], row[long], pos[long]
    if not len(code):
        return None
    field, names = _codes(t["field"])
    again = number * len(names) + field
    lid = ((run * len(names) + field) * len(words))[row] + code
    if len(np.unique(again)) < len(again):  # rows of one document and field: their positions mix
        at = np.lexsort((pos, number[row], lid))
    elif int(lid.max()) < 1 << 62 - (bits := len(lid).bit_length()):
        at = lid << bits
        at |= np.arange(len(lid))
        at.sort()
        at &= (1 << bits) - 1
    else:
        at = np.argsort(lid, kind="stable")
    lid, row, pos = lid[at], row[at], pos[at]
    key = np.append(True, lid[1:] != lid[:-1])
    each = key | np.append(True, number[row[1:]] != number[row[:-1]])
    p = np.flatnonzero(each)
    found = np.flatnonzero(key[p]), doc[row[p]], np.diff(p, append=len(pos)), pos
    at = np.flatnonzero(key)
    lead = pa.array(row[at])
    out = {g: _whole(t[g]).take(lead) for g in group}
    word = lid[at] % len(words)
    out["key"] = pc.binary_join_element_wise(names.take(pa.array(field[row[at]])), words.take(pa.array(word)), ":")
    return pa.RecordBatch.from_pydict(out | (packed(*found) if form == "packed" else columns(part(*found), form == "full")))


def packed(starts: np.ndarray, doc: np.ndarray, tf: np.ndarray, pos: np.ndarray) -> dict[str, pa.Array]:
    """Lists as they are shuffled: the first document and ``codec``'s bytes."""
    return {"first": pa.array(doc[starts]), "list": codec.encode_all(starts, doc, tf, pos)}


def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed lists (key, first, list), sorted by key and first document, as lists; neighbours of one key become one up to LONG documents."""
    for whole in batches:
        for b in pieces(whole, pc.binary_length(whole["list"]), BYTES):
            starts, doc, tf, pos = codec.decode_all(b["list"])
            key, first = b["key"], _numpy(b["first"])
            new = np.append(True, _numpy(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)))) if len(b) > 1 else np.ones(1, bool)
            begin = np.flatnonzero(new)
            before = starts - np.repeat(starts[begin], np.diff(begin, append=len(b)))  # documents of the same key before
            at = np.flatnonzero(new | np.append(True, np.diff(before // LONG) != 0) | np.append(True, np.diff(first >> 31) != 0))
            yield pa.RecordBatch.from_pydict({"key": key.take(pa.array(at))} | columns(part(starts[at], doc, tf, pos), True))


def build(batches: Iterable[pa.RecordBatch], group: list[str], laid: bool, form: str) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    tokens = 0
    for b in (x for whole in batches for x in pieces(whole, pc.fill_null(pc.list_value_length(whole["toks"]), 0), TOKENS // 4)):
        t = pa.Table.from_batches([b])
        held.append(t)
        tokens += pc.sum(pc.list_value_length(t["toks"])).as_py() or 0
        if tokens >= TOKENS:
            whole = pa.concat_tables(held).combine_chunks()
            last = whole.slice(len(whole) - 1).select([*group, "doc"]).to_pylist()[0]
            n = len(whole)  # the last document's rows may go on
            tail = whole.select([*group, "doc"])
            while n and tail.slice(n - 1, 1).to_pylist()[0] == last:
                n -= 1
            if n and (out := _build(whole.slice(0, n).combine_chunks(), group, laid, form)) is not None:
                yield out
            held = [whole.slice(n)]
            tokens = pc.sum(pc.list_value_length(held[0]["toks"])).as_py() or 0
    if held and (out := _build(pa.concat_tables(held).combine_chunks(), group, laid, form)) is not None:
        yield out


@dataclass
class Numbering:
    """New numbers of live documents: a bit for each document in blocks of ``block``, and where a block's numbers begin."""

    block: int
    segs: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]  # seg: block numbers ascending, their first new numbers, bits

    def __post_init__(self):
        self.ranks: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"ranks": {}}

    def new(self, seg: str, doc: np.ndarray) -> np.ndarray:
        """New numbers of a segment's documents; -1 where a document isn't live."""
        if seg not in self.segs:
            return np.full(len(doc), -1)
        blocks, offsets, bits = self.segs[seg]
        if seg not in self.ranks:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks[seg] = np.cumsum(ones, axis=1) - ones
        b = doc // self.block
        at = np.minimum(np.searchsorted(blocks, b), len(blocks) - 1)
        low = doc - b * self.block
        byte = bits[at, low >> 3]
        there = (blocks[at] == b) & ((byte >> (low & 7).astype(np.uint8)) & 1).astype(bool)
        below = np.bitwise_count(byte & ((1 << (low & 7)) - 1).astype(np.uint8))
        return np.where(there, offsets[at] + self.ranks[seg][at, low >> 3] + below, -1)

    def all(self, code: np.ndarray, segs: list[str], doc: np.ndarray) -> np.ndarray:
        """The same for documents of many segments, each by its place in ``segs``."""
        out = np.full(len(doc), -1, np.int64)
        for k, seg in enumerate(segs):
            mine = code == k
            out[mine] = self.new(seg, doc[mine])
        return out


def bits(doc: np.ndarray, block: int) -> bytes:
    there = np.zeros(block, bool)
    there[doc % block] = True
    return np.packbits(there, bitorder="little").tobytes()


def moved(batches: Iterable[pa.RecordBatch], numbering: Numbering, form: str) -> Iterator[pa.RecordBatch]:
    """Lists with new numbers, without dead documents; ``seg`` goes."""
    for whole in batches:
        for b in pieces(whole, pc.list_value_length(whole["pos"]), PLACES):
            starts, doc, tf, pos = postings(b)
            of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(doc)))
            code, names = _codes(b["seg"])
            new = numbering.all(code[of], names.to_pylist(), doc)
            live = new >= 0
            if live.any():
                pos, doc, tf, of = pos[np.repeat(live, tf)], new[live], tf[live], of[live]
                starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                found = starts, doc, tf, pos
                yield pa.RecordBatch.from_pydict({"key": _whole(b["key"]).take(pa.array(of[starts]))} | (packed(*found) if form == "packed" else columns(part(*found), form == "full")))


def repacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in pieces(whole, pc.list_value_length(whole["pos"]), PLACES):
            yield pa.RecordBatch.from_pydict({"key": b["key"]} | packed(*postings(b)))


def faults(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_order, pos_order) of each batch: documents or positions that don't ascend; numbers that the arrays don't give count as the first."""
    for whole in batches:
        for b in pieces(whole, pc.list_value_length(whole["pos"]), PLACES):
            bad, worse = _faults(b)
            yield pa.RecordBatch.from_pydict({"doc_order": pa.array([bad], pa.int64()), "pos_order": pa.array([worse], pa.int64())})


def _faults(b: pa.RecordBatch) -> tuple[int, int]:
    n = _numpy(pc.list_value_length(b["docs"]))
    if not (n > 0).all() or not (_numpy(pc.list_value_length(b["ends"])) == n).all():
        return 1, 0
    starts, doc, tf, pos = postings(b)
    if (tf < 1).any() or not (np.add.reduceat(tf, starts) == _numpy(pc.list_value_length(b["pos"]))).all():
        return 0, 1
    begins = np.cumsum(tf) - tf
    fall, turn = np.diff(doc, prepend=0) <= 0, np.diff(pos, prepend=0) <= 0
    fall[starts], turn[begins] = False, pos[begins] < 0
    if fall.any() or turn.any():
        return int(fall.sum()), int(turn.sum())
    x = part(starts, doc, tf, pos)
    return int(sum((x[k] != _numpy(b[k])).sum() for k in NUMBERS)), 0


def encoded(batches: Iterable[pa.RecordBatch], group: list[str]) -> Iterator[pa.RecordBatch]:
    """Lists as the bytes that ``codec.encode`` gives."""
    for whole in batches:
        for b in pieces(whole, pc.list_value_length(whole["pos"]), PLACES):
            yield pa.RecordBatch.from_pydict({g: b[g] for g in group} | {"bytes": codec.encode_all(*postings(b))})


def decoded(batches: Iterable[pa.RecordBatch], group: list[str]) -> Iterator[pa.RecordBatch]:
    """The inverse of ``encoded``."""
    for whole in batches:
        for b in pieces(whole, pc.binary_length(whole["bytes"]), BYTES):
            x = part(*codec.decode_all(b["bytes"]))
            yield pa.RecordBatch.from_pydict({g: b[g] for g in group} | columns(x, True))
