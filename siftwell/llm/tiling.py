"""Benchmark decontamination by greedy string tiling (running Karp-Rabin).

Benchmark items and documents are sequences of word hashes. Shared runs of SEED words are the
seeds: only stretches of a document around them can hold a match, and an item whose words in
seeds cover less than the threshold is passed over. For the rest, running Karp-Rabin finds the
longest matches of unmarked words, marks them in both, and goes on with shorter ones down to
SEED words. The tiles' share of the item's words is its coverage, whatever their order.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.textbatch import small_batches, text_bytes, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED, COVERAGE = 4, 0.5
#: Bytes of benchmark text that are broadcast at once; more is taken in blocks of that size.
BLOCK = 8 << 20
OUT = "doc_id long, item_id long, coverage double, n_tiles int, longest int"


def tiles(item: list[int], doc: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item place, document place, length), longest first, ties by place. Words of -1 match nothing."""
    used_i, used_d = [w == -1 for w in item], [w == -1 for w in doc]
    found: list[tuple[int, int, int]] = []
    s = max(least, len(item) // 2)
    while True:
        while True:  # matches of s words or more
            table = defaultdict(list)
            for a, h in _runs(item, used_i, s):
                table[h].append(a)
            matches, longest = [], s - 1
            for d, h in _runs(doc, used_d, s):
                for a in table.get(h, ()):
                    if a and d and item[a - 1] == doc[d - 1] and not used_i[a - 1] and not used_d[d - 1]:
                        continue  # inside a longer match, which is found where it begins
                    n = 0
                    while a + n < len(item) and d + n < len(doc) and item[a + n] == doc[d + n] and not used_i[a + n] and not used_d[d + n]:
                        n += 1
                    if n >= s:
                        matches.append((n, a, d))
                        longest = max(longest, n)
            if not matches:
                break
            for n, a, d in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
                if n == longest and not any(used_i[a : a + n]) and not any(used_d[d : d + n]):
                    used_i[a : a + n] = used_d[d : d + n] = [True] * n
                    found.append((a, d, n))
        if s <= least:
            return found
        s = max(least, s // 2)


def _runs(words: list[int], used: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(place, Karp-Rabin hash) of each run of s unmarked words."""
    base, mod = 1_000_003, (1 << 61) - 1
    top, h, n = pow(base, s - 1, mod), 0, 0
    for i, w in enumerate(words):
        if used[i]:
            h = n = 0
            continue
        if n == s:
            h, n = (h - words[i - s] * top) % mod, n - 1
        h, n = (h * base + w) % mod, n + 1
        if n == s:
            yield i - s + 1, h


def _seeds(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k if len(out) else 0):
        out = (out ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(j)
    return out


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, seed: int = SEED) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) for each row and item with coverage of ``coverage`` or more.

    Items of fewer than ``seed`` words match nothing, nor do null or empty texts. Repeated rows and
    items give repeated results; null keys are kept as null; ties of tiles go to the first place. Other
    columns are not read; an empty table gives no rows. The items are taken in blocks of bounded size."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`"))
    out, block, size = None, [], 0
    for r in items.select(F.col(f"`{item_key}`").cast("long"), F.col(f"`{item_text}`")).toLocalIterator():
        block.append((r[0], r[1] or ""))
        size += len(block[-1][1].encode())
        if size > BLOCK:
            found = _against(rows, block, coverage, seed)
            out, block, size = found if out is None else out.union(found), [], 0
    found = _against(rows, block, coverage, seed)
    return found if out is None else out.union(found)


def _against(rows: DataFrame, block: list, coverage: float, k: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = []
        seeds, where = [], []
        for n, (_, t) in enumerate(sent.value):
            h, _ = word_hashes(*text_bytes(pa.array([t])))
            items.append([int(x) for x in h])
            s = _seeds(h, k)
            seeds.append(s)
            where.append(np.stack([np.full(len(s), n), np.arange(len(s))], 1))
        all_seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(all_seeds, kind="stable")
        all_seeds = all_seeds[order]
        places = np.concatenate(where)[order] if where else np.zeros((0, 2), int)
        small = np.zeros(1 << 16, bool)
        small[(all_seeds >> np.uint64(48)).astype(np.int64)] = True
        for b in batches:
            got = []
            h, at = word_hashes(*text_bytes(b.column(1)))
            s = _seeds(h, k)
            hit = np.flatnonzero(small[(s >> np.uint64(48)).astype(np.int64)])
            hit = hit[np.isin(s[hit], all_seeds)] if len(all_seeds) else hit[:0]
            doc = np.searchsorted(at, hit, "right") - 1
            inside = hit + k <= at[doc + 1] if len(hit) else hit.astype(bool)
            hit, doc = hit[inside], doc[inside]
            for d in np.unique(doc):
                mine = hit[doc == d]
                covered = defaultdict(set)
                lo, hi = np.searchsorted(all_seeds, s[mine], "left"), np.searchsorted(all_seeds, s[mine], "right")
                for a, z in zip(lo, hi):
                    for n, p in places[a:z]:
                        covered[int(n)].update(range(p, p + k))
                near = [n for n, c in covered.items() if len(c) >= coverage * len(items[n])]
                if not near:
                    continue
                words, last = [], -1
                for p in mine:  # the stretches that seeds cover, apart from each other
                    if last >= 0 and p > last:
                        words.append(-1)
                    words += [int(x) for x in h[max(p, last) : p + k]]
                    last = p + k
                for n in near:
                    t = tiles(items[n], words, k)
                    share = sum(x[2] for x in t) / len(items[n])
                    if share >= coverage:
                        got.append((b.column(0)[int(d)].as_py(), sent.value[n][0], share, len(t), max(x[2] for x in t)))
            c = list(zip(*got)) if got else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32())], ["doc_id", "item_id", "coverage", "n_tiles", "longest"])

    return rows.mapInArrow(run, OUT)


def op5(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every document that holds an item, with the item."""
    return leaks(docs, items)
