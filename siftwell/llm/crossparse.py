"""LM scoring by Ziv-Merhav cross-parsing of each row against all other rows of the corpus.

A text is the sequence of its words. It is factored greedily into phrases: at each place the
longest match, of whatever length, in any other row. A suffix automaton of the reference
gives those matches (``automaton``, ``cross_phrases``), but one of a whole corpus fits in no
worker, so the matches of all rows are found at once from the sorted suffixes, which hold the same:

1. ``lay``: each task writes the words of its distinct texts (32-bit symbols) to a file in the shared folder.
2. ``deal``: each place goes to the bucket of its first two words; places whose first words are
   hot (by a sample, in two rows at least) to that of three, four ... words, so no bucket holds them all.
3. ``match``: a bucket is sorted by up to LONGEST words; a place's longest match is that of its nearest
   neighbours from other rows. A match of one word counts as none: either is a phrase of one word.
   Of matches of LONGEST words or more, those whose words all follow the same word end where the match from
   the place before ends; for the others ``extend`` finds the length by doubling and halving, from hashes of
   the words (``sums``: 62 bits, kept for each EVERY words, so a hash of any length takes a few steps).
4. ``parse``: the lengths return to each file, and its texts are factored. No match ends before that from
   the place before, so the ends that were left out are the largest so far.

The number of phrases c(z|x) with the LZ78 phrases of the text itself, c(z), gives the relative
entropy (c(z|x) log n - c(z) log c(z)) / n of its n words.
"""

from __future__ import annotations

import math
import os
import sys
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.textbatch import mix, shared_dir, small_batches, text_bytes, text_hash, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words that a bucket is sorted by (longer matches are extended), and words that are compared at once.
LONGEST, STEP = 16, 4
#: Words between two sums, and the primes and bases of the sums.
EVERY, SUMS = 16, ((2147483647, 1288490189), (2147483629, 917361427))
#: Places of a bucket as expected, places sampled for each bucket, words that hot places are told apart by, places that a task deals at once.
BUCKET, SAMPLED, DEEPEST, AT_ONCE = 1 << 20, 64, 12, 1 << 20
OUT = "doc_id long, n_bytes long, n_words long, n_phrases long, n_own_phrases long, cross_entropy double, score double"


def automaton(data: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``data``; state 0 is the start."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        cur = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = cur
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(move)
                move.append(move[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return move


def cross_phrases(data: list[int], move: list[dict[int, int]]) -> int:
    """Phrases of the greedy factoring: longest matches of at most LONGEST symbols, or single symbols that the reference lacks."""
    start = move[0]
    n, here, size = 0, None, 0
    for c in data:
        if here is not None and size < LONGEST:
            s = here.get(c)
            if s is not None:
                here, size = move[s], size + 1
                continue
        n, size = n + 1, 1
        s = start.get(c)
        here = move[s] if s is not None else None
    return n


def own_phrases(data: list[int]) -> int:
    """LZ78 phrases."""
    table: dict[int, int] = {}
    n, node = 0, 0
    for c in data:
        k = node << 32 | c
        node = table.get(k, 0)
        if not node:
            n += 1
            table[k] = n
    return n + (node > 0)


def entropy(n: int, cross: int, own: int) -> tuple[float, float]:
    """Cross-entropy and relative entropy in bits a word; 0 for texts without words."""
    if not n:
        return 0.0, 0.0
    return cross * math.log2(n + 1) / n, (cross * math.log2(n + 1) - own * math.log2(max(own, 1))) / n


def _save(folder: str, name: str, data: np.ndarray) -> None:
    """A whole file or none, whatever tasks are repeated."""
    own = f"{folder}/{name}.{uuid.uuid4().hex}.npy"
    np.save(own, data)
    os.replace(own, f"{folder}/{name}.npy")


def _load(folder: str, name: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


def _power(p: int, base: int, x: np.ndarray) -> np.ndarray:
    """base ** x modulo p for x below 2 ** 32."""
    low, high = np.ones(1, np.uint64), np.ones(1, np.uint64)
    while len(low) < 1 << 16:
        low = np.concatenate([low, low * np.uint64(pow(base, len(low), p)) % np.uint64(p)])
        high = np.concatenate([high, high * np.uint64(pow(base, len(high) << 16, p)) % np.uint64(p)])
    return low[x & 0xFFFF] * high[x >> 16] % np.uint64(p)


def _inner(words: np.ndarray, p: int, base: int) -> np.ndarray:
    """Sum of words[:, j] * base ** j modulo p."""
    powers = np.array([pow(base, j, p) for j in range(EVERY)], np.uint64)
    return (words % np.uint64(p) * powers % np.uint64(p)).sum(1) % np.uint64(p)


def sums(words: np.ndarray) -> np.ndarray:
    """For each of SUMS, the sum of word * base ** place over the words before each place that EVERY divides."""
    blocks = np.zeros((len(words) // EVERY + 1, EVERY), np.uint64)
    blocks.ravel()[: len(words)] = words
    out = np.zeros((len(SUMS), len(blocks)), np.uint32)
    for i, (p, base) in enumerate(SUMS):
        power = _power(p, base, np.arange(len(blocks)) * EVERY)
        out[i, 1:] = (np.cumsum(_inner(blocks, p, base) * power % np.uint64(p)) % np.uint64(p))[:-1]
    return out


class Prefixes:
    """Hashes of the words from places on; place i is ``at[i]`` of file ``of[i]``, of (words, sums) each."""

    def __init__(self, files: list[tuple[np.ndarray, np.ndarray]], of: np.ndarray, at: np.ndarray):
        self.files, self.of, self.at = files, of, at
        self.before = self.upto(np.arange(len(at)), np.zeros(len(at), np.int64))
        self.scale = [_power(p, base, (1 << 32) - 1 - at) for p, base in SUMS]

    def upto(self, i: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        end = self.at[i] + size
        order = np.argsort(self.of[i], kind="stable")
        some, cut = np.unique(self.of[i][order], return_index=True)
        held, known = np.zeros((len(i), EVERY), np.uint64), np.zeros((len(SUMS), len(i)), np.uint64)
        for f, x in zip(some, np.split(order, cut[1:])):
            words, total = self.files[f]
            block = end[x] // EVERY
            held[x] = words[np.minimum((block * EVERY)[:, None] + np.arange(EVERY), len(words) - 1)]
            known[:, x] = total[:, block]
        held[np.arange(EVERY) >= (end % EVERY)[:, None]] = 0
        return [(known[j] + _inner(held, p, base) * _power(p, base, end - end % EVERY)) % np.uint64(p) for j, (p, base) in enumerate(SUMS)]

    def __call__(self, i: np.ndarray, size: np.ndarray) -> np.ndarray:
        a, b = ((z + np.uint64(p) - x[i]) % np.uint64(p) * k[i] % np.uint64(p) for z, x, k, (p, _) in zip(self.upto(i, size), self.before, self.scale, SUMS))
        return a << np.uint64(32) | b


def _split(group: np.ndarray, key: np.ndarray, ok: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part of its group that each entry is in by ``key``; whether that has two texts; and, of such parts, an entry of two texts each."""
    order = np.lexsort((doc, key, ~ok, group))
    g, k, o, d = group[order], key[order], ok[order], doc[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1]) | (o[1:] != o[:-1])])[: len(g)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(g)) - 1
    two = (d[first] != d[last]) & o[first]
    part, good, some = np.empty(len(g), np.int64), np.empty(len(g), bool), np.zeros(len(g), bool)
    part[order] = np.cumsum(new) - 1
    good[order] = two[np.cumsum(new) - 1]
    some[order[first[two]]] = some[order[last[two]]] = True
    return part, good, some


def extend(hashes, group: np.ndarray, doc: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The longest match of each entry with one of another text; those of a ``group`` share LONGEST words at least, ``left``: words to the text's end.

    ``hashes(entries, sizes)`` tells the first words apart. A group is parted by twice as many words as it shares while
    parts hold two texts. What is left of it, with two entries of each part for all of that part, is parted
    by half as many more, a quarter, ...: again what has no other text stays behind and asks for less."""
    out = np.full(len(group), LONGEST, np.int64)
    live, size, held = np.arange(len(group)), LONGEST, []
    while len(live):
        part, good, some = _split(group, hashes(live, np.minimum(left[live], 2 * size)), left[live] >= 2 * size, doc[live])
        stay = (~good | some) & np.isin(group, group[~good])
        held.append((live[stay], group[stay] + (len(held) << 40), np.full(stay.sum(), size), ~good[stay]))
        live, group, size = live[good], part[good], 2 * size
    if not held:
        return out
    at, group, now, asks = (np.concatenate(x) for x in zip(*held))
    step = now // 2
    while len(at):
        part, good, some = _split(group, hashes(at, np.minimum(left[at], now + step)), left[at] >= now + step, doc[at])
        got = good & np.isin(part, part[good & asks])
        stay = (~good | some) & np.isin(group, group[~good & asks])
        asked = asks & ~good
        group = np.concatenate([part[got] * 2, np.unique(group, return_inverse=True)[1][stay] * 2 + 1])
        now, step = np.concatenate([(now + step)[got], now[stay]]), np.concatenate([step[got], step[stay]]) // 2
        at, asks = np.concatenate([at[got], at[stay]]), np.concatenate([asks[got], asked[stay]])
        done = step == 0
        out[at[done & asks]] = now[done & asks]
        at, group, now, step, asks = (x[~done] for x in (at, group, now, step, asks))
    return out


def _lay(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, known, symbols, sizes, own, more, rows = TaskContext.get().partitionId(), {}, [], [], [], [], []
        for b in batches:
            h, at = word_hashes(*text_bytes(b.column(1)))
            words = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)  # 0 ends a text
            for i, (key, n, x, y) in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 2, 3, 4)))):
                j = known.setdefault((x, y), len(known))
                if j == len(sizes):
                    w = words[at[i] : at[i + 1]]
                    symbols += [w, np.zeros(1, np.uint32)]
                    sizes.append(len(w) + 1)
                    own.append(own_phrases(w.tolist()))
                    more.append(False)
                else:
                    more[j] = True
                rows.append((key if key is not None else 0, key is None, j, n))
        words = np.concatenate(symbols) if symbols else np.zeros(0, np.uint32)
        _save(folder, f"words-{k}", words)
        _save(folder, f"sums-{k}", sums(words))
        _save(folder, f"starts-{k}", np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        _save(folder, f"texts-{k}", np.array([own, more], np.int64))
        _save(folder, f"rows-{k}", np.array(rows, np.int64).reshape(-1, 4).T)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["k", "n"])

    return run


def _grams(words: np.ndarray, at: np.ndarray, depth: int, before: np.ndarray | None) -> np.ndarray:
    """Hashes of ``depth`` words at places ``at``; ``before``: those of a word less."""
    last = words[np.minimum(at + depth - 1, len(words) - 1)].astype(np.uint64)
    return mix((before if before is not None else np.uint64(0)) + last * np.uint64(0x9E3779B97F4A7C15) + np.uint64(depth))


def hot_grams(folder: str, sizes: dict[int, int], buckets: int) -> list[np.ndarray]:
    """For 2, 3 ... DEEPEST words, the hashes of those that are a quarter of a bucket or more of a sample, and in two rows."""
    total, rng = sum(sizes.values()), np.random.Generator(np.random.PCG64(11))
    seen: list[Counter] = [Counter() for _ in range(DEEPEST - 1)]
    texts: list[dict] = [{} for _ in range(DEEPEST - 1)]
    for k, n in sizes.items():
        words, starts = _load(folder, f"words-{k}"), _load(folder, f"starts-{k}")
        at = rng.integers(0, n, max(1, round(buckets * SAMPLED * n / total)))
        at, text = at[words[at] != 0], np.searchsorted(starts, at[words[at] != 0], "right")
        g, alive = _grams(words, at, 1, None), np.ones(len(at), bool)
        for d in range(2, DEEPEST + 1):
            alive &= words[np.minimum(at + d - 1, n - 1)] != 0
            g = _grams(words, at, d, g)
            for x, t in zip(g[alive].tolist(), text[alive].tolist()):
                seen[d - 2][x] += 1
                texts[d - 2].setdefault(x, set()).add((k, t)) if len(texts[d - 2].get(x, ())) < 2 else None
    return [np.sort(np.array([x for x, c in s.items() if c >= max(4, SAMPLED // 4) and len(w[x]) > 1], np.uint64)) for s, w in zip(seen, texts)]


def _deal(folder: str, buckets: int, hot: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, begin in zip(*(c.to_pylist() for c in b.columns)):
                words = _load(folder, f"words-{k}")
                part = np.array(words[begin : begin + AT_ONCE + DEEPEST])
                n = min(AT_ONCE, len(words) - begin)
                at = np.flatnonzero(part[:n] != 0)
                at = at[part[np.minimum(at + 1, len(part) - 1)] != 0]
                g = _grams(part, at, 2, _grams(part, at, 1, None))
                depth, deeper = np.full(len(at), 2, np.uint8), np.arange(len(at))
                for d, known in enumerate(hot, 2):
                    if not len(known) or not len(deeper) or d == DEEPEST:
                        break
                    x = g[deeper]
                    deeper = deeper[known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x]
                    depth[deeper] = d + 1
                    g[deeper] = _grams(part, at[deeper], d + 1, g[deeper])
                to = (g % np.uint64(buckets)).astype(np.int64) << 4 | depth
                order = np.argsort(to, kind="stable")
                at, to = at[order], to[order]
                own, cut = np.unique(to, return_index=True)
                sent = [np.diff(x, prepend=0).astype(np.uint32).tobytes() for x in np.split(at, cut[1:])] if len(own) else []
                yield pa.RecordBatch.from_arrays([pa.array(own >> 4), pa.array((own & 15).astype(np.int32)), pa.array([k] * len(own), pa.int64()), pa.array([begin] * len(own), pa.int64()), pa.array(sent, pa.binary())], ["bucket", "depth", "k", "begin", "at"])

    return run


def match_lengths(keys, doc: np.ndarray) -> np.ndarray:
    """Each place's longest match with a place of another text, up to LONGEST words.

    ``keys(places, depth)`` gives the STEP words from ``depth`` on, as (places, STEP) symbols, 0 from the text's end on."""
    n = len(doc)
    order, lcp, open_ = np.arange(n), np.zeros(n, np.int64), np.arange(n)  # lcp[i]: of the places i - 1 and i in order
    group = np.zeros(n, np.int64)
    for depth in range(0, LONGEST, STEP):
        place = order[open_]
        w = keys(place, depth)
        pair = [w[:, j].astype(np.uint64) << np.uint64(32) | w[:, j + 1] for j in range(0, STEP, 2)]
        sort = np.lexsort([*pair[::-1], group])
        order[open_] = place[sort]
        w, group = w[sort], group[sort]
        same = (w[1:] == w[:-1]) & (w[1:] != 0)
        equal = np.where(same.all(1), STEP, same.argmin(1))
        both = group[1:] == group[:-1]
        lcp[open_[1:]] = np.where(both, depth + equal, lcp[open_[1:]])
        tie = both & (equal == STEP)
        live = np.concatenate([tie, [False]]) | np.concatenate([[False], tie])
        group = np.cumsum(np.concatenate([[True], ~tie]))[live]
        open_ = open_[live]
        if not len(open_):
            break
    doc = doc[order]
    other = np.concatenate([[True], doc[1:] != doc[:-1]])

    def nearest(length: np.ndarray, first: np.ndarray) -> np.ndarray:
        run = 64 * np.cumsum(first)  # the least length since the last place of another text
        return np.minimum.accumulate(length - run) + run

    out = np.empty(n, np.int64)
    down = np.append(lcp[1:], 0)[::-1]
    out[order] = np.maximum(nearest(lcp, other), nearest(down, np.append(other[1:], True)[::-1])[::-1])
    return out


def _match(folder: str):
    def bucket(held: list[tuple[int, int, np.ndarray]]):
        at: dict[int, list] = {}
        for k, depth, x in held:
            at.setdefault(k, []).append((x, np.full(len(x), depth - 1)))
        ks = sorted(at)
        places = [np.concatenate([x for x, _ in at[k]]) for k in ks]
        least = np.concatenate([np.concatenate([d for _, d in at[k]]) for k in ks])
        cut, words = np.cumsum([0, *map(len, places)]), [_load(folder, f"words-{k}") for k in ks]
        starts = [_load(folder, f"starts-{k}") for k in ks]
        text = [np.searchsorted(x, p, "right") for x, p in zip(starts, places)]
        doc = np.concatenate([t + (k << 32) for k, t in zip(ks, text)])
        flat = np.concatenate(places)
        first = np.zeros((len(flat), LONGEST), np.uint32)
        for i, (w, p) in enumerate(zip(words, places)):
            first[cut[i] : cut[i + 1]] = w[np.minimum(p[:, None] + np.arange(LONGEST), len(w) - 1)]
        first[np.cumsum(first == 0, axis=1, dtype=np.uint8) > 0] = 0
        found = np.maximum(match_lengths(lambda i, d: first[i, d : d + STEP], doc), np.where(least > 1, least, 0))
        full = np.flatnonzero(found == LONGEST)
        if len(full):
            gram = np.zeros(len(full), np.uint64)
            for j in range(LONGEST):
                gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + first[full, j])
            before = np.concatenate([np.where(p > 0, w[np.maximum(p - 1, 0)], 0) for w, p in zip(words, places)])[full]
            order = np.argsort(gram, kind="stable")
            new = np.concatenate([[True], np.diff(gram[order]) != 0])
            begin, group = np.flatnonzero(new), np.cumsum(new) - 1
            least_, most = np.minimum.reduceat(before[order], begin), np.maximum.reduceat(before[order], begin)
            varied = ((least_ != most) | (least_ == 0))[group]
            found[full[order[~varied]]] = 0  # the place before tells where the match ends
            asked = full[order[varied]]
            of = np.repeat(np.arange(len(ks)), np.diff(cut))[asked]
            left = np.concatenate([x[t] - 1 - p for x, t, p in zip(starts, text, places)])[asked]
            files = [(w, _load(folder, f"sums-{k}")) for k, w in zip(ks, words)]
            found[asked] = extend(Prefixes(files, of, flat[asked]), group[varied], doc[asked], left)
        for i, k in enumerate(ks):
            n, p = found[cut[i] : cut[i + 1]], places[i]
            for good, kind in ((np.flatnonzero((n > 1) & (n < 256)), np.uint8), (np.flatnonzero(n > 255), np.uint32)):
                good = good[np.argsort(p[good], kind="stable")]
                if len(good):
                    yield k, np.diff(p[good], prepend=0).astype(np.uint32).tobytes(), n[good].astype(kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*bucket(held))) or ((), (), ()), (pa.int64(), pa.binary(), pa.binary()))], ["k", "at", "n"])

        for b in batches:
            for to, depth, k, begin, x in zip(*(c.to_pylist() for c in b.columns)):
                if to != now and held:
                    yield rows()
                    held = []
                now = to
                held.append((k, depth, np.cumsum(np.frombuffer(x, np.uint32), dtype=np.int64) + begin))
        if held:
            yield rows()

    return run


def _parse(folder: str, longest: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, length = None, None

        def done() -> pa.RecordBatch:
            starts, (own, more), rows = _load(folder, f"starts-{now}"), _load(folder, f"texts-{now}"), _load(folder, f"rows-{now}")
            out, ends = [], length
            np.maximum.accumulate(ends, out=ends)
            if longest:
                ends = np.minimum(ends, np.arange(len(ends)) + longest)
            for a, z, mine, again in zip(starts.tolist(), starts[1:].tolist(), own.tolist(), more.tolist()):
                i, n, end = 0, 0, z - 1 - a
                if again:  # another row of this file has the text
                    n = -(-end // (longest or max(end, 1)))
                else:
                    jump = (ends[a : z - 1] - a).tolist()
                    while i < end:
                        i = jump[i]
                        n += 1
                out.append((end, n, mine, *entropy(end, n, mine)))
            columns = list(zip(*(out[j] for j in rows[2].tolist())))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64(), mask=np.array(rows[1], bool)), pa.array(rows[3]), *(pa.array(c, t) for c, t in zip(columns, kinds))], [x.split()[0] for x in OUT.split(", ")])

        for b in batches:
            for k, at, n in zip(*(c.to_pylist() for c in b.columns)):
                if k != now:
                    if now is not None:
                        yield done()
                    now, length = k, np.arange(1, int(_load(folder, f"starts-{k}")[-1]) + 1)  # where the match from each place ends
                place = np.cumsum(np.frombuffer(at, np.uint32), dtype=np.int64)
                length[place] = place + np.frombuffer(n, np.uint8 if len(n) * 4 == len(at) else np.uint32)
        if now is not None:
            yield done()

    return run


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", longest: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: words are those of near-dedup (A-Z lower-cased), told apart by 32-bit hashes.

    Null texts are empty and score 0, as texts without words do; null keys stay null; other columns are
    not read; the empty table gives no rows. Lower scores are nearer to the reference: the texts of all other
    rows. So a text that another row repeats has as few phrases as can be, and repeated rows have
    equal scores (and one phrase). ``longest`` cuts phrases to so many words; None: no limit. In a table without another text each word is a phrase. ``spark.checkpoint.dir`` must
    be a folder that all nodes mount."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = shared_dir(spark)
    if ":" in shared.replace("file:", "", 1):
        raise ValueError(f"words are mapped into memory from a mounted folder; spark.checkpoint.dir is {shared}")
    folder = f"/{shared.removeprefix('file:').lstrip('/')}/reference-{uuid.uuid4().hex}"
    os.makedirs(folder)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    h, h2 = text_hash(text)
    base = docs.select(F.col(f"`{key}`").cast("long").alias("key"), t.alias("text"), F.octet_length(t).cast("long").alias("n"), h.alias("h"), h2.alias("h2"))
    sizes = {r.k: r.n for r in base.mapInArrow(_lay(folder), "k long, n long").collect()}  # a row for each task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filled = {k: n for k, n in sizes.items() if n}
    total = sum(filled.values())
    buckets = max(1, -(-total // BUCKET))
    ends = spark.createDataFrame([(k, b"", b"") for k in filled], "k long, at binary, n binary")  # files without a match are parsed, too
    if not filled:
        return ends.mapInArrow(_parse(folder, longest), OUT)
    hot = hot_grams(folder, filled, buckets)
    pieces = spark.createDataFrame([(k, i, j) for j, (k, i) in enumerate((k, i) for k, n in filled.items() for i in range(0, n, AT_ONCE))], "k long, begin long, j int")
    n_pieces = -(-total // AT_ONCE) + len(filled)
    dealt = pieces.repartitionById(max(1, min(n_pieces, 4 * parts)), F.pmod("j", F.lit(max(1, min(n_pieces, 4 * parts))))).select("k", "begin").mapInArrow(_deal(folder, buckets, hot), "bucket long, depth int, k long, begin long, at binary")
    tasks = max(1, min(buckets, 16 * parts))
    sorted_ = dealt.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket").mapInArrow(_match(folder), "k long, at binary, n binary")
    places = max(1, min(len(filled), 16 * parts))
    return sorted_.union(ends).repartitionById(places, F.pmod("k", F.lit(places)).cast("int")).sortWithinPartitions("k").mapInArrow(_parse(folder, longest), OUT)


def op7(docs: DataFrame) -> DataFrame:
    """Phrases of at most LONGEST words; the query op7_lm_scores is ``lm_scores`` without a limit."""
    return lm_scores(docs, longest=LONGEST)
