"""Variable-capacity best-fit packing of documents into training sequences.

Documents become pieces of at most the largest permitted length; pieces are dealt to shards
of bounded size by hash, and each shard is packed by best fit, longest piece first. A piece
goes to the open bin that it leaves least room in; if none has room, a bin is opened. Which
size to open is decided for each bin, over all permitted lengths: the pieces still to come
(all not larger) are tried in it, largest first, and the length whose cost for each token
so filled is least is opened. The shard is also packed with one opening length throughout,
for each permitted length; every bin is downsized to the least permitted length that holds
its contents, and the cheapest packing is kept. Only (id, piece, length) is shuffled, never texts.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence besides its length.
OVERHEAD = 16
SHARD = 20_000
OUT = "doc_id long, piece int, start long, n_tokens long, shard int, bin int, capacity int, at int"


class Remaining:
    """How many pieces of each size are still to come."""

    def __init__(self, sizes: list[int], most: int):
        self.count = Counter(sizes)
        self.down = list(range(most + 1))  # the largest size up to each that may still come

    def largest(self, room: int) -> int:
        """The largest size still to come that fits; 0 if there is none."""
        down, at = self.down, room
        while at and not (down[at] == at and self.count[at]):
            down[at] = down[at - 1] if down[at] == at else down[down[at]]
            at = down[at]
        return at

    def filled(self, first: int, capacity: int) -> int:
        """Tokens of a bin that holds ``first`` and then, again and again, the largest that fits."""
        used, taken = first, Counter()
        while s := self.largest(capacity - used):
            n = min(self.count[s] - taken[s], (capacity - used) // s)
            if n <= 0:  # all of this size are in this bin already: look below it
                while s and self.count[s] <= taken[s]:
                    s = self.largest(s - 1)
                if not s:
                    break
                n = min(self.count[s] - taken[s], (capacity - used) // s)
            taken[s] += n
            used += n * s
        return used


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each size, and the final capacity of each bin. Sizes must fit the largest capacity."""
    caps = sorted(capacities)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    best = None
    for policy in [None, *caps]:
        room: list[tuple[int, int]] = []
        used: list[int] = []
        place: list[tuple[int, int]] = [(0, 0)] * len(sizes)
        left = Remaining(sizes, caps[-1])
        for i in order:
            s = sizes[i]
            left.count[s] -= 1
            at = bisect_left(room, (s, -1))
            if at < len(room):
                free, b = room.pop(at)
            else:
                fits = [c for c in caps if c >= s]
                free = min(fits, key=lambda c: ((c + overhead) / left.filled(s, c), c)) if policy is None else min((c for c in fits if c >= policy), default=fits[-1])
                b = len(used)
                used.append(0)
            place[i] = b, used[b]
            used[b] += s
            if free > s:
                insort(room, (free - s, b))
        final = [caps[bisect_left(caps, u)] for u in used]
        cost = sum(final) + overhead * len(final)
        if best is None or cost < best[0]:
            best = cost, place, final
    return best[1], best[2]


def pack_documents(docs: DataFrame, key: str = "doc_id", length: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """One row for each piece: where it starts in its document, its bin (unique in its shard), the bin's capacity, its place there.

    Null, zero and negative lengths give no piece. Lengths above the largest capacity are cut into
    pieces of it and a rest. Null and repeated keys are packed as rows of their own. Ties are broken
    by key, then piece. Input columns besides the two are not read. The empty table gives no rows."""
    most = max(capacities)
    n = F.col(f"`{length}`").cast("long")
    items = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), n.alias("_n")).where(F.col("_n") > 0)
    pieces = items.select("doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / most))).alias("_p"))
    pieces = pieces.select("doc_id", F.col("_p").cast("int").alias("piece"), (F.col("_p") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("_n") - F.col("_p") * most).alias("n_tokens"))
    shards = max(1, -(-docs.count() // shard))
    # a row's place is part of the hash, so that rows of one key (or none) are spread as all others
    salted = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "n_tokens"], na_position="last", kind="stable")
        place, final = pack(pdf.n_tokens.tolist(), capacities, overhead)
        pdf["bin"], pdf["at"] = [b for b, _ in place], [a for _, a in place]
        pdf["capacity"] = [final[b] for b, _ in place]
        return pdf[["doc_id", "piece", "start", "n_tokens", "shard", "bin", "capacity", "at"]].astype({"doc_id": "Int64"})

    return salted.groupBy("shard").applyInPandas(run, OUT)


def op2(docs: DataFrame) -> DataFrame:
    """All documents, measured in words between white space."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"\S+"))
    return pack_documents(docs.select("doc_id", words.alias("n_tokens")))
