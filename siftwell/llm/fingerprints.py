"""Document fingerprints: quartile bucket digests of hashed byte triplets.

In each window of five bytes, six triplets are hashed to buckets. The digest has the log of
the length and, for each bucket, the quartile its count lies in (two bits). The difference of
two digests is the sum of the quartiles' distances, as a share of the largest possible sum, and
a bounded share for the lengths; likeness is 1 minus that.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.textbatch import RANDOM, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1024
PIECE = 1 << 19
#: Rows that are sampled for each block's bounds (three numbers each, on the driver).
SAMPLED = 100
#: Offsets in the window of each triplet.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
TABLES = (RANDOM[None, :] * np.array([[0x9E3779B97F4A7C15], [0xC2B2AE3D27D4EB4F], [0x165667B19E3779F9]], np.uint64) >> np.uint64(40)).astype(np.uint32)


def digest(data: bytes) -> np.ndarray:
    """[log length, quartiles 0..3 of BUCKETS buckets]; all zeros below three bytes but the length."""
    b = np.frombuffer(data, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for begin in range(0, max(1, len(b) - 2), PIECE):
        p = b[begin : begin + PIECE + 4]
        x, y, z = TABLES[0][p], TABLES[1][p], TABLES[2][p]
        for k, (i, j, m) in enumerate(TRIPLETS):
            n = min(PIECE, len(p) - m)
            if n > 0:
                h = x[i : i + n] + y[j : j + n] + z[m : m + n]
                h *= np.uint32(0x9E3779B1 + 2 * k)
                counts += np.bincount(h >> np.uint32(22), minlength=BUCKETS)
    q = np.partition(counts, [BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4])[[BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]]
    body = (counts[:, None] > q[None, :]).sum(1)
    return np.concatenate([[min(255, int(8 * math.log2(len(b) + 1)))], body]).astype(np.uint8)


def encode(d: np.ndarray) -> str:
    """Two hex digits of length, then a hex digit for two buckets."""
    body = d[1::2] << 2 | d[2::2]
    return f"{d[0]:02x}" + DIGITS[body].tobytes().decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 minus the bounded difference, in 0..1; 1 for equal digests."""
    body = np.abs(a[1:].astype(np.int16) - b[1:]).sum() / (3 * BUCKETS)
    head = min(1.0, abs(int(a[0]) - int(b[0])) / 64)
    return float(max(0.0, 1 - (0.95 * min(1.0, 2 * body) + 0.05 * head)))


def edit_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """Rows (block, own, key, text), a partition for each block, sorted so that each row's successor in descending key follows it.

    Null keys come last; ties go by a hash of the text, descending. Blocks end at rows that exist, taken from
    a random sample of SAMPLED rows a block so that blocks have as many bytes; rows of one key are split
    where their texts differ. The row at a block's lower bound goes to the block as well, as the last
    row's successor (own = 1), and the greatest row to the lowest block."""
    spark = docs.sparkSession
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = -(2**63) + 1
    k, t = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(low)), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.struct(k.alias("k"), F.xxhash64(t).alias("h")).alias("x"), t.alias("text"))
    all_ = rows.agg(F.count("*").alias("n"), F.max("x").alias("hi")).first()
    if not all_.n:
        return rows.select(F.lit(0).alias("block"), F.lit(0).alias("own"), "key", "text")
    some = rows.where(F.rand(7) < SAMPLED * n / all_.n).select("x.k", "x.h", F.octet_length("text").alias("size")).collect()
    bounds, mass, total = [], 0, sum(r.size + 100 for r in some)
    for r in sorted(some):
        mass += r.size + 100
        if mass >= total * (len(bounds) + 1) / n and (r.k, r.h) < tuple(all_.hi) and (not bounds or bounds[-1] < (r.k, r.h)):
            bounds.append((r.k, r.h))
    kind, w = "array<struct<k:bigint,h:bigint>>", math.isqrt(len(bounds)) + 1
    array = lambda xs: F.array(*(F.struct(F.lit(a).cast("long").alias("k"), F.lit(b).cast("long").alias("h")) for a, b in xs)).cast(kind)
    fine, coarse, x = array(bounds), array(bounds[::w]), F.col("x")
    below = lambda a: F.size(F.filter(a, lambda b: b < x))
    rows = rows.select("*", below(coarse).alias("c"))  # the number of bounds below a row, in two steps of their square root
    rows = rows.select("key", "x", "text", F.when(F.col("c") == 0, F.lit(0)).otherwise((F.col("c") - 1) * w + below(F.slice(fine, F.greatest(F.col("c") - 1, F.lit(0)) * w + 1, w))).alias("block"))
    to = lambda block, own: F.array(F.struct(block.cast("int").alias("block"), F.lit(own).alias("own")))
    none = F.array().cast("array<struct<block:int,own:int>>")
    hi = F.struct(F.lit(all_.hi.k).cast("long").alias("k"), F.lit(all_.hi.h).cast("long").alias("h"))
    next_ = F.when(F.coalesce(F.get(fine, F.col("block")) == x, F.lit(False)), to(F.col("block") + 1, 1)).otherwise(none)
    wrap = F.when(x == hi, to(F.lit(0), 1)).otherwise(none)
    dealt = rows.select("key", "x", "text", F.explode_outer(F.concat(to(F.col("block"), 0), next_, wrap)).alias("to")).select("to.block", "to.own", "key", "x", "text")
    return dealt.repartitionById(len(bounds) + 1, "block").sortWithinPartitions("block", "own", F.desc("x")).select("block", "own", "key", "text")


def op1(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness, by the contract.

    Null texts are empty. Null ids stay null and come last; rows of one id follow one another by a hash
    of their texts, and repeated rows each have a row. Other columns are not read; the empty table gives no
    rows; texts of any length are digested piece by piece."""
    import hashlib

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None  # the row whose successor is still to come
        for b in batches:
            out = []
            for block, own, key, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held is None and own:
                    continue
                d = digest(text.encode())
                if held is not None and held[0] == block:
                    k, t, e = held[1:]
                    cut = len(t) // 3
                    edited = (t[: len(t) - cut] + text[:cut]).encode()
                    x = digest(edited)
                    out.append((k, len(t), hashlib.sha256(edited).hexdigest(), encode(e), encode(x), likeness(e, x), likeness(e, d)))
                held = None if own else (block, key, text, d)
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names)

    return edit_pairs(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
