"""Arrow text columns as byte arrays; words and their hashes without a loop per document."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this library

#: Rows and bytes that one Arrow batch may hold, so a Python worker's memory doesn't depend on the texts.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes that are hashed at once.
CHUNK = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
RANDOM = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters and whatever is not ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
POWER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster's nodes share; a local one of our own only in local mode, where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        folder = "file://" + tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: its lineage ends here, and any executor can be lost."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with as many underscores after it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``written`` made, when nothing lazy reads them any more."""
    jvm = spark.sparkContext._jvm
    for t in tables:
        for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_hash(text="text"):
    """Two independent 64-bit hashes of a text, null as empty, computed in the JVM."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(t), F.xxhash64(F.lit(0x5EED), t, F.length(t))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each begins (and the last ends); null is empty."""
    a = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    _, at, data = a.buffers()
    offsets = np.frombuffer(at, np.int64)[a.offset : a.offset + len(a) + 1] if at else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the next call."""
    kept = powers.__dict__.setdefault("kept", {})
    if len(kept.get(base, ())) < n:
        p = np.full(max(n, 1), base, np.uint64)
        p[0] = 1
        kept[base] = np.cumprod(p, dtype=np.uint64)
    return kept[base][:n]


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z lower-cased), in order, and the index of each text's first word.

    The bytes are taken in chunks that end outside words, so memory beyond the result stays
    small for texts of any length."""
    hashes, starts, begin = [], [], 0
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    while begin < len(buf):
        end = begin + CHUNK
        while end < len(buf) and WORD[buf[end]]:
            end += 1
        end = min(end, len(buf))
        b = buf[begin:end]
        word, cut = WORD[b], edge[begin : end + 1]
        before, after = np.empty_like(word), np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
        first = np.flatnonzero(word & (~before | cut[:-1]))
        last = np.flatnonzero(word & (~after | cut[1:]))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(RANDOM[LOWER[b]] * powers(POWER, len(b)), out=total[1:])
        hashes.append(mix((total[last + 1] - total[first]) * powers(INVERSE, len(b))[first]))
        starts.append(first + begin)
        begin = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets)


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words with the text of each; a text of fewer words (but one) has one of all its words."""
    n = np.diff(at)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mul = np.array([pow(0xD6E8FEB86659FD93, j + 1, 2**64) for j in range(k)], np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        out += h[j : len(h) - k + 1 + j] * mul[j] if len(out) else np.uint64(0)
    whole = doc[: len(out)] == doc[k - 1 :] if len(out) else np.zeros(0, bool)
    out, of = mix(out[whole]), doc[: len(whole)][whole]
    for i in np.flatnonzero((n > 0) & (n < k)):
        w = h[at[i] : at[i + 1]]
        out, of = np.append(out, mix((w * mul[: len(w)]).sum(dtype=np.uint64)[None] + np.uint64(len(w)))), np.append(of, i)
    return out, of
