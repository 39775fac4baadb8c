"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Learned filters of WIDTH
bytes slide over each chunk byte by byte, so every byte is in a window; each filter's greatest response in a chunk is kept
(max-pooling), the chunks' maxima are averaged and maximised over the document, and a logistic
layer combines them into one probability. A filter's weights are a table of its response to
each byte at each place, so a response is a sum of lookups.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.textbatch import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH, FILTERS, CHUNK, OVERLAP = 6, 16, 768, 5
#: Labelled rows of each class that are fitted, at most, and the bytes that a fitted text may have; the sample is the rows of smallest hash.
MOST_ROWS, MOST_TEXT = 1200, 1 << 16
EPOCHS, RATE = 6, 0.02


@dataclass
class Model:
    table: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,)
    out_bias: float


def chunks(data: bytes) -> list[np.ndarray]:
    """Overlapping chunks over all bytes; only a text shorter than a filter is filled with zero bytes."""
    b = np.frombuffer(data, np.uint8)
    found = []
    for i in range(0, max(1, len(b) - OVERLAP), CHUNK - OVERLAP):
        found.append(b[i : i + CHUNK])
    return found if len(b) >= WIDTH else [np.concatenate([b, np.zeros(WIDTH - len(b), np.uint8)])]


def responses(c: np.ndarray, m: Model) -> np.ndarray:
    n = len(c) - WIDTH + 1
    r = np.repeat(m.bias[None, :], n, 0)
    for o in range(WIDTH):
        r += m.table[o].take(c[o : o + n], axis=0)
    return r


def features(data: bytes, m: Model) -> np.ndarray:
    """Mean and maximum over chunks of each filter's rectified maximum. Memory: one chunk."""
    total, top, k = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32), 0
    for c in chunks(data):
        x = np.maximum(responses(c, m).max(0), 0)
        total += x
        np.maximum(top, x, out=top)
        k += 1
    return np.concatenate([total / k, top])


def probability(data: bytes, m: Model) -> float:
    return float(1 / (1 + np.exp(-np.clip(features(data, m) @ m.out + m.out_bias, -40, 40))))


def fit(texts: list[bytes], labels: list[int], share: float, seed: int = 7) -> Model:
    """Adam on single documents in random order; ``share`` is class 1's share among all labelled rows, which the last bias is set to."""
    rng = np.random.Generator(np.random.PCG64(seed))
    m = Model(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), 0.0)
    if len(set(labels)) < 2:
        m.out[:] = 0
        m.out_bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return m
    g2 = [np.zeros_like(m.table), np.zeros_like(m.bias), np.zeros_like(m.out), 0.0]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(texts)):
            cs = chunks(texts[i])
            best, at = np.empty((len(cs), FILTERS), np.float32), np.empty((len(cs), FILTERS), np.int64)
            for j, c in enumerate(cs):
                r = responses(c, m)
                at[j] = r.argmax(0)
                best[j] = r[at[j], np.arange(FILTERS)]
            x = np.maximum(best, 0)
            top = x.argmax(0)
            f = np.concatenate([x.mean(0), x[top, np.arange(FILTERS)]])
            err = 1 / (1 + np.exp(-np.clip(f @ m.out + m.out_bias, -40, 40))) - labels[i]
            back = np.repeat(err * m.out[None, :FILTERS] / len(cs), len(cs), 0)
            back[top, np.arange(FILTERS)] += err * m.out[FILTERS:]
            back *= best > 0
            step = lambda g, s: rate * g / (np.sqrt(s) + 1e-2)
            g2[2] = 0.99 * g2[2] + 0.01 * (err * f) ** 2
            m.out -= step(err * f, g2[2])
            g2[3] = 0.99 * g2[3] + 0.01 * err**2
            m.out_bias -= float(step(err, g2[3]))
            gb = back.sum(0)
            g2[1] = 0.99 * g2[1] + 0.01 * gb**2
            m.bias -= step(gb, g2[1])
            js, ks = np.nonzero(back)
            for j, k in zip(js, ks):
                p = at[j, k]
                w = cs[j][p : p + WIDTH]
                o = np.arange(WIDTH)
                m.table[o, w, k] -= rate * 0.5 * back[j, k]
    m.out_bias += float(np.log((share + 1e-3) / (1 - share + 1e-3)))  # the sample had as many of each class
    return m


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, most_text: int = MOST_TEXT) -> Model:
    """Fit on at most ``most`` labelled rows of each class whose crc32(doc_id) mod 3 isn't 1 and whose text has at most ``most_text`` bytes.

    Those texts come to the driver (2 * most * most_text bytes at most). Null labels and ids, labels
    but 0 and 1, and labels without a document are left out; an id with several labels or documents
    gives a row for each, within the bound. With one class only, the model gives that class's share;
    without any label it gives 0.5. Other columns are not read."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = {r.quality: r.n for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for q in (0, 1)]
    texts = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_text)
    sample = texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text", "quality").limit(2 * most).collect()
    share = n.get(1, 0) / sum(n.values()) if n else 0.5
    ones = [r for r in sample if r.quality == 1]
    zeros = [r for r in sample if r.quality == 0]
    rows = zeros + ones if not (ones and zeros) else [r for x in (zeros, ones) for r in (x * -(-max(len(ones), len(zeros)) // len(x)))[: max(len(ones), len(zeros))]]
    return fit([(r.text or "").encode() for r in rows], [r.quality for r in rows], share)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the probability of label 1, from the whole text's bytes alone.

    Null is scored as the empty text; equal texts have equal scores, and rows are independent.
    ``out`` replaces a column of that name, all others stay; the empty table gives no rows."""
    spark = docs.sparkSession
    small_batches(spark)
    # plain arrays (WIDTH * 256 * FILTERS numbers): workers have no copy of this library
    sent = spark.sparkContext.broadcast((model.table, model.bias, model.out, model.out_bias))

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model(*sent.value)
        for a in batches:
            yield pa.array([probability((t or "").encode(), m) for t in a.to_pylist()], pa.float64())

    return docs.withColumn(out, scored(F.col(f"`{text}`")))


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: one for each row of ``docs``, repeated rows and null ids too (never held out)."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
