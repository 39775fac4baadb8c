"""Token counts by byte-pair merging: a heap of adjacent pairs over a linked list of symbols.

The lowest-rank pair is popped and merged again and again; the count of a word is its
initial symbols minus its merges, and no identifier is ever made. Words recur, so their
counts are kept in a table of bounded size in each Python worker.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.textbatch import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHIFT = 20
#: Words whose counts a worker keeps, in each of two generations.
KEPT = 250_000
#: A text above this many characters is taken word by word, not as a list of words.
LONG = 1 << 20
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"


def load(path: str) -> dict:
    """What counting needs of a byte-level BPE file: merges by pair, symbols by byte, special strings, the pattern of words.

    Read on the driver; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    bpe, pre = model["model"], model["pre_tokenizer"]["pretokenizers"]
    if bpe["type"] != "BPE" or [p["type"] for p in pre] != ["Split", "ByteLevel"] or [n["type"] for n in model["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
        raise ValueError("this vocabulary's steps aren't known here")
    ids = bpe["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
    end = bpe["end_of_word_suffix"]
    pairs = {}
    for rank, (a, b) in enumerate(bpe["merges"]):
        pairs.setdefault(ids[a] << SHIFT | ids[b], rank << SHIFT | ids[a + b])
    return {
        "pairs": pairs,
        "inner": [ids[char[b]] for b in range(256)],
        "last": [ids[char[b] + end] for b in range(256)],
        "special": [t["content"] for t in model["added_tokens"]],
        "words": pre[0]["pattern"]["Regex"].replace(r"\s", SPACE),
    }


def count_word(word: str, pairs: dict[int, int], inner: list[int], last: list[int]) -> int:
    """Tokens of one word."""
    data = word.encode()
    n = len(data)
    symbols: list[int] = [inner[b] for b in data]
    symbols[-1] = last[data[-1]]
    if n == 1:
        return 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if (m := pairs.get(symbols[i] << SHIFT | symbols[i + 1])) is not None:
            heap.append((m, i, symbols[i + 1]))
    heapq.heapify(heap)
    mask, left = (1 << SHIFT) - 1, n
    alive = symbols.copy()
    while heap:
        m, i, right = heapq.heappop(heap)
        j = after[i]
        if alive[i] < 0 or j >= n or alive[j] != right or pairs.get(alive[i] << SHIFT | right) != m:
            continue  # one of the two has been merged since
        alive[i], alive[j] = m & mask, -1
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (p := pairs.get(alive[i] << SHIFT | alive[k])) is not None:
                heapq.heappush(heap, (p, i, alive[k]))
        if (h := before[i]) >= 0 and (p := pairs.get(alive[h] << SHIFT | alive[i])) is not None:
            heapq.heappush(heap, (p, h, alive[i]))
    return left


def counter(model: dict):
    """A function from a text to its number of tokens."""
    import unicodedata

    import regex

    words = regex.compile(model["words"])
    special = re.compile("|".join(map(re.escape, sorted(model["special"], key=len, reverse=True)))) if model["special"] else None
    pairs, inner, last = model["pairs"], model["inner"], model["last"]

    class Counts(dict):
        older: dict = {}

        def __missing__(self, word: str) -> int:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            n = self.older.get(word)
            if n is None:
                n = count_word(word, pairs, inner, last)
            if len(word) < 100:
                self[word] = n
            return n

    count = Counts().__getitem__

    def part(text: str) -> int:
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return sum(map(count, words.findall(low) if len(low) < LONG else (m.group() for m in words.finditer(low))))

    def whole(text: str) -> int:
        if special is None or "<|" not in text and not special.search(text):
            return part(text)
        return sum(map(part, special.split(text))) + sum(1 for _ in special.finditer(text))

    return whole


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add ``out``, the tokens of each whole text by the vocabulary file ``path`` (special strings count as one).

    Null and empty texts have 0. ``out`` replaces a column of that name; all others stay. Rows
    are independent: ties, repeated rows and empty tables need nothing, and nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(load(path))  # bounded by the vocabulary

    @F.arrow_udf("bigint")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = sys.modules.setdefault("_siftwell_kept", types.ModuleType("_siftwell_kept")).__dict__  # lives as long as the worker
        if path not in kept:
            kept[path] = counter(model.value)
        count = kept[path]
        for a in batches:
            yield pa.array([count(t) if t else 0 for t in a.to_pylist()], pa.int64())

    return docs.withColumn(out, n_tokens(F.col(f"`{text}`")))


def op9(docs: DataFrame, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of each document, and whether the tokens exceed ``limit``."""
    import public_tokenizers

    t = F.coalesce(F.col("text"), F.lit(""))
    counted = count_tokens(docs.select("doc_id", t.alias("text"), F.octet_length(t).cast("long").alias("n_bytes")), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
