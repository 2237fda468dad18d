"""Token counts by a map-side two-tier lookup; no pre-token is shuffled.

Tier one is a table of the corpus's frequent pre-tokens and their token counts, packed compactly and broadcast;
its size is bounded by ``table_size`` entries of at most ``MAX_KEY`` bytes. Tier two is each worker's cache, in
which misses are encoded by the tokenizer library. Both give the library's counts, so the table only saves time.

Which pre-tokens are frequent is counted over all documents: each task keeps its heaviest (a lossy count within a
bound), and only these summaries are merged.

Cases: null text counts as empty, with 0 bytes and 0 tokens; texts of any length are counted whole; repeated rows
give repeated results; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import time
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import written
from ledgerloom.llm.tokenizer import CACHE_WORDS, Chunks, Generations, chunks

MAX_KEY = 48
TASK_KEYS = 300_000
"""Pre-tokens a task counts at once; the rarer half goes when there are more."""


class Lengths(Generations):
    """pre-token -> number of tokens, over the broadcast table of the frequent ones."""

    def __init__(self, path: str, table: tuple[bytes, bytes]):
        super().__init__(CACHE_WORDS)
        self.chunks: Chunks = chunks(path)
        self.update(zip(*unpacked(table), strict=True))
        self.size += len(self)
        self.frequent = dict(self)

    def forget(self) -> None:
        super().forget()
        self.update(self.frequent)

    def __missing__(self, chunk: str) -> int:
        n = self.old.get(chunk)
        if n is None:
            n = len(self.chunks.encoded(chunk)) // self.chunks.width.itemsize
        if len(chunk) <= MAX_KEY:
            if len(self) >= self.size:
                self.turn()
                self.update(self.frequent)
            self[chunk] = n
        return n


_lengths: dict[tuple[str, int], tuple[Lengths, object]] = {}


def lengths(path: str, table: tuple[bytes, bytes]) -> Lengths:
    """This worker's lookup; it lasts over tasks, as long as the broadcast table is the same."""
    key = path, id(table)
    if key not in _lengths:
        _lengths.clear()
        _lengths[key] = Lengths(path, table), table
    return _lengths[key][0]


def packed(words: list[str], counts: list[int]) -> tuple[bytes, bytes]:
    """The table as NUL-joined keys and 16-bit counts."""
    return "\0".join(words).encode(), np.array(counts, dtype="<u2").tobytes()


def unpacked(table: tuple[bytes, bytes]) -> tuple[list[str], list[int]]:
    counts = np.frombuffer(table[1], dtype="<u2").tolist()
    return (table[0].decode().split("\0") if counts else []), counts


def frequent_pretokens(docs: DataFrame, path: str, text: str = "text", table_size: int = 32_768) -> list[str]:
    """The ``table_size`` most frequent pre-tokens of all documents, by merged task summaries of twice that at most."""

    def summaries(batches):
        split, seen = chunks(path).split, Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(split(t))
                    if len(seen) > TASK_KEYS:
                        seen = Counter(dict(heapq.nlargest(TASK_KEYS // 2, seen.items(), key=lambda x: x[1])))
        best = [(w, n) for w, n in heapq.nlargest(2 * table_size, seen.items(), key=lambda x: (x[1], x[0])) if n > 1 and len(w.encode()) <= MAX_KEY and "\0" not in w]
        yield pa.record_batch({"word": pa.array([w for w, _ in best], pa.string()), "n": pa.array([n for _, n in best], pa.int64())})

    found = written(docs.select(F.col(text).alias("t")).mapInArrow(summaries, "word string, n long"), "pretokens")
    merged = found.groupBy("word").agg(F.sum("n").alias("n"))
    total = merged.agg(F.sum("n")).first()[0] or 0
    # At most 4 * table_size words can have that share of the whole, so what tasks send to the driver is bounded.
    often = merged.where(F.col("n") * (4 * table_size) >= F.lit(total)).collect()
    return [r["word"] for r in sorted(often, key=lambda r: (-r["n"], r["word"]))[:table_size]]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = 2048, table_size: int = 32_768) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit) for every document, by the tokenizer file at ``path``."""
    spark = docs.sparkSession
    words = frequent_pretokens(docs, path, text, table_size)
    known = chunks(path)
    table = spark.sparkContext.broadcast(packed(words, [len(known.encoded(w)) // known.width.itemsize for w in words]))

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        own = lengths(path, table.value)
        own.used = own.chunks.used = time.monotonic()
        split, get = own.chunks.split, own.__getitem__
        return pd.Series([sum(map(get, split(t))) if t else 0 for t in texts], dtype="int64")

    counted = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(F.col(text)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
