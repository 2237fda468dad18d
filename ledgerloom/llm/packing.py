"""Best-fit packing of token pieces into sequences by minimum bin slack.

A bin takes the longest piece left, then the fullest feasible combination of the lengths left, found by a
subset-sum dynamic program whose states are the bits of one integer; the combination is removed. As pieces of
one length are alike, this runs on the histogram of lengths, at most ``capacity`` counts whatever the corpus,
and a combination is taken as many times as its lengths last before the next search. So one plan of a bounded
size serves all documents: no grouping loses fill, and nothing but the histogram reaches the driver.

Pieces then find their places: each gets a rank among those of its length, in parts of a length of bounded size
(a common length is salted over many), and the plan maps (length, rank) to a sequence and an offset.

``pack_in_order`` keeps the order in which documents come: pieces of one length are ranked by it, and sequences are
numbered by the first of their pieces in it. Which lengths share a sequence is the plan's either way.

Cases: null text is empty and has only the end id; texts of any length are packed whole; repeated rows are packed
each, and those of one id spread like any others; a null id is carried along; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import in_rows, salted, written
from ledgerloom.llm.tokenizer import chunks

SLICE_ROWS = 500
"""Texts of an Arrow batch that are Python strings at once."""
PART_ROWS = 1024
"""Rows of one length that are ranked together, on average."""
PLACE_BITS = 16
"""Documents in order are ranked together by so many: 65,536 places of a file at most."""


def tokenized(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text: str = "text", place: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document's pieces, and its long column ``place`` if named; only the first may be shorter. ``ids`` are little-endian, of the vocabulary's ``id_width``."""
    extra = [] if place is None else [place]

    def cut(batches):
        known = chunks(path)
        end, size = np.array([end_id], dtype=known.width).tobytes(), known.width.itemsize
        kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), *[(c, pa.int64()) for c in extra]]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

        for batch in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, max(1, b.num_rows), SLICE_ROWS)):
            rows, held = [], 0
            for d, t, *more in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = known.raw(t) + end
                n = len(raw) // size
                first = (n - 1) % capacity + 1
                for piece, at in enumerate([0, *range(first, n, capacity)]):
                    to = first if at == 0 else at + capacity
                    rows.append((d, piece, at, to - at, raw[at * size : to * size], *more))
                held += n
                if held > 1_000_000:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    return docs.select(F.col(id_col).cast("long"), text, *extra).mapInArrow(cut, ", ".join(["doc_id long, piece int, start long, length long, ids binary", *[f"{c} long" for c in extra]]))


def fullest(room: int, left: dict[int, int]) -> list[tuple[int, int]]:
    """(length, copies) of a combination of the lengths left that fills most of ``room``; larger lengths are preferred."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        copies, k = min(left[length], room // length), 1
        while copies > 0:
            k = min(k, copies)
            more = reach | reach << k * length & mask
            if more != reach:
                steps.append((reach, length, k))
                reach = more
            copies -= k
            k *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not before >> at & 1:
            at -= k * length
            taken[length] = taken.get(length, 0) + k
    return sorted(taken.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, copies)]) of each combination in the order found; together they use up the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    made = []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        taken = dict(fullest(capacity - seed, {n: c for n, c in rest.items() if c > 0}))
        taken[seed] = taken.get(seed, 0) + 1
        times = min(left[n] // k for n, k in taken.items())
        for n, k in taken.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
        made.append((times, sorted(taken.items(), reverse=True)))
    return made


def lookup(combinations: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """The plan as arrays sorted by (length, first rank): length, first rank, copies in a bin, first sequence, first offset."""
    rows, used, sequence = [], {}, 0
    for times, taken in combinations:
        offset = 0
        for n, k in taken:
            rows.append((n, used.get(n, 0), k, sequence, offset))
            used[n] = used.get(n, 0) + times * k
            offset += n * k
        sequence += times
    return tuple(np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T.copy())


def placed(length: np.ndarray, rank: np.ndarray, table: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of the pieces of these lengths and ranks."""
    lengths, first, copies, sequence, offset = table
    at = np.searchsorted(lengths << np.int64(44) | first, length << np.int64(44) | rank, side="right") - 1
    own = rank - first[at]
    return sequence[at] + own // copies[at], offset[at] + own % copies[at] * length


def _placed(pieces: DataFrame, capacity: int, part: Callable[[F.Column], F.Column], *order: str) -> DataFrame:
    """``pieces`` with sequence_id and offset; ranks among a length are by part, given its count, and then by ``order``."""
    spark = pieces.sparkSession
    sizes = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("__n"))
    histogram = {r["length"]: r["__n"] for r in sizes.collect()}  # a row for each length, ``capacity`` at most
    if any(n > capacity or n < 1 for n in histogram):
        raise ValueError("a piece is empty or longer than a sequence")
    table = spark.sparkContext.broadcast(lookup(plan(histogram, capacity)))

    counts = spark.createDataFrame(list(histogram.items()), "length long, __n long")
    parted = pieces.join(F.broadcast(counts), "length").withColumn("__part", part(F.col("__n")))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parted.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__k"))
    starts = parts.withColumn("__start", F.coalesce(F.sum("__k").over(before), F.lit(0))).drop("__k")
    own = Window.partitionBy("length", "__part").orderBy(*order)
    ranked = parted.join(starts, ["length", "__part"]).withColumn("__rank", F.col("__start") + F.row_number().over(own) - 1)

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = placed(length.to_numpy(np.int64), rank.to_numpy(np.int64), table.value)
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    at = F.pandas_udf(place, "sequence_id long, offset long")("length", "__rank")
    return ranked.withColumn("__at", at).select(*pieces.columns, "__at.sequence_id", "__at.offset")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any others, written) with sequence_id and offset.

    Rows of one id and piece are told apart by where they are in the written table: they spread over the parts of their
    length, and a task that runs again ranks them the same.
    """
    own = in_rows(pieces, "pieces")
    found = _placed(own, capacity, lambda n: salted(n, PART_ROWS, "doc_id", "piece", "__row"), "doc_id", "piece", "__row", "__file")
    return found.drop("__row", "__file")


def pack_in_order(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (place, piece, length and any others, written) with sequence_id and offset, in the order of their places."""
    found = written(_placed(pieces, capacity, lambda n: F.shiftright("place", PLACE_BITS), "place", "piece"), "placed")
    lead = found.groupBy("sequence_id").agg(F.min(F.struct("place", "piece")).alias("__lead")).withColumn("__part", F.shiftright("__lead.place", PLACE_BITS))
    parts = lead.groupBy("__part").agg(F.count(F.lit(1)).alias("__k"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    starts = parts.withColumn("__start", F.coalesce(F.sum("__k").over(before), F.lit(0))).drop("__k")
    own = Window.partitionBy("__part").orderBy("__lead")
    numbered = lead.join(starts, "__part").select("sequence_id", (F.col("__start") + F.row_number().over(own) - 1).alias("__new"))
    return found.join(numbered, "sequence_id").select(*pieces.columns, F.col("__new").alias("sequence_id"), "offset")


def in_place(docs: DataFrame) -> DataFrame:
    """``docs`` with a long column place: by file, in the order of names, and row where they are read from files, else by partition and row."""
    try:
        files = [r[0] for r in docs.select("_metadata.file_path").distinct().collect()]  # a row a written file
    except AnalysisException:
        return docs.withColumn("place", F.monotonically_increasing_id())
    if not files:
        return docs.withColumn("place", F.lit(0).cast("long"))
    numbers = docs.sparkSession.createDataFrame([(f, k) for k, f in enumerate(sorted(files))], "__file string, __no long")
    at = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return at.join(F.broadcast(numbers), "__file").withColumn("place", F.shiftleft("__no", 40) + F.col("__row")).drop("__file", "__no", "__row")


def id_width(path: str) -> int:
    """Bytes of an id in ``ids``: 2, or 4 for a vocabulary of more than 65,536."""
    return chunks(path).width.itemsize


def ids_crc32(ids: F.Column, width: int) -> F.Column:
    """The CRC-32 of ids as little-endian unsigned 32-bit integers."""

    def crc(raw: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(r, dtype=f"<u{width}").astype("<u4").tobytes()) for r in raw], dtype="int64")

    return F.pandas_udf(crc, "long")(ids)


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every document's pieces, packed."""
    pieces = written(tokenized(docs, path, end_id, capacity, id_col, text), "pieces", "zstd")
    return pack(pieces, capacity)
