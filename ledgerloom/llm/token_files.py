"""Token ids in binary files: frequency-ranked ids, byte-aligned, with separate control bytes.

A file holds documents in ascending id order, in segments. A segment ranks the ids it holds by frequency and
writes each id as its rank in 1 to 4 little-endian bytes; four 2-bit lengths share a control byte, and control
bytes stand apart from data bytes. Ranks are local to a segment, so a file needs no pass over the corpus before
it, can be decoded alone, and comes out the same when a lost task runs again.

    file    := segment*
    segment := "TKF1" header[6 x u64: documents, tokens, ranks, control bytes, data bytes, u8 null-id flag bytes]
               doc ids (i64 each) lengths (u64 each) null flags (u8 each) id of each rank (u32 each) control data

Order: documents are range-dealt by quantiles of their id, so the sort that writes a file sees one range only.
Documents that share an id may be dealt to several neighbouring ranges, by the hash of their text.

Cases: null text is empty and has only the end id; null ids come first; ties of an id are in a reproducible order
of their own; texts of any length are whole; an empty table writes nothing and reads as an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import ceil_div, filesystem, slots
from ledgerloom.llm.tokenizer import chunks

MAGIC = b"TKF1"
HEADER = struct.Struct("<6Q")
SEGMENT_TOKENS = 4_000_000
FILE_BYTES = 128 << 20
"""Bytes of text a file is meant to hold; more text makes more files, never larger ones."""

#: For each control byte: the four lengths, and where each of the four values starts.
_LENGTHS = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8) & 3) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(4 * ceil_div(len(v), 4), dtype=np.uint8)
    code[: len(v)] = n - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    taken = np.arange(4, dtype=np.uint8)[None, :] < n[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[taken].tobytes()


def decode_values(control: bytes | np.ndarray, data: bytes | np.ndarray, count: int) -> np.ndarray:
    """The values again: lengths come from a table of the 256 control bytes, bytes by one gather each."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:count]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts, held = ends - lengths, np.frombuffer(data, dtype=np.uint8)
    out = held[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        out[longer] |= held[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def segment(doc_ids: list, parts: list[np.ndarray]) -> bytes:
    """One segment's bytes."""
    lengths = np.array([len(p) for p in parts], dtype="<u8")
    ids = np.concatenate(parts).astype(np.uint32, copy=False) if parts else np.zeros(0, np.uint32)
    top = int(ids.max()) + 1 if len(ids) else 0
    if top <= 1 << 22:
        counts = np.bincount(ids, minlength=top)
        kinds = np.flatnonzero(counts)
        kinds = kinds[np.argsort(-counts[kinds], kind="stable")]
        rank = np.zeros(max(top, 1), dtype=np.uint32)
        rank[kinds] = np.arange(len(kinds), dtype=np.uint32)
        ranks = rank[ids]
    else:
        kinds, where, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(kinds), dtype=np.uint32)
        place[order] = np.arange(len(kinds), dtype=np.uint32)
        kinds, ranks = kinds[order], place[where]
    control, data = encode_values(ranks)
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    named = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = HEADER.pack(len(parts), len(ids), len(kinds), len(control), len(data), len(nulls))
    return b"".join([MAGIC, head, named.tobytes(), lengths.tobytes(), nulls.tobytes(), kinds.astype("<u4").tobytes(), control, data])


def segments(stream):
    """(doc ids, lengths, ids) of each segment of an open file."""
    while head := stream.read(4 + HEADER.size):
        if head[:4] != MAGIC or len(head) < 4 + HEADER.size:
            raise ValueError("not a segment of token ids")
        docs, tokens, kinds, control, data, nulls = HEADER.unpack(head[4:])
        named = np.frombuffer(stream.read(8 * docs), dtype="<i8")
        lengths = np.frombuffer(stream.read(8 * docs), dtype="<u8").astype(np.int64)
        missing = np.frombuffer(stream.read(nulls), dtype=np.uint8).astype(bool)
        kind = np.frombuffer(stream.read(4 * kinds), dtype="<u4")
        ranks = decode_values(stream.read(control), stream.read(data), tokens)
        yield [None if m else int(d) for d, m in zip(named, missing, strict=True)], lengths, kind[ranks] if tokens else ranks


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Write every document's ids, each with ``end_id`` after it, below ``folder``; return (file, first position, tokens) in order.

    What comes to the driver is one row a file. A file is written under a name of its task's attempt and
    moved into place when whole, so that a task that runs twice leaves one file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    n = max(slots(spark), ceil_div(total, FILE_BYTES))
    cuts = (rows.agg(F.percentile_approx("d", [i / n for i in range(1, n)], 10 * n)).first()[0] or []) if n > 1 else []
    cuts = [int(c) for c in cuts]
    ends = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")

    # The number of values below d, and of values equal to it, are the range it falls into and the ranges it may be dealt to.
    low = F.size(F.filter(ends, lambda c: c < F.col("d")))
    same = F.size(F.filter(ends, lambda c: c == F.col("d")))
    part = F.coalesce(F.when(F.col("d").isNull(), F.lit(0)).otherwise(low + F.pmod(F.xxhash64("t"), (same + 1).cast("long"))), F.lit(0)).cast("int")
    ranged = rows.withColumn("p", part).repartitionById(n, F.col("p")).sortWithinPartitions("p", F.col("d").asc_nulls_first(), F.xxhash64("t"), "t")

    def write(batches):
        made, name, out, ids, parts, held, size = None, "", None, [], [], 0, 0
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        known = chunks(path)
        wide = end_id >> 8 * known.width.itemsize == 0
        end = np.array([end_id], dtype=known.width if wide else np.uint32)

        def flush():
            nonlocal ids, parts, held
            if parts:
                out.write(segment(ids, parts))
            ids, parts, held = [], [], 0

        def close():
            flush()
            out.close()
            fs.move(name, f"{root}/ids-{made:08d}.tkf")
            return made, f"ids-{made:08d}.tkf", size

        done = []
        for batch in batches:
            for p, d, t in zip(*(batch.column(c).to_pylist() for c in ("p", "d", "t")), strict=True):
                if p != made:
                    if out is not None:
                        done.append(close())
                    made, size = p, 0
                    name = f"{root}/.{made:08d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(name)
                got = known.ids(t)
                got = np.append(got if wide else got.astype(np.uint32), end)
                ids.append(d)
                parts.append(got)
                held += len(got)
                size += len(got)
                if held >= SEGMENT_TOKENS:
                    flush()
        if out is not None:
            done.append(close())
        yield pa.RecordBatch.from_pylist([dict(zip(("p", "file", "n"), x, strict=True)) for x in done], pa.schema([("p", pa.int64()), ("file", pa.string()), ("n", pa.int64())]))

    summary = sorted((r["p"], r["file"], r["n"]) for r in ranged.mapInArrow(write, "p long, file string, n long").collect())
    listed, at = [], 0
    for _, file, size in summary:
        listed.append((f"{folder}/{file}", at, size))
        at += size
    return listed


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]], with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids as little-endian u32]) of every document in the files, one task a file."""
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = filesystem(file)
                with fs.open_input_stream(at) as stream:
                    for docs, lengths, ids in segments(stream):
                        raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                        ends = np.cumsum(lengths)
                        spans = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                        out = [pa.array(docs, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(s) for s in spans], pa.int64())]
                        out += [pa.array([bytes(s) for s in spans], pa.binary())] * with_ids
                        yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])
                        start += int(ends[-1]) if len(ends) else 0

    listed = spark.createDataFrame([(f, s) for f, s, _ in files], "file string, start long")
    return listed.repartition(max(1, min(len(files), 4 * slots(spark)))).mapInArrow(read, kind)
