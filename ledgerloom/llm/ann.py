"""Approximate nearest neighbours by inner product, over randomly rotated one-bit codes.

Index. A vector's residual from the centroid (the mean of all vectors) is rotated at random and kept as the signs of
its components, packed to bits, with scalars: its length, the inner product of the code with the residual's
direction, and the inner product of the centroid with itself being the query's business. The rotation comes from
a seed and the dimension, so it is never shipped. Short vectors are padded with zeros before it, so that a code has
``CODE_BITS`` bits at least: the more bits, the smaller the error of an estimate.

Search. Queries and indexed rows meet in blocks of bounded size on either side. In a block the code and scalars
give each pair an estimate and an error bound that holds with high probability (``epsilon``). The exact
products of the best estimates set a threshold, and every pair whose upper bound reaches it is reranked exactly; no
number of candidates is capped. A block yields the nearest of each query, and these are merged by query.

Exact products are sums over components, in order, in double precision.

Cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do null ids;
only vectors of equal dimension are compared; rows that share a query's id are not its neighbours, by decision, as a
row is told by its id; query rows of one id have one list of k between them; other repeated rows are each a neighbour; ties go to the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import ceil_div, written

EPSILON = 3.0
"""Standard deviations of the estimate's error that the bound allows for."""
CODE_BITS = 256
BLOCK_ROWS = 16384
BLOCK_QUERIES = 2048
FIRST = 4
"""Times k best estimates whose exact products set the threshold."""


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


_rotations: dict[tuple[int, int], np.ndarray] = {}


def code_bits(dim: int) -> int:
    """Bits of the codes of vectors of this dimension."""
    return max(dim, CODE_BITS)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """The vectors, padded to the codes' length and rotated."""
    dim, bits = x.shape[1], code_bits(x.shape[1])
    if (dim, seed) not in _rotations:
        _rotations[dim, seed] = np.ascontiguousarray(rotation(bits, seed)[:dim])
    return x.astype(np.float32) @ _rotations[dim, seed]


def encode(x: np.ndarray, centroid: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths of the residuals, and inner products of the codes with the residuals' directions."""
    residual = x - centroid
    length = np.linalg.norm(residual, axis=1)
    turned = rotated(residual, seed)
    bits = turned > 0
    scale = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(bits, axis=1), length.astype(np.float32), np.where(length > 0, scale / np.where(length > 0, length, 1), 1).astype(np.float32)


def estimates(queries: np.ndarray, bits: np.ndarray, length: np.ndarray, match: np.ndarray, centroid: np.ndarray, seed: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products [queries, rows] and their error bounds."""
    dim = code_bits(queries.shape[1])
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    code = rotated(queries, seed) @ signs.T / np.float32(np.sqrt(dim))
    estimate = (queries @ centroid)[:, None].astype(np.float32) + code * (length / match)
    spread = epsilon * length * np.sqrt(np.maximum(1 - match**2, 0)) / match / np.sqrt(max(dim - 1, 1))
    return estimate, np.linalg.norm(queries, axis=1)[:, None].astype(np.float32) * spread[None, :] + 1e-5


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of paired vectors, summed over the components in order."""
    total = np.zeros(len(rows))
    for k in range(queries.shape[1]):
        total += queries[:, k].astype(np.float64) * rows[:, k].astype(np.float64)
    return total


def nearest(q_ids, queries, ids, rows, bits, length, match, centroid, k: int, seed: int, epsilon: float):
    """(query_id, vec_id, score) of each query's k nearest among the rows, by estimates, bounds and reranking."""
    out = []
    for at in range(0, len(q_ids), 256):
        own, q = q_ids[at : at + 256], queries[at : at + 256]
        estimate, bound = estimates(q, bits, length, match, centroid, seed, epsilon)
        self_pair = own[:, None] == ids[None, :]
        estimate[self_pair] = -np.inf
        first = min(FIRST * k, len(ids))
        best = np.argpartition(-estimate, first - 1, axis=1)[:, :first]
        flat = np.repeat(np.arange(len(own)), first)
        score = exact(q[flat], rows[best.ravel()]).reshape(len(own), first)
        score[np.take_along_axis(self_pair, best, axis=1)] = -np.inf
        least = np.sort(score, axis=1)[:, ::-1][:, min(k, first) - 1]
        query, row = np.nonzero((estimate + bound >= least[:, None]) & ~self_pair)
        again = np.concatenate([exact(q[query[i : i + 65536]], rows[row[i : i + 65536]]) for i in range(0, len(query), 65536)] or [np.zeros(0)])
        order = np.lexsort((ids[row], -again, query))
        query, row, again = query[order], row[order], again[order]
        starts = np.searchsorted(query, np.arange(len(own)))
        kept = np.arange(len(query)) - starts[query] < k
        out.append((own[query[kept]], ids[row[kept]], again[kept]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def centroids(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean of all vectors of each dimension, from a sum a task; rounded, so that the order of sums leaves no trace."""

    def sums(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for pdf_dim, group in batch.to_pandas().groupby("dim"):
                x = np.stack(group["v"].to_numpy())
                own = total.setdefault(pdf_dim, [np.zeros(pdf_dim), 0])
                own[0] += x.sum(axis=0)
                own[1] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([s.tolist() for s, _ in total.values()], pa.list_(pa.float64())), pa.array([n for _, n in total.values()], pa.int64())], ["dim", "s", "n"])

    parts = rows.mapInArrow(sums, "dim int, s array<double>, n long")
    each = parts.select("dim", "n", F.posexplode("s").alias("i", "x")).groupBy("dim", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    found: dict[int, np.ndarray] = {}
    for r in each.collect():  # a number for each component
        found.setdefault(r["dim"], np.zeros(r["dim"]))[r["i"]] = round(r["x"], 4)
    return found


def index(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", seed: int = 11, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, dict[int, np.ndarray], int]:
    """(vec_id, v, dim, block, bits, length, match) of every vector that takes part; the centroids; the number of blocks."""
    rows = usable(df, id_col, vector)
    middle = centroids(rows)
    blocks = max(1, ceil_div(rows.count(), block_rows))

    def code(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for dim, group in pdf.groupby("dim"):
                bits, length, match = encode(np.stack(group["v"].to_numpy()), middle[dim], seed)
                yield pa.RecordBatch.from_arrays([pa.array(group["vec_id"]), pa.array([v.tolist() for v in group["v"]], pa.list_(pa.float64())), pa.array(group["dim"], pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(match)], ["vec_id", "v", "dim", "bits", "length", "match"])

    coded = rows.mapInArrow(code, "vec_id long, v array<double>, dim int, bits binary, length float, match float")
    return coded.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))), middle, blocks


def search(df: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", seed: int = 11, epsilon: float = EPSILON, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``is_query`` (over vec_id) chooses, among all other rows."""
    coded, middle, blocks = index(df, id_col, vector, seed, block_rows)
    coded = written(coded, "codes")
    asked = coded.where(is_query).select("vec_id", "v", "dim")
    query_blocks = max(1, ceil_div(asked.count(), block_queries))
    asked = asked.withColumn("q", F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(query_blocks)))
    left = asked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    right = coded.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("q"))

    def met(asked_rows: pd.DataFrame, held_rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for dim, queries in asked_rows.groupby("dim"):
            own = held_rows[held_rows["dim"] == dim]
            if len(own):
                rows, bits = np.stack(own["v"].to_numpy()), np.frombuffer(b"".join(own["bits"]), dtype=np.uint8).reshape(len(own), -1)
                got = nearest(queries["vec_id"].to_numpy(), np.stack(queries["v"].to_numpy()), own["vec_id"].to_numpy(), rows, bits, own["length"].to_numpy(), own["match"].to_numpy(), middle[dim], k, seed, epsilon)
                found.append(pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got, strict=True))))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    near = left.groupBy("block", "q").cogroup(right.groupBy("block", "q")).applyInPandas(met, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
