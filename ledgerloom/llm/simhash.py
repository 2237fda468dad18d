"""SimHash near-duplicates: pigeonhole blocks, a join on them, then the Hamming distance.

Fingerprints of 64 bits are cut into ``blocks`` blocks. Two that differ in at most ``distance`` bits agree in at
least blocks - distance whole blocks, so every such combination of blocks is a key under which they meet. With
5 blocks and distance 3 a key has 25 or 26 bits; ``blocks_for`` takes more blocks, hence longer keys, for more
fingerprints. Equal fingerprints are one node throughout, so copies cost one row and not their pairs.

A key that up to ``bucket`` fingerprints share is verified in memory, all its pairs at once, and yields a
spanning star of each group found, not its pairs. A key that more share goes an exact way of linear size: of two
fingerprints within 3 bits there is a point within 1 bit of one and 2 bits of the other. Each fingerprint lists
the points around it that agree with it in the key; those within 2 bits of a point link to the least of those
within 1 bit of it, and all those links are true.

Cases: null, empty and space-only texts have no word and fingerprint zero, linked like any other; fewer words than
a shingle's make one shingle of what there is; repeated rows are copies; documents with a null id count, but name
no component; one in which no document has an id has none either, only its root; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.shared import written

SEED = 42
BUCKET = 2000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_words = re.compile(rb"[^ \t-\r]+").findall


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint of a whole text."""
    words = _words((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [h(b" ".join(words), SEED)]
    else:
        join = b" ".join
        hashes = [h(join(x), SEED) for x in zip(*(words[k:] for k in range(width)))]  # noqa: B905  the last slice ends first
    n, ones = len(hashes), np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.pandas_udf(_fingerprints, "long")(F.col(text)).alias("fp"))


def blocks_for(n: int, distance: int = 3) -> int:
    """Blocks to cut into for n fingerprints: the fewest whose keys have as many bits as n, 2 more than the distance at least."""
    k = distance + 2
    while 64 * (k - distance) // k < max(1, n).bit_length() and k < 2 * distance + 2:
        k += 1
    return k


def masks(blocks: int, distance: int) -> list[int]:
    """For each combination of blocks the bits that it keeps."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    one = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(one, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _linked(group: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint of a group the index of the least one that it reaches."""
    near = np.bitwise_count(group[:, None] ^ group[None, :]) <= distance
    label = np.arange(len(group))
    while True:
        new = np.where(near, label[None, :], len(group)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _small_buckets(keys: DataFrame, sizes: DataFrame, bucket: int, distance: int) -> DataFrame:
    met = keys.join(sizes.where(f"n <= {bucket}").select("c", "k"), ["c", "k"]).groupBy("c", "k").agg(F.collect_list("fp").alias("fps"))  # at most ``bucket``

    def verify(batches):
        for batch in batches:
            fps = batch.column(0)
            ends = fps.offsets.to_numpy()
            values = fps.values.to_numpy(zero_copy_only=False)
            a, b = [], []
            size = np.diff(ends)
            two = ends[:-1][size == 2]
            x, y = values[two], values[two + 1]
            close = np.bitwise_count((x ^ y).view(np.uint64)) <= distance
            a.append(x[close])
            b.append(y[close])
            for i in np.flatnonzero(size > 2):
                group = values[ends[i] : ends[i + 1]]
                label = _linked(group.view(np.uint64), distance)
                own = np.flatnonzero(label != np.arange(len(group)))
                a.append(group[own])
                b.append(group[label[own]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return met.select("fps").mapInArrow(verify, "a long, b long")


def _large_buckets(keys: DataFrame, sizes: DataFrame, bucket: int, distance: int, kept: list[int]) -> DataFrame:
    """Links in the keys that more than ``bucket`` fingerprints share, by the points between; linear in their number."""
    large = keys.join(sizes.where(f"n > {bucket}").select("c", "k"), ["c", "k"])
    inner, outer = distance // 2, distance - distance // 2
    around = []
    for mask in kept:
        free = [1 << b for b in range(64) if not mask >> b & 1]
        around.append([(signed(sum(x)), r) for r in range(outer + 1) for x in combinations(free, r)])
    flips = [np.array([f for f, _ in x], dtype=np.int64) for x in around]
    steps = [np.array([r for _, r in x], dtype=np.int32) for x in around]

    def points(batches):
        for batch in batches:
            for c, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(flips[c])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, dtype=np.int32)), pa.array(flips[c] ^ np.int64(fp)), pa.array(np.full(n, fp, dtype=np.int64)), pa.array(steps[c])], ["c", "p", "fp", "r"])

    balls = large.select("c", "fp").mapInArrow(points, "c int, p long, fp long, r int")
    anchors = balls.where(F.col("r") <= inner).groupBy("c", "p").agg(F.min("fp").alias("b"))
    return balls.join(anchors, ["c", "p"]).where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def links(nodes: DataFrame, distance: int = 3, blocks: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (``nodes.fp``) that span all groups within ``distance`` bits."""
    kept = masks(blocks or blocks_for(nodes.count(), distance), distance)
    keyed = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for c, m in enumerate(kept)]))
    keys = nodes.select("fp", keyed.alias("x")).select("fp", "x.c", "x.k")
    sizes = written(keys.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    found = _small_buckets(keys, sizes, bucket, distance)
    if sizes.where(f"n > {bucket}").limit(1).count():
        found = found.unionByName(_large_buckets(keys, sizes, bucket, distance, kept))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = 3, blocks: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, root, component_id) of every document: the component's id is the least document id that it reaches, its root the least fingerprint."""
    marked = written(fingerprints(docs, id_col, text), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes, distance, blocks, bucket))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(rooted.join(named, "root").select("fp", "root", "component_id"), "components")
    return marked.join(of, "fp", "left")


LEAST_FILTER, LARGEST_FILTER = 1 << 20, 1 << 28
"""Bits of a Bloom filter: 16 an id, within these. Beyond 16 million ids it lets more and more rows pass to the join, which stays exact."""


def _places(id_col: F.Column, bits: int) -> list[F.Column]:
    h, g = F.xxhash64(id_col), F.xxhash64(F.lit(1), id_col)
    mask = F.lit(bits - 1)
    return [x.bitwiseAND(mask) for x in (h, F.shiftrightunsigned(h, 32), g, F.shiftrightunsigned(g, 32))]


def filter_bits(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids (doc_id): its words are combined by the cluster, and at most ``LARGEST_FILTER`` / 64 reach the driver."""
    size = min(LARGEST_FILTER, max(LEAST_FILTER, 1 << (16 * ids.count()).bit_length()))
    places = ids.select(F.explode(F.array(*_places(F.col("doc_id"), size))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toArrow()
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return bits


def maybe_in(bits: np.ndarray, id_col: F.Column) -> F.Column:
    """Whether an id may be in the filter; never false of one that is. Null may always be."""
    held = SparkSession.getActiveSession().sparkContext.broadcast(bits)

    def look(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        found = np.ones(len(a), dtype=bool)
        for p in (a, b, c, d):
            at = p.to_numpy(np.int64)
            found &= (held.value[at >> 6] >> (at & 63) & 1).astype(bool)
        return pd.Series(found)

    return F.pandas_udf(look, "boolean")(*_places(id_col, 64 * len(bits))) | id_col.isNull()


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the document of least id stays, once.

    Only rows whose id may be among those that go, or that repeat, meet the list of ids in a join; a filter of bounded
    size tells them from the rest, which is neither shuffled nor sorted. Of rows that repeat an id that stays, one does. Of a component in which no document has an id one stays as well.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{k}" for k in range(len(names))])  # whatever the columns are called
    key = f"c{names.index(id_col)}"
    found = written(near_duplicates(own, key, f"c{names.index(text)}", distance), "groups")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = written(found.groupBy("doc_id").agg(F.count_if(stays).alias("n"), F.count(F.lit(1)).alias("rows")), "survivors")
    doubtful = filter_bits(ids.where("n != 1 OR rows != 1").select("doc_id"))
    marked = own.withColumn("b", maybe_in(doubtful, F.col(key).cast("long")))
    sure = marked.where(~F.col("b")).select(*own.columns)  # most rows: they stay where they are
    rows = marked.where("b").join(ids.where("n > 0").select("doc_id", "n"), own[key].cast("long") == F.col("doc_id"))
    once = rows.where("n = 1").select(*own.columns)
    more = rows.where("n > 1").groupBy("doc_id").agg(F.first(F.struct(*own.columns)).alias("row")).select("row.*")
    kept = sure.unionByName(once).unionByName(more)
    if ids.where("doc_id IS NULL").limit(1).count():
        alone = found.where("component_id IS NULL").select("fp", "root").distinct()
        nameless = own.where(F.col(key).isNull()).withColumn("fp", F.pandas_udf(_fingerprints, "long")(F.col(f"c{names.index(text)}")))
        kept = kept.unionByName(nameless.join(alone, "fp").groupBy("root").agg(F.first(F.struct(*own.columns)).alias("row")).select("row.*"))
    return kept.toDF(*names)
