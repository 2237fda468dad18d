"""Mixing sources to target weights by Pfair scheduling of their blocks.

A source of weight a / M (integer shares a that sum to M) is a sequence of blocks; its i-th block (from 0) is
released at slot floor(i * M / a) and is due by slot ceil((i + 1) * M / a). In each slot the released block that is
due earliest goes next, ties to the smaller source. As weights sum to one, every block meets its due slot, so that
in any prefix a source is less than one block from its share. The schedule repeats every M slots, so one period is
laid out and the slot of any block follows by arithmetic. When a source runs out, a new phase starts in which the
others share the slots by the same integer shares. Every document keeps its place: none is dropped or repeated.

A document's place in its source is by the hash of its id and of the row that it is read from, so that the rows of one
id spread like any others and no two share a place, also when a task runs again. It is found without gathering a source: a
source is cut into chunks by the leading bits of the hash, about ``CHUNK_ROWS`` rows each, whose counts are summed up to
starting ranks, and rows are ranked within a chunk. Rows that do not come straight from files are written first. All of this is DataFrame functions; what the driver holds is a row a
source (``MAX_SOURCES`` at most) and the periods.

Shares are whole slots of a period, one at least, so weights are met as rounded to them: by up to half a slot in
``period`` for most sources, and more for one that is due less than a slot.

Cases: rows without a source make one source of their own; a source's last block may be short; repeated rows and rows
without an id are placed each, anywhere in their source; an empty table gives an empty result; other columns are carried along, but for those of an added column's name, which it replaces.
"""

from __future__ import annotations

import heapq
import json
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import in_rows, log2_ceil, written

CHUNK_ROWS = 4096
MAX_SOURCES = 1000
ADDED = ("block", "slot", "in_block", "released", "due")


def shares(sizes: dict[str | None, int], alpha: float = 0.7, period: int = 1000, weights: dict[str | None, float] | None = None) -> dict[str | None, int]:
    """Integer shares of the slots: of the weights, or else of sizes to the power alpha; at least one each."""
    period = max(period, 2 * len(sizes))
    raw = {s: (weights[s] if weights else n**alpha) for s, n in sizes.items()}
    total, free = sum(raw.values()), period - len(raw)
    exact = {s: free * x / total for s, x in raw.items()}
    got = {s: 1 + int(x) for s, x in exact.items()}
    spare = sorted(raw, key=lambda s: (int(exact[s]) - exact[s], s is None, s or ""))[: period - sum(got.values())]
    for s in spare:
        got[s] += 1
    shrink = gcd(*got.values()) if got else 1
    return {s: n // shrink for s, n in got.items()}


def period_slots(share: list[int]) -> list[list[int]]:
    """The slots of each source's blocks in one period of sum(share) slots, earliest due first among the released."""
    m = sum(share)
    waiting = sorted((0, k) for k in range(len(share)))
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slots: list[list[int]] = [[] for _ in share]
    for t in range(m):
        while waiting and waiting[0][0] <= t:
            _, k = heapq.heappop(waiting)
            i = len(slots[k])
            heapq.heappush(ready, (-(-(i + 1) * m // share[k]), k, i))
        due, k, i = heapq.heappop(ready)
        slots[k].append(t)
        if i + 1 < share[k]:
            heapq.heappush(waiting, ((i + 1) * m // share[k], k))
    return slots


def phases(blocks: list[int], share: list[int]) -> list[list[dict]]:
    """For each source its phases: from which block on (``b``), the phase's first slot (``t``), period (``m``), share and slots in a period."""
    left, first, at = list(blocks), 0, [0] * len(blocks)
    made: list[list[dict]] = [[] for _ in blocks]
    while active := [k for k, n in enumerate(left) if n]:
        own = [share[k] for k in active]
        m, slots = sum(own), period_slots(own)
        for k, s in zip(active, slots, strict=True):
            made[k].append({"b": at[k], "t": first, "m": m, "a": len(s), "slots": s})
        length = min((left[k] - 1) // len(s) * m + s[(left[k] - 1) % len(s)] + 1 for k, s in zip(active, slots, strict=True))
        for k, s in zip(active, slots, strict=True):
            done = length // m * len(s) + sum(x < length % m for x in s)
            left[k] -= done
            at[k] += done
        first += length
    return made


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", block_rows: int = 64, alpha: float = 0.7, period: int = 1000, weights: dict[str | None, float] | None = None) -> DataFrame:
    """``docs`` with block, slot, in_block, released and due: the mixture's order is by (slot, in_block)."""
    spark = docs.sparkSession
    counts = {r["s"]: r["n"] for r in docs.groupBy(F.col(source).cast("string").alias("s")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = sorted(counts, key=lambda s: (s is None, s or ""))
    share = shares(counts, alpha, period, weights)
    planned = phases([-(-counts[s] // block_rows) for s in names], [share[s] for s in names])
    rows = [{"s": s, "k": k, "bits": log2_ceil(-(-counts[s] // CHUNK_ROWS)), "phases": p} for k, (s, p) in enumerate(zip(names, planned, strict=True))]
    kind = "array<struct<s:string,k:int,bits:int,phases:array<struct<b:bigint,t:bigint,m:bigint,a:bigint,slots:array<bigint>>>>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))

    names = docs.columns
    own = in_rows(docs.toDF(*[f"c{k}" for k in range(len(names))]), "unmixed")  # whatever the columns are called
    id_col, source = f"c{names.index(id_col)}", f"c{names.index(source)}"
    hashed = own.withColumns({"__s": F.col(source).cast("string"), "__h": F.xxhash64(F.lit(0), F.col(id_col), F.col("__row"))})
    plan = F.broadcast(table.select(F.col("s").alias("__t"), F.col("k").alias("__k"), F.col("bits").alias("__bits")))
    chunked = hashed.join(plan, F.col("__s").eqNullSafe(F.col("__t"))).withColumn("__c", F.expr("if(__bits = 0, 0L, shiftrightunsigned(__h, 64 - __bits))"))

    sizes = chunked.groupBy("__k", "__c").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__k").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sizes.select("__k", "__c", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")).alias("__start")), "chunk-starts")

    within = Window.partitionBy("__k", "__c").orderBy("__h", F.col(id_col), "__file")
    ranked = chunked.join(starts, ["__k", "__c"]).withColumn("__r", F.col("__start") + F.row_number().over(within) - 1)
    timed = F.broadcast(table.select(F.col("k").alias("__k"), F.col("phases").alias("__p")))
    block = F.expr(f"__r div {int(block_rows)}")
    placed = ranked.withColumn("__b", block).join(timed, "__k").withColumn("__f", F.expr("element_at(filter(__p, p -> p.b <= __b), -1)"))
    i = F.expr("__b - __f.b")
    return placed.withColumn("__i", i).select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(names) if c not in ADDED],
        F.col("__b").alias("block"),
        F.expr("__f.t + __i div __f.a * __f.m + get(__f.slots, cast(__i % __f.a as int))").alias("slot"),
        F.expr(f"cast(__r % {int(block_rows)} as int)").alias("in_block"),
        F.expr("__f.t + __i * __f.m div __f.a").alias("released"),
        F.expr("__f.t + ((__i + 1) * __f.m + __f.a - 1) div __f.a").alias("due"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """``docs`` in the mixture's order: files, and rows within them, follow it."""
    names = docs.columns
    own = docs.toDF(*[f"c{k}" for k in range(len(names))])
    found = mix(own, f"c{names.index(id_col)}", f"c{names.index(source)}", **how)
    return found.orderBy("slot", "in_block").select(*own.columns).toDF(*names)
