"""Sequences of outcomes: recent ones, rolling rates, running means, gaps, and runs of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.rules import DEGRADATION, ESTABLISH_CONFIDENCE, ESTABLISH_COUNT


def recent(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The last n rows of each key with their position, by the given order. Spark cuts each task's groups to n before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def rolling_degradation(df: DataFrame, key: str, order: list[str], outcome: str, size: int = 10, floor: float = DEGRADATION) -> DataFrame:
    """Each outcome that is not null with the pass rate over the last ``size``, and whether a full window is below the floor."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(size - 1), 0)
    x = df.where(F.col(outcome).isNotNull()).withColumns({"window_count": F.count(F.lit(1)).over(w), "pass_count": F.sum(F.col(outcome).cast("int")).over(w)})
    rate = F.col("pass_count") / F.col("window_count")
    return x.withColumns({"pass_rate": rate, "degraded": (F.col("window_count") == size) & (rate < floor)})


def running_confidence(df: DataFrame, key: str, order: list[str], score: str) -> DataFrame:
    """The mean of all scores so far, their number, and whether that establishes the key. Scores are summed as decimals."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumns({"apply_count": F.count(score).over(w), "__s": F.sum(F.col(score).cast("decimal(18,4)")).over(w)})
    mean = F.round(F.col("__s").cast("double") / F.col("apply_count"), 6)
    status = F.when((F.col("apply_count") >= ESTABLISH_COUNT) & (F.col("confidence") >= ESTABLISH_CONFIDENCE), "established").otherwise("provisional")
    return x.withColumn("confidence", mean).withColumn("status", status).drop("__s")


def segments(df: DataFrame, key: list[str], order: list[str], start: str, end: str, gap) -> DataFrame:
    """Rows with the number of their segment: a new one begins where a row starts ``gap`` or more after the end of the row before."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = F.coalesce(F.col(start) - F.lag(end).over(w) >= gap, F.lit(False)).cast("int")
    return df.withColumn("__new", new).withColumn("segment", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def phrases(tokens: DataFrame, key: list[str], seq: str, text: str, longest: int = 4) -> DataFrame:
    """All runs of 1 to ``longest`` neighbouring tokens in each group."""
    w = Window.partitionBy(*key).orderBy(seq)
    x = tokens
    for k in range(1, longest):
        x = x.withColumn(f"__{k}", F.lead(text, k).over(w))
    runs = [F.struct(F.lit(n).alias("length"), F.when(F.col(f"__{n - 1}").isNotNull() if n > 1 else F.lit(True), F.concat_ws(" ", text, *[f"__{k}" for k in range(1, n)])).alias("phrase")) for n in range(1, longest + 1)]
    return x.select(*key, seq, F.explode(F.array(*runs)).alias("r")).where("r.phrase IS NOT NULL").select(*key, seq, "r.length", "r.phrase")


def phrase_counts(texts: DataFrame, key: list[str], words: str, longest: int = 4) -> DataFrame:
    """(key, length, n, n_distinct): how many runs of 1 to ``longest`` neighbouring words each row's array has, and how many different ones.

    Counted within the row, so that neither words nor runs travel. Lengths without a run have no row; words hold no spaces.
    """
    w = F.col("__words")
    x = texts.select(*key, F.col(words).alias("__words")).where(F.size(words) > 0)
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.concat_ws(" ", *[F.element_at(w, i + k) for k in range(n)])) if n > 1 else w
    counted = [F.when(F.size(w) >= n, F.struct(F.lit(n).alias("length"), (F.size(w) - n + 1).cast("long").alias("n"), F.size(F.array_distinct(run(n))).cast("long").alias("n_distinct"))) for n in range(1, longest + 1)]
    return x.select(*key, F.explode(F.array(*counted)).alias("r")).where("r IS NOT NULL").select(*key, "r.*")


def first_assignment(candidates: DataFrame, group: list[str], slot: str, score: str, seq: list[str]) -> DataFrame:
    """Of each slot in a group the candidate of the highest score, the first in ties."""
    w = Window.partitionBy(*group, slot).orderBy(F.desc(score), *seq)
    return candidates.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merged_tokens(tokens: DataFrame, key: list[str], seq: str, text: str) -> DataFrame:
    """Tokens with thousands that OCR split joined again: ``$1`` before ``234.56`` is ``$1234.56``; the second part goes."""
    w = Window.partitionBy(*key).orderBy(seq)
    head, tail = r"^[$€£]?\d{1,3},?$", r"^\d{3}[.]\d{2}$"
    x = tokens.withColumns({"__next": F.lead(text).over(w), "__before": F.lag(text).over(w)})
    joined = F.when(F.col(text).rlike(head) & F.col("__next").rlike(tail), F.concat(F.regexp_replace(text, ",$", ""), F.col("__next"))).otherwise(F.col(text))
    gone = F.coalesce(F.col(text).rlike(tail) & F.col("__before").rlike(head), F.lit(False))
    return x.where(~gone).withColumn(text, joined).drop("__next", "__before")


def close_pairs(events: DataFrame, key: str, at: str, value: str, ident: str, reach: int, change: float) -> DataFrame:
    """(left_id, right_id, delta) of all pairs of a key's events that are within ``reach`` in ``at`` and whose values differ by ``change`` at most, each once.

    Places are cut into cells as wide as the reach; an event meets those of its own cell and of the one on either side.
    """
    c = F.col
    e = events.where(c(value).isNotNull() & c(at).isNotNull()).select(c(ident).alias("id"), c(key).alias("k"), c(value).alias("v"), c(at).alias("m")).withColumn("cell", F.floor(c("m") / reach))
    a = e.select(c("id").alias("left_id"), "k", c("v").alias("lv"), c("m").alias("lm"), F.explode(F.array(c("cell") - 1, c("cell"), c("cell") + 1)).alias("cell"))
    b = e.select(c("id").alias("right_id"), "k", "v", "m", "cell")
    delta = F.round(c("v") - c("lv"), 6)
    return a.join(b, ["k", "cell"]).where("left_id < right_id").where((F.abs(c("m") - c("lm")) <= reach) & (F.abs(delta) <= change)).select("left_id", "right_id", delta.alias("delta"))
