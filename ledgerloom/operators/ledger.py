"""Issues, ledgers of them, and comparisons of runs and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.rules import error_issue, issue_weight
from ledgerloom.functions.text import first_matching


def issues(invoices: DataFrame) -> DataFrame:
    """An issue for each error of the invoices that did not pass, or one for an invoice without errors.

    Reads invoice_name, route, status, validation_passed, validation_score and validation_errors.
    """
    failed = invoices.where(~F.coalesce("validation_passed", F.lit(False)))
    fallback = F.when(F.col("route") == "ERROR", "runtime error").otherwise("validation failure")
    some = F.coalesce(F.size("validation_errors") > 0, F.lit(False))
    errors = F.when(some, F.col("validation_errors")).otherwise(F.array(fallback))
    each = failed.select("invoice_name", "route", "status", "validation_score", F.when(some, "validation_error").otherwise("summary_fallback").alias("source"), F.explode(errors).alias("detail"))
    x = error_issue(F.col("detail"), failed_run=(F.col("route") == "ERROR") | (F.col("status") == "ERROR"))
    each = each.withColumn("x", x).withColumns({"bucket": F.col("x.bucket"), "category": F.col("x.category")}).drop("x")
    return each.withColumn("weight", issue_weight(F.col("bucket"), F.col("category"), F.col("validation_score")))


def pseudo_issues(counts: DataFrame) -> DataFrame:
    """Issues from counts alone: (invoice_name, category_name, n) gives n issues each."""
    each = counts.select("invoice_name", F.col("category_name").alias("detail"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).drop("i")
    x = F.when(F.col("detail") == "failed_total", F.struct(F.lit("scalar_reconciliation").alias("bucket"), F.lit("other").alias("category"))).otherwise(error_issue(F.col("detail")))
    each = each.withColumn("x", x).withColumns({"bucket": F.col("x.bucket"), "category": F.col("x.category")}).drop("x")
    return each.withColumn("weight", issue_weight(F.col("bucket"), F.col("category"), F.lit(None).cast("double")))


def ledger(items: DataFrame) -> DataFrame:
    """A row a bucket: issue_count, weighted_issue_count, invoices (distinct), categories (name=count, in order).

    Weights are summed as decimals, so the order of rows leaves no trace. Names stay a count here; ``ledger_invoices`` lists them.
    """
    by_category = items.groupBy("bucket", "category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("weight").cast("decimal(18,4)")).alias("w"))
    sums = by_category.groupBy("bucket").agg(F.sum("n").alias("issue_count"), F.sum("w").cast("double").alias("weighted_issue_count"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "category", F.col("n").cast("string")))), ",").alias("categories"))
    names = items.groupBy("bucket").agg(F.count_distinct("invoice_name").alias("invoices"))
    return sums.join(names, "bucket")


def ledger_invoices(items: DataFrame) -> DataFrame:
    """(bucket, invoice_name), each once."""
    return items.select("bucket", "invoice_name").where("invoice_name IS NOT NULL").distinct()


def bucket_comparison(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Counts and weights of each bucket in two ledgers, none where a side lacks it, and the changes."""
    side = lambda df, p: df.select("bucket", F.col("issue_count").alias(f"{p}_count"), F.col("weighted_issue_count").alias(f"{p}_weight"))
    j = side(baseline, "baseline").join(side(candidate, "candidate"), "bucket", "full_outer").na.fill(0)
    return j.withColumns({"count_delta": F.col("candidate_count") - F.col("baseline_count"), "weight_delta": F.round(F.col("candidate_weight") - F.col("baseline_weight"), 4)})


def benchmark_progress(baseline: DataFrame, candidate: DataFrame, target: float = 0.75) -> DataFrame:
    """One row: weights of two ledgers, the reduction, the share of the target reached, and what is left to it."""
    b = baseline.agg(F.coalesce(F.sum(F.col("weighted_issue_count").cast("decimal(18,4)")), F.lit(0)).cast("double").alias("baseline_weight"))
    c = candidate.agg(F.coalesce(F.sum(F.col("weighted_issue_count").cast("decimal(18,4)")), F.lit(0)).cast("double").alias("candidate_weight"))
    j = b.crossJoin(c)  # one row each
    reduction = F.when(F.col("baseline_weight") > 0, (F.col("baseline_weight") - F.col("candidate_weight")) / F.col("baseline_weight")).otherwise(0.0)
    j = j.withColumn("reduction", F.round(reduction, 4))
    left = F.greatest(F.lit(0.0), F.col("candidate_weight") - F.col("baseline_weight") * (1 - target))
    return j.withColumns({"progress": F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), reduction / target)), 4), "remaining_weight": F.round(left, 4), "target_met": reduction >= target})


def run_diff(baseline: DataFrame, candidate: DataFrame, key: str = "invoice_name") -> DataFrame:
    """The invoices of both runs with their scores and a change: fixed, broken, improved, declined, rerouted or unchanged."""
    side = lambda df, p: df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in ("validation_passed", "validation_score", "route")])
    j = side(baseline, "old").join(side(candidate, "new"), key)
    was, now = F.coalesce("old_validation_passed", F.lit(False)), F.coalesce("new_validation_passed", F.lit(False))
    delta = F.round(F.col("new_validation_score") - F.col("old_validation_score"), 4)
    change = first_matching([(~was & now, "fixed"), (was & ~now, "broken"), (delta > 0, "improved"), (delta < 0, "declined"), (~F.col("old_route").eqNullSafe(F.col("new_route")), "rerouted")], "unchanged")
    return j.withColumns({"score_delta": delta, "change": change})


def latest_runs(runs: DataFrame, back: int = 0, by: str = "dataset") -> DataFrame:
    """Of each dataset the run that lies ``back`` runs before the last."""
    w = Window.partitionBy(by).orderBy(F.desc("id"))
    return runs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == back + 1).drop("__n")
