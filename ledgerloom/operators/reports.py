"""Summaries over processing results: runs, failures, rankings, triage, rollups, queues.

A results table has a row an invoice: invoice_name, invoice_path, id, processed_at, route, attempted_route, status,
validation_passed, validation_score, validation_errors, template_family_id, stage_status, reconciliation_failure,
policy_failure, family_match_outcome, elapsed_ms, peak_rss_mb, quality_score, error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import ratio
from ledgerloom.functions.rules import error_category, family_status, score_band, triage
from ledgerloom.functions.sets import top_values

DECIMAL = "decimal(24,6)"


def exact_mean(x: Column) -> Column:
    """The mean over decimals of six places: the same whatever the order of rows."""
    return (F.sum(x.cast(DECIMAL)) / F.count(x)).cast("double")


def run_summary(results: DataFrame) -> DataFrame:
    """One row: totals, outcomes by attempted route, latencies (mean floored), memory, quality, and rates. One pass, partially aggregated."""
    c = F.col
    passed, failed = c("validation_passed"), ~c("validation_passed")
    ran = c("error").isNull()
    n = F.count(F.lit(1))
    applied = F.count_if(c("attempted_route") == "APPLY")
    lost = F.count_if(ran & (c("attempted_route") == "APPLY") & failed)
    return results.agg(
        n.alias("total_invoices"),
        F.count_if(ran & (c("attempted_route") == "DISCOVERY") & passed).alias("discovery_passed"),
        F.count_if(ran & (c("attempted_route") == "DISCOVERY") & failed).alias("discovery_rejected"),
        lost.alias("apply_rejected"),
        F.count_if(~ran).alias("runtime_errors"),
        F.count_if(~ran & (c("attempted_route") == "APPLY")).alias("apply_runtime_errors"),
        F.count_if(~ran & (c("attempted_route") == "DISCOVERY")).alias("discovery_runtime_errors"),
        F.min("elapsed_ms").alias("latency_min"),
        F.expr("sum(elapsed_ms) div count(elapsed_ms)").alias("latency_avg"),
        F.max("elapsed_ms").alias("latency_max"),
        F.round(exact_mean(c("peak_rss_mb")), 3).alias("rss_avg"),
        F.min("quality_score").alias("quality_min"),
        F.round(exact_mean(c("quality_score")), 6).alias("quality_avg"),
        F.max("quality_score").alias("quality_max"),
        F.round(ratio(F.count("template_family_id"), n), 4).alias("family_match_rate"),
        F.round(ratio(F.count_if(c("route") == "APPLY"), n), 4).alias("apply_rate"),
        F.round(ratio(lost, applied), 4).alias("false_apply_rate"),
    )


def counts_by(results: DataFrame, *metrics: str) -> DataFrame:
    """(metric, value, n): histograms of several columns in one pass, by grouping sets."""
    tagged = results.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in metrics])).alias("x"))
    return tagged.select("x.metric", "x.value").where("value IS NOT NULL").groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))


def solved_families(results: DataFrame) -> DataFrame:
    """(template_family_id, invoices, passed, failed, solved, in_review)."""
    per = results.where("template_family_id IS NOT NULL").groupBy("template_family_id").agg(F.count(F.lit(1)).alias("invoices"), F.count_if("validation_passed").alias("passed"), F.count_if(~F.col("validation_passed")).alias("failed"))
    return per.withColumns({"solved": F.col("passed") > 0, "in_review": F.col("failed") > 0})


def failure_modes(results: DataFrame) -> DataFrame:
    """(metric, value, n) over the failed results: by route; of failed discoveries by stage, category, counts and score band."""
    failed = results.where(~F.col("validation_passed"))
    base = failed.select(F.coalesce("attempted_route", F.lit("UNKNOWN")).alias("attempted_route"), "stage_status", "validation_score", "validation_errors")
    errors = F.when(F.coalesce(F.size("validation_errors"), F.lit(-1)) > 0, F.transform("validation_errors", error_category)).otherwise(F.array(F.lit("unknown")))
    missing = F.size(F.filter("validation_errors", lambda e: error_category(e) == "missing_field"))
    mismatch = F.size(F.filter("validation_errors", lambda e: error_category(e) == "field_mismatch"))
    found = F.col("attempted_route") == "DISCOVERY"
    pair = lambda m, v: F.struct(F.lit(m).alias("metric"), v.alias("value"))
    of_discovery = F.concat(
        F.array(pair("stage_status", F.col("stage_status")), pair("score_band", score_band(F.col("validation_score"))), pair("scalar_counts", F.format_string("missing=%d, mismatch=%d", F.coalesce(missing, F.lit(0)), F.coalesce(mismatch, F.lit(0))))),
        F.transform(errors, lambda e: F.struct(F.lit("error_category").alias("metric"), e.alias("value"))),
    )
    pairs = F.concat(F.array(pair("attempted_route", F.col("attempted_route"))), F.when(found, of_discovery).otherwise(F.array().cast("array<struct<metric:string,value:string>>")))
    return base.select(F.explode(pairs).alias("x")).select("x.metric", "x.value").where("value IS NOT NULL").groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))


def family_rankings(results: DataFrame) -> DataFrame:
    """A row a family with rates and an impact score, for review from the highest impact on."""
    c = F.col
    per = results.where("template_family_id IS NOT NULL").groupBy("template_family_id").agg(
        F.count(F.lit(1)).alias("invoice_count"),
        F.count_if("validation_passed").alias("accepted_count"),
        F.count_if(~c("validation_passed") | (c("validation_passed").isNull() & (c("route") == "REJECTED"))).alias("review_count"),
        F.count_if(c("attempted_route") == "APPLY").alias("apply_route_count"),
        F.count_if((c("attempted_route") == "APPLY") & c("validation_passed")).alias("apply_success_count"),
        F.count_if(c("family_match_outcome") == "matched").alias("family_match_count"),
        F.count_if("reconciliation_failure").alias("reconciliation_failure_count"),
        F.count_if("policy_failure").alias("validator_policy_failure_count"),
        F.round(exact_mean(c("validation_score")), 4).alias("avg_validation_score"),
    )
    rate = c("accepted_count") / c("invoice_count")
    impact = c("invoice_count") * (1.0 - rate) * 1.4 + c("apply_route_count") * 0.35 + c("reconciliation_failure_count") * 0.25 + c("validator_policy_failure_count") * 0.15
    return per.withColumns({
        "pass_rate": F.round(rate, 4), "apply_reuse_rate": F.round(ratio(c("apply_success_count"), c("apply_route_count")), 4), "family_match_rate": F.round(c("family_match_count") / c("invoice_count"), 4),
        "impact_score": F.round(impact, 3), "unresolved_count": c("review_count"),
    })


def ranked(rankings: DataFrame) -> DataFrame:
    """The rankings in order of review: unresolved first, then by impact, size and id."""
    return rankings.orderBy(F.col("unresolved_count") == 0, F.desc("impact_score"), F.desc("invoice_count"), "template_family_id")


def example_invoices(results: DataFrame, n: int = 3) -> DataFrame:
    """(template_family_id, position, invoice_name): the first n different names of each family, in order of arrival."""
    first = results.where("template_family_id IS NOT NULL").groupBy("template_family_id", "invoice_name").agg(F.min("id").alias("id"))
    w = Window.partitionBy("template_family_id").orderBy("id")
    return first.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).drop("id")


def family_triage(families: DataFrame) -> DataFrame:
    """Families (template_family_id, status, apply_count, reject_count, field_override_count) with their triage."""
    t = triage(F.col("status"), F.col("apply_count"), F.col("reject_count"), F.col("field_override_count"))
    return families.withColumn("t", t).select("template_family_id", "status", "apply_count", "reject_count", "t.*")


def triage_order(triaged: DataFrame) -> DataFrame:
    """Worst class first, then by impact, status (degraded, provisional, established), rejections and id."""
    by_status = F.when(F.col("status") == "degraded", 0).when(F.col("status") == "provisional", 1).otherwise(2)
    return triaged.orderBy("triage_rank", F.desc("impact_score"), by_status, F.desc("reject_count"), "template_family_id")


def family_rollup(fingerprints: DataFrame, results: DataFrame) -> DataFrame:
    """A row a family: counts as the larger of results' and fingerprints', confidence by scores, else weighted by outcomes, and the status."""
    c = F.col
    r = results.groupBy("template_family_id").agg(
        F.count_if("validation_passed").alias("ra"), F.count_if(~c("validation_passed") | (c("validation_passed").isNull() & (c("route") == "REJECTED"))).alias("rr"), exact_mean(c("validation_score")).alias("rs")
    )
    weight = F.greatest(c("apply_count") + c("reject_count"), F.lit(1))
    f = fingerprints.groupBy("template_family_id").agg(
        F.sum(F.greatest("apply_count", F.lit(0))).alias("fa"), F.sum(F.greatest("reject_count", F.lit(0))).alias("fr"), (F.sum((c("confidence") * weight).cast(DECIMAL)) / F.sum(weight)).cast("double").alias("fc")
    )
    j = f.join(r, "template_family_id", "full_outer")
    zero = F.lit(0)
    j = j.select("template_family_id", F.greatest(F.coalesce("ra", zero), F.coalesce("fa", zero)).alias("apply_count"), F.greatest(F.coalesce("rr", zero), F.coalesce("fr", zero)).alias("reject_count"), F.coalesce("rs", "fc", F.lit(0.0)).alias("confidence"))
    return j.withColumns({"status": family_status(c("apply_count"), c("reject_count"), c("confidence")), "confidence": F.round("confidence", 4)})


def mode_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, mode, mode_count, members, share): the most frequent value of each group, the smallest in ties."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    first = F.min_by(F.struct(F.col(value).alias("mode"), F.col("n").alias("mode_count")), F.struct((-F.col("n")).alias("k"), F.col(value)))
    per = counts.groupBy(group).agg(first.alias("x"), F.sum("n").alias("members"))
    return per.select(group, "x.mode", "x.mode_count", "members", F.round(F.col("x.mode_count") / F.col("members"), 4).alias("share"))


def most_common(df: DataFrame, group: list[str], value: str, n: int) -> DataFrame:
    """The n most frequent values of each group with their counts; the smaller value in ties."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def keyword_union(hits: DataFrame, n: int = 20) -> DataFrame:
    """(group, key, values): the first n different values of every key of the maps ``keyword_hits`` of each group."""
    each = hits.select("group", F.explode("keyword_hits").alias("key", "found")).select("group", "key", F.explode("found").alias("value")).distinct()
    w = Window.partitionBy("group", "key").orderBy("value")
    kept = each.withColumn("i", F.row_number().over(w)).where(F.col("i") <= n)  # so at most n values meet in a list
    return kept.groupBy("group", "key").agg(top_values(F.collect_list("value"), n).alias("values"))


def attention(results: DataFrame, n: int = 8) -> DataFrame:
    """The n results to look at first: errors, then those without a score, then the lowest scores; 0 sorts as 1, as does none."""
    score = F.when(F.coalesce("validation_score", F.lit(0.0)) == 0.0, 1.0).otherwise(F.col("validation_score"))
    return results.where(~F.coalesce("validation_passed", F.lit(False))).orderBy(F.col("error").isNull(), F.col("validation_score").isNotNull(), score, "invoice_name").limit(n)


def healing_summary(results: DataFrame) -> DataFrame:
    """One row: attempts and recoveries of retries without ground truth."""
    return results.agg(F.count_if("healing_reprocessed").alias("attempts"), F.count_if(F.col("healing_reprocessed") & F.col("validation_passed")).alias("recoveries"))


def benchmark_status(before: DataFrame, after: DataFrame, invoices: DataFrame) -> DataFrame:
    """(invoice_path, before_status, after_status, change): of every listed invoice, missing where a run lacks it."""
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("validation_passed"), "accepted").when(~F.col("validation_passed"), "rejected").otherwise("unvalidated")
    side = lambda df, p: df.select("invoice_path", status.alias(f"{p}_status"))
    j = invoices.select("invoice_path").join(side(before, "before"), "invoice_path", "left").join(side(after, "after"), "invoice_path", "left").na.fill("missing")
    rank = lambda c: F.when(c == "accepted", 3).when(c == "unvalidated", 2).when(c == "rejected", 1).otherwise(0)
    b, a = rank(F.col("before_status")), rank(F.col("after_status"))
    return j.withColumn("change", F.when(a > b, "improved").when(a < b, "regressed").otherwise("unchanged"))


def workspace_report(files: DataFrame, largest: int = 25) -> tuple[DataFrame, DataFrame]:
    """From (path, text): counts of files, lines, characters and estimated tokens by first folder; and the largest files."""
    sized = files.select("path", F.element_at(F.split("path", "/"), 1).alias("folder"), F.length("text").cast("long").alias("chars"), (F.size(F.split("text", "\n")) - F.when(F.col("text").endswith("\n"), 1).otherwise(0)).cast("long").alias("lines"), F.floor(F.length("text") / 4).alias("tokens"))
    return sized.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens")), sized.orderBy(F.desc("chars"), "path").limit(largest)
