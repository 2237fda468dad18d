"""What a reviewer looks at: a family in detail, the invoices to review, statuses and signals, and retries without ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import ambiguous
from ledgerloom.functions.numbers import ratio
from ledgerloom.functions.rules import DISCOVERY_THRESHOLD, healing_authority, trusted
from ledgerloom.functions.text import first_matching
from ledgerloom.operators import history, store

# The fields whose misses count as critical.
CRITICAL_FIELDS = ("invoiceNumber", "invoiceDate", "total")


def display_status(results: DataFrame) -> DataFrame:
    """Results with what to show of them: error, accepted, rejected, review or unvalidated, and the bucket of progress they count to."""
    c = F.col
    shown = first_matching([(c("error").isNotNull(), "error"), (c("validation_passed"), "accepted"), (c("route") == "REJECTED", "rejected"), (~c("validation_passed"), "review")], "unvalidated")
    progress = first_matching([(c("error").isNotNull(), "errors"), (c("validation_passed"), "accepted"), (~c("validation_passed"), "review")], "other")
    return results.withColumns({"display_status": shown, "progress_bucket": progress})


def review_signals(results: DataFrame, date: str = "invoice_date", limit: int = 3) -> DataFrame:
    """Results with up to ``limit`` reasons for a review, in a fixed order."""
    c = F.col
    signals = F.array_compact(F.array(
        F.when(c("error").isNotNull(), "runtime error"), F.when(c("validation_score") < 0.5, "low score"), F.when(c("validation_score").between(0.5, DISCOVERY_THRESHOLD), "below threshold"),
        F.when(ambiguous(c(date)), "ambiguous date"), F.when(c("reconciliation_failure"), "does not add up"), F.when(c("policy_failure"), "policy"),
    ))
    return results.withColumn("signals", F.slice(signals, 1, limit))


def review_invoices(results: DataFrame, examples: DataFrame, existing: DataFrame, family: str, limit: int = 10) -> DataFrame:
    """(invoice_path, position): a family's recent results, then its examples from the last on, each once, of those that exist."""
    recent = results.where(F.col("template_family_id") == family).select("invoice_path", F.lit(0).alias("kind"), (-F.unix_micros(F.col("processed_at").cast("timestamp"))).alias("at"), (-F.col("id")).alias("tie"))
    shown = examples.where(F.col("template_family_id") == family).select("invoice_path", F.lit(1).alias("kind"), (-F.col("id")).alias("at"), F.lit(0).cast("long").alias("tie"))
    first = recent.unionByName(shown).groupBy("invoice_path").agg(F.min(F.struct("kind", "at", "tie")).alias("o")).join(existing.select("invoice_path"), "invoice_path", "left_semi")
    return first.orderBy("o", "invoice_path").limit(limit).select("invoice_path")


def family_detail(families: DataFrame, fingerprints: DataFrame, results: DataFrame, examples: DataFrame, recent: int = 10) -> DataFrame:
    """A row a family: its record, representative, members, examples, and outcomes of its recent results."""
    members = fingerprints.groupBy("template_family_id").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("status") != "retired").alias("live_members"))
    lead = store.representative(fingerprints).select("template_family_id", F.col("fingerprint_hash").alias("representative"))
    shown = examples.groupBy("template_family_id").agg(F.count(F.lit(1)).alias("examples"))
    last = history.recent(results.where("template_family_id IS NOT NULL"), "template_family_id", [F.desc("processed_at"), F.desc("id")], recent)
    outcome = last.groupBy("template_family_id").agg(F.count_if("validation_passed").alias("recent_accepted"), F.count_if(~F.col("validation_passed")).alias("recent_rejected"), F.max("processed_at").alias("last_processed"))
    j = families
    for part in (members, lead, shown, outcome):
        j = j.join(part, "template_family_id", "left")
    return j.na.fill(0, ["members", "live_members", "examples", "recent_accepted", "recent_rejected"])


def critical_hits(fields: DataFrame) -> DataFrame:
    """One row: the share of critical fields that were found, and of labels that were matched.

    ``fields``: field, expected (boolean), found (boolean), label_matched (boolean).
    """
    wanted = F.col("expected") & F.col("field").isin(*CRITICAL_FIELDS)
    return fields.agg(F.round(ratio(F.count_if(wanted & F.col("found")), F.count_if(wanted)), 4).alias("critical_hit_rate"), F.round(ratio(F.count_if("label_matched"), F.count(F.lit(1))), 4).alias("label_match_rate"))


def healing_candidates(results: DataFrame, families: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(id, invoice_path, authority): rejected results without ground truth that a trusted family, else a trusted fingerprint, lets try again; none twice."""
    f = families.select("template_family_id", trusted(F.col("gt_apply_count"), F.col("gt_confidence")).alias("by_family"))
    p = fingerprints.select("fingerprint_hash", trusted(F.col("gt_apply_count"), F.col("gt_confidence")).alias("by_fingerprint"))
    open_ = results.where((F.col("route") == "REJECTED") & ~F.coalesce("healing_reprocessed", F.lit(False)))
    j = open_.join(f, "template_family_id", "left").join(p, "fingerprint_hash", "left")
    who = healing_authority(F.coalesce("by_family", F.lit(False)), F.coalesce("by_fingerprint", F.lit(False)))
    return j.select("id", "invoice_path", who.alias("authority")).where("authority IS NOT NULL")
