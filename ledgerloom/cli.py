"""Commands over a workspace: each reads tables, applies one operator, and shows or writes its result."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import ledger, lifecycle, reports, routing, store
from ledgerloom.plans import process
from ledgerloom.sources import files
from ledgerloom.sources.workspace import Workspace


def _show(df, a) -> None:
    df.show(a.limit, truncate=False)


def _process(w, a):
    pages = w.spark.read.schema("doc_id string, page_no int, text string").parquet(a.input)
    done = process.normalized(pages)
    done.write.mode("overwrite").parquet(w.path("invoices"))
    return done.groupBy("status").count()


def _family_change(w, a):
    f = w.read("fingerprints")
    if a.command == "family-merge":
        w.replace("fingerprints", lifecycle.merge_family(f, a.family, a.target))
        w.replace("families", store.retired(w.read("families"), w.spark.createDataFrame([(a.family,)], "template_family_id string"), "template_family_id"))
    elif a.command == "family-split":
        w.replace("fingerprints", lifecycle.split_family(f, w.spark.createDataFrame([(h,) for h in a.hashes], "fingerprint_hash string"), a.target))
    else:
        gone = w.spark.createDataFrame([(a.family,)], "template_family_id string")
        w.replace("families", store.retired(w.read("families"), gone, "template_family_id"))
        w.replace("fingerprints", store.retired(f, gone, "template_family_id"))
    return w.read("families").select("template_family_id", "status")


COMMANDS = {
    "process": _process,
    "demo": lambda w, a: process.normalized(files.demo(w.spark)),
    "fingerprints": lambda w, a: w.read("fingerprints").where("status != 'retired'").orderBy("fingerprint_hash"),
    "families": lambda w, a: reports.triage_order(reports.family_triage(w.read("families"))),
    "family-show": lambda w, a: w.read("families").where(F.col("template_family_id") == a.family),
    "family-suggestions": lambda w, a: lifecycle.profile_suggestions(w.read("results").withColumns({"line_source": F.lit(None).cast("string"), "table_found": F.lit(True), "date_ambiguous": F.lit(False), "party_suspicious": F.col("reconciliation_failure")})),
    "family-splits": lambda w, a: lifecycle.split_clusters(w.read("fingerprints")).groupBy("template_family_id", "cluster").count(),
    "family-merges": lambda w, a: routing.merge_candidates(w.read("families")),
    "family-retirements": lambda w, a: lifecycle.retirements(w.read("families"), w.read("fingerprints")),
    "family-merge": _family_change,
    "family-split": _family_change,
    "family-retire": _family_change,
    "validate": lambda w, a: w.read("results").where("NOT validation_passed").orderBy(F.desc("processed_at"), F.desc("id")),
    "analyze-failures": lambda w, a: reports.failure_modes(w.read("results")).orderBy("metric", F.desc("n")),
    "run-summary": lambda w, a: reports.run_summary(w.read("results")),
    "rankings": lambda w, a: reports.ranked(reports.family_rankings(w.read("results"))),
    "issues": lambda w, a: ledger.ledger(ledger.issues(w.read("results"))).orderBy(F.desc("weighted_issue_count"), "bucket"),
    "compare-runs": lambda w, a: ledger.run_diff(w.read("run_invoices").where(F.col("run_id") == a.baseline), w.read("run_invoices").where(F.col("run_id") == a.candidate)),
    "compare-benchmarks": lambda w, a: ledger.bucket_comparison(*[ledger.ledger(ledger.issues(w.read("run_invoices").where(F.col("run_id") == r))) for r in (a.baseline, a.candidate)]),
    "heal-rejections": lambda w, a: reports.healing_summary(w.read("results")),
    "attention": lambda w, a: reports.attention(w.read("results")),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Run one command."""
    p = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--workspace", required=True)
    p.add_argument("--input")
    p.add_argument("--family")
    p.add_argument("--target")
    p.add_argument("--hashes", nargs="*", default=[])
    p.add_argument("--baseline", type=int)
    p.add_argument("--candidate", type=int)
    p.add_argument("--limit", type=int, default=50)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("ledgerloom").getOrCreate()
    _show(COMMANDS[a.command](Workspace(spark, a.workspace), a), a)


if __name__ == "__main__":
    main()
