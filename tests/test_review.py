from pyspark.sql import functions as F

from ledgerloom.operators import review

RESULTS = "id long, invoice_path string, processed_at timestamp, route string, validation_passed boolean, validation_score double, error string, template_family_id string, fingerprint_hash string, reconciliation_failure boolean, policy_failure boolean, healing_reprocessed boolean, invoice_date string"


def table(spark):
    rows = [(1, "a", "APPLY", True, 1.0, None, "f", "h", False, False, None, None), (2, "b", "REJECTED", False, 0.4, None, "f", "h", True, False, None, "01/02/2024"), (3, "c", "REJECTED", False, 0.8, None, "g", "k", False, True, False, None), (4, "d", "ERROR", None, None, "boom", None, None, None, None, None, None), (5, "e", "REJECTED", False, 0.8, None, "f", "h", False, False, True, None)]
    df = spark.createDataFrame(rows, RESULTS.replace("processed_at timestamp, ", ""))
    return df.withColumn("processed_at", F.timestamp_seconds(F.col("id") * 100))


def test_status_and_signals(spark):
    got = {r.id: r for r in review.review_signals(review.display_status(table(spark))).collect()}
    assert [got[k].display_status for k in range(1, 6)] == ["accepted", "rejected", "rejected", "error", "rejected"]
    assert got[2].signals == ["low score", "ambiguous date", "does not add up"] and got[3].signals == ["below threshold", "policy"] and got[4].progress_bucket == "errors"


def test_review_invoices(spark):
    examples = spark.createDataFrame([(1, "f", "x"), (2, "f", "y"), (3, "f", "a"), (4, "g", "z")], "id long, template_family_id string, invoice_path string")
    existing = spark.createDataFrame([(p,) for p in "abexyz"], "invoice_path string")
    assert [r.invoice_path for r in review.review_invoices(table(spark), examples, existing, "f", 4).collect()] == ["e", "b", "a", "y"]


def test_detail_and_healing(spark):
    families = spark.createDataFrame([("f", 5, 0.99), ("g", 1, 0.99)], "template_family_id string, gt_apply_count long, gt_confidence double")
    prints = spark.createDataFrame([("h", "f", "x", 0.9, 1, "1", 0, 0.0), ("k", "g", "retired", 0.9, 1, "1", 9, 0.97)], "fingerprint_hash string, template_family_id string, status string, confidence double, apply_count long, created_at string, gt_apply_count long, gt_confidence double")
    examples = spark.createDataFrame([(1, "f", "x")], "id long, template_family_id string, invoice_path string")
    got = {r.template_family_id: r for r in review.family_detail(families, prints, table(spark), examples).collect()}
    assert (got["f"].members, got["f"].representative, got["f"].examples, got["f"].recent_accepted, got["f"].recent_rejected) == (1, "h", 1, 1, 2)
    assert got["g"].live_members == 0 and got["g"].representative is None
    assert {(r.id, r.authority) for r in review.healing_candidates(table(spark), families, prints).collect()} == {(2, "family"), (3, "fingerprint")}


def test_critical_hits(spark):
    f = spark.createDataFrame([("total", True, True, True), ("invoiceDate", True, False, False), ("tax", True, True, True)], "field string, expected boolean, found boolean, label_matched boolean")
    assert tuple(review.critical_hits(f).first()) == (0.5, 0.6667)
