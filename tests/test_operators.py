import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import history, ledger, lifecycle, reconcile, reports, routing, store, truth, validate
from ledgerloom.plans import catalogue
from ledgerloom.sources import scratch

LINES = "doc_id string, line_no int, description string, quantity string, unit_price string, amount string, net_amount string, gross_amount string, tax_rate string, tax_amount string"


def test_reconciliation(spark):
    lines = spark.createDataFrame(
        [("a", 1, "Exam  visit", "1", "45.00", "45.00", None, None, None, None), ("a", 2, "Lab", "2", "30.00", None, None, None, None, None), ("b", 1, "x", "1", "5", "5", None, None, None, None), ("c", 1, "y", None, None, None, None, "12.10", "21%", None)], LINES
    )
    inv = spark.createDataFrame([("a", None, 8.4, None, 113.4), ("b", 9.0, 1.0, None, 10.0), ("c", None, None, None, None), ("d", None, None, None, None), ("e", None, None, None, 7.0)], "doc_id string, subtotal double, tax double, shipping double, total double")
    norm = reconcile.normalized_lines(lines)
    by = {(r.doc_id, r.line_no): r for r in norm.collect()}
    assert by["a", 2].amount == 60.0 and by["a", 1].category == "consultation" and by["a", 1].description == "Exam visit"
    assert (by["c", 1].net_amount, by["c", 1].tax_amount, by["c", 1].amount) == (10.0, 2.1, 10.0)
    got = {r.doc_id: r for r in reconcile.reconciled(inv, norm).collect()}
    assert got["a"].subtotal == 105.0 and got["a"].status == "reconciled" and got["a"].issue_types == [] and got["a"].derived_fields == ["subtotal"]
    assert got["b"].status == "inconsistent" and got["b"].issue_types == ["subtotal_mismatch"]
    assert got["c"].total == 12.1 and got["d"].status == "unavailable" and got["e"].status == "partial"
    wrong = reconcile.line_mismatches(spark.createDataFrame([("a", 1, "2", "3.00", "7.00"), ("a", 2, "2", "3.00", "6.01"), ("a", 3, None, "3", "4")], "doc_id string, line_no int, quantity string, unit_price string, amount string")).collect()
    assert [r.error for r in wrong] == ["Line item arithmetic mismatch at row 1: expected 6.00, got 7.00"]


def test_line_arithmetic_check_on_the_edge_of_its_tolerance(spark, tmp_path):
    """Amounts of 0.02 more and less than the product are wrong, 0.01 are not; in doubles some of the former seem nearer."""
    parts = [(k, 900.0 + k / 10) for k in range(200)]
    lines = [(k, n + 1, k, 1, 3.0, round(2700 + 3 * k / 10 + off, 2)) for k, _ in parts for n, off in enumerate((-0.02, -0.01, 0.0, 0.01, 0.02))]
    spark.createDataFrame(parts, "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.l_orderkey, r.l_linenumber) for r in catalogue.line_arithmetic_check(spark, str(tmp_path)).collect()}
    assert got == {(k, n) for k, _ in parts for n in (1, 5)}


def test_ngram_phrases_stay_in_their_rows(spark, tmp_path):
    texts = ["a b a b a b", "a", "", " ", None, "x  x  x", " ".join(f"w{k % 7}" for k in range(3000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.ngram_phrases(spark, str(tmp_path))
    runs = {(k, n): [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] for k, t in enumerate(texts) if t is not None for w in [t.split(" ")] for n in range(1, 5)}
    assert {tuple(r) for r in got.collect()} == {(k, n, len(x), len(set(x))) for (k, n), x in runs.items() if x}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_validation(spark):
    found = spark.createDataFrame([("a", "total", "$10.00"), ("a", "customerName", "Jordan  LEE"), ("a", "notes", "net thirty days"), ("a", "invoiceDate", "03/05/2024"), ("a", "quantity", "2.0001")], "doc_id string, field string, value string")
    gt = spark.createDataFrame([("a", "total", "10"), ("a", "customerName", "Jordan Lee"), ("a", "notes", "thirty days net"), ("a", "invoiceDate", "2024-05-03"), ("a", "quantity", "2"), ("a", "number", "7"), ("a", "none", None)], "doc_id string, field string, value string")
    docs = spark.createDataFrame([("a", "FR", "EUR", 10, 7)], "doc_id string, country_code string, currency_code string, truth_lines int, found_lines int")
    r = validate.validated(found, gt, docs).first()
    assert (r.matched, r.mismatched) == (5, 3) and not r.passed and abs(r.score - 5 / 8) < 1e-9
    assert r.error_counts == {"missing_field": 1, "line_item_count_mismatch": 1, "other": 1}
    docs = docs.withColumns({"found_lines": F.lit(9), "country_code": F.lit("CA"), "currency_code": F.lit("CAD")})
    r = validate.validated(found, gt.where("field NOT IN ('number')"), docs).first()
    assert (r.matched, r.mismatched, r.passed) == (15, 0, True)
    mapped = validate.renamed_fields(found.withColumn("seq", F.lit(1)), {"notes": "remarks"})
    assert "remarks" in {x.field for x in mapped.collect()}


def test_ledger(spark):
    inv = spark.createDataFrame(
        [("i1", "ERROR", "ERROR", None, None, ["runtime error"]), ("i2", "APPLY", "x", False, 0.9, ["Missing extracted field: total", "Missing extracted field: total"]), ("i3", "APPLY", "x", True, 1.0, ["ignored"]), ("i4", "APPLY", "x", False, None, None)],
        "invoice_name string, route string, status string, validation_passed boolean, validation_score double, validation_errors array<string>",
    )
    items = ledger.issues(inv)
    got = {r.bucket: r for r in ledger.ledger(items).collect()}
    assert got["runtime_error"].weighted_issue_count == 3.125 and got["summary_amount_resolution"].issue_count == 2 and got["summary_amount_resolution"].invoices == 1
    assert got["scalar_reconciliation"].categories == "other=1"
    after = ledger.ledger(items.where("bucket = 'scalar_reconciliation'"))
    p = ledger.benchmark_progress(ledger.ledger(items), after).first()
    assert p.baseline_weight == 6.075 and p.candidate_weight == 0.95 and p.target_met and p.progress == 1.0 and p.remaining_weight == 0.0
    assert {(r.bucket, r.count_delta) for r in ledger.bucket_comparison(ledger.ledger(items), after).collect()} == {("runtime_error", -1), ("summary_amount_resolution", -2), ("scalar_reconciliation", 0)}
    assert ledger.pseudo_issues(spark.createDataFrame([("s", "failed_total", 3)], "invoice_name string, category_name string, n long")).count() == 3


def test_lifecycle_transitions(spark):
    s = lifecycle.State()
    for _ in range(5):
        s.on("apply", 1.0, True, False)
    assert (s.status, s.apply_count, s.gt_apply_count, s.gt_confidence) == ("established", 5, 5, 1.0)
    s = lifecycle.State()
    s.on("reject", 0, False, False)
    assert s.status == "degraded"
    for _ in range(6):
        s.on("apply", 1.0, False, False)
    assert s.status == "degraded"  # only a family rises again
    f = lifecycle.State(status="degraded", reject_count=1)
    for _ in range(5):
        f.on("apply", 1.0, False, True)
    assert f.status == "established"
    f = lifecycle.State(status="established", confidence=0.8, apply_count=9, reject_count=2)
    f.on("reject", 0, True, True)
    assert f.status == "degraded" and f.gt_reject_count == 1
    events = spark.createDataFrame([("k", i, "apply", 1.0, True) for i in (5, 3, 1, 2, 4)] + [("z", 9, "reject", None, False)], "key string, seq long, event string, score double, checked boolean")
    got = {r.key: r for r in lifecycle.latest_states(lifecycle.folded(events)).collect()}
    assert got["k"].status == "established" and got["k"].seq == 5 and got["z"].status == "degraded"


def families(spark):
    regions = lambda *xs: {"header": list(xs), "identity": ["inv"], "summary": ["total"], "footer": [], "generic": [*xs, "inv", "total"]}
    rows = [("f1", "established", 9, 1, 0.97, regions("clinic", "harbor"), ["header_page"], ["a", "b"], ["clinic", "total"], 1, "Harbor", "US", "invoice", None), ("f2", "provisional", 1, 0, 0.9, regions("clinic", "harbor"), ["header_page"], ["a", "b"], ["clinic", "total"], 1, "Harbor", "US", "invoice", None),
            ("f3", "retired", 1, 0, 0.9, regions("clinic"), ["header_page"], ["a"], ["clinic"], 1, None, None, None, None), ("f4", "established", 2, 0, 0.9, regions("other"), ["line_item_page"], ["z"], ["zz"], 3, "Else", "CA", "invoice", None)]
    kind = "template_family_id string, status string, apply_count long, reject_count long, confidence double, regions struct<header:array<string>,identity:array<string>,summary:array<string>,footer:array<string>,generic:array<string>>, roles array<string>, fields array<string>, tokens array<string>, page_count int, provider_name string, country_code string, document_family string, split_pressure double"
    return spark.createDataFrame(rows, kind)


def test_families(spark):
    f = families(spark)
    d = f.where("template_family_id = 'f1'").select(F.lit("d").alias("doc_id"), "regions", "roles", "tokens", "page_count", F.lit("harbor").alias("provider_name"), F.create_map(F.lit("f1"), F.lit(1.0)).alias("alignment"))
    got = routing.family_matches(d, f).collect()
    assert [(r.doc_id, r.template_family_id, r.family_status) for r in got] == [("d", "f1", "established")] and got[0].candidates == 2 and got[0].family_score > 0.9
    pairs = routing.merge_candidates(f).collect()
    assert [(r.source_id, r.target_id) for r in pairs] == [("f2", "f1")] and pairs[0].similarity == 1.0
    t = reports.family_triage(f.withColumn("field_override_count", F.lit(0)))
    assert {r.template_family_id: r.triage_class for r in t.collect()}["f1"] == "stable"
    retired = lifecycle.retirements(f, spark.createDataFrame([("f1", "established"), ("f2", "retired")], "template_family_id string, status string"))
    assert {(r.template_family_id, r.reason) for r in retired.collect()} == {("f2", "orphaned"), ("f4", "orphaned")}


def test_fingerprints(spark):
    pages = spark.createDataFrame([("d", 0, 2, "00000000000000ff"), ("d", 1, 2, "0000000000000000"), ("e", 0, 1, "ffffffffffffffff")], "doc_id string, page_no int, page_count int, visual_hash string")
    known = spark.createDataFrame([("h1", 0, 2, "00000000000000fe"), ("h1", 1, 2, "0000000000000001"), ("h2", 0, 2, "00000000000000ff"), ("h2", 1, 2, "ffffffffffffffff"), ("h3", 0, 1, "ffffffffffffffff")], "fingerprint_hash string, page_no int, page_count int, visual_hash string")
    near = routing.near_fingerprints(pages, known)
    assert {tuple(r) for r in near.collect()} == {("d", "h1", 2), ("e", "h3", 0)}
    labels = spark.createDataFrame([("d", "h1", 0, 0, "Total", 0.5, 0.5), ("d", "h1", 0, 1, "Date", 0.1, 0.1), ("d", "h1", 0, 2, None, 0.1, 0.1)], "doc_id string, fingerprint_hash string, page_no int, label_no int, label_text string, cx double, cy double")
    tokens = spark.createDataFrame([("d", 0, "totai", 0.54, 0.46), ("d", 0, "Date", 0.3, 0.1)], "doc_id string, page_no int, text string, cx double, cy double")
    assert [tuple(r) for r in routing.confirmed_labels(labels, tokens).collect()] == [("d", "h1", 3, 1)]
    assert [tuple(r) for r in routing.best_fingerprint(near, routing.confirmed_labels(labels, tokens)).collect()] == [("e", "h3", 0)]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_similar_pairs_find_all(spark, threshold):
    r = random.Random(3)
    rows = [(k, r.sample("abcdefghijklmn", r.randint(0, 6))) for k in range(60)]
    got = {(x.left_id, x.right_id) for x in routing.similar_pairs(spark.createDataFrame(rows, "id long, tokens array<string>"), threshold).collect()}
    want = {(i, j) for i, a in rows for j, b in rows if i < j and a and b and len({*a} & {*b}) / len({*a} | {*b}) >= threshold}
    assert got == want


def test_store(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, v string")
    u = spark.createDataFrame([("a", 5, None), ("c", 3, "z"), ("c", 4, "w")], "k string, n int, v string")
    assert sorted(map(tuple, store.upserted(t, u, ["k"], ["n"]).collect()), key=str) == [("a", 5, None), ("b", 2, "y"), ("c", 4, "w")]
    assert sorted(map(tuple, store.patched(t, u.where("k = 'a'"), ["k"], ["n", "v"]).collect())) == [("a", 5, "x"), ("b", 2, "y")]
    stay, history_ = store.archived(t, t.limit(0).withColumn("valid_to", F.lit("")), F.col("n") > 1, F.lit("now"))
    assert stay.count() == 1 and history_.first().valid_to == "now"
    f = spark.createDataFrame([("f", "h1", 0.9, 1, "2024", "retired"), ("f", "h2", 0.8, 5, "2024", "x"), ("f", "h3", 0.8, 5, "2023", "x")], "template_family_id string, fingerprint_hash string, confidence double, apply_count int, created_at string, status string")
    assert store.representative(f).first().fingerprint_hash == "h3"


def test_split_signals_and_clusters(spark):
    kind = "template_family_id string, fingerprint_hash string, page_roles array<string>, field_names array<string>, anchor_tokens array<string>, confidence double, apply_count int, created_at string, status string, reject_count int"
    f = spark.createDataFrame([("f", "a", ["h"], ["x", "y"], ["t", "u"], 0.9, 3, "1", "established", 0), ("f", "b", ["h"], ["y", "x"], ["u", "t"], 0.8, 3, "1", "established", 0), ("f", "c", ["l"], ["q"], ["r"], 0.7, 3, "1", "provisional", 1)], kind)
    s = lifecycle.split_signals(f).first()
    assert (s.member_count, s.unique_signature_count, s.dominant_signature_count) == (3, 2, 2) and s.split_pressure == round(1 - 2 / 3, 4)
    assert {(r.fingerprint_hash, r.cluster) for r in lifecycle.split_clusters(f).collect()} == {("a", 0), ("b", 0), ("c", 1)}
    assert lifecycle.rebuilt_family(f, spark.createDataFrame([], "template_family_id string, validation_passed boolean, route string, validation_score double")).first().representative == "a"


def leaders_by_hand(rows, threshold=0.72):
    """The reference's clustering, every member with every leader."""
    share = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    leaders, got = {}, {}
    for r in sorted(rows, key=lambda r: (r.template_family_id, -r.confidence, -r.apply_count, r.created_at, r.fingerprint_hash)):
        own = {k: {x for x in r[k] or () if x} for k in ("anchor_tokens", "field_names", "page_roles")} | {"t": bool(r.table_enabled), "m": (r.page_count or 0) > 1}
        best, score = None, 0.0
        for n, o in enumerate(leaders.setdefault(r.template_family_id, [])):
            s = round(share(own["anchor_tokens"], o["anchor_tokens"]) * 0.40 + share(own["field_names"], o["field_names"]) * 0.35 + share(own["page_roles"], o["page_roles"]) * 0.15 + 0.05 * (own["t"] == o["t"]) + 0.05 * (own["m"] == o["m"]), 3)
            if s > score:
                best, score = n, s
        if best is None or score < threshold:
            best = len(leaders[r.template_family_id])
            leaders[r.template_family_id].append(own)
        got[r.template_family_id, r.fingerprint_hash] = best
    return got


def test_clusters_as_by_hand(spark):
    r = random.Random(3)
    some = lambda base, p: sorted({x for x in base if r.random() < p} | {f"w{r.randint(0, 99)}"})
    bases = [[f"{k}-{i}" for i in range(r.randint(3, 25))] for k in range(4)]
    rows = []
    for k in range(240):
        a, f = r.choice(bases), r.choice(bases)
        rows.append(("f" if k % 3 else "g", f"h{k}", r.choice([["x"], ["x", "y"], [], None]), some(f, 0.9), some(a, r.choice([0.7, 0.95])) if k % 17 else [], r.random(), k % 5, k, k % 2 == 0, r.choice([1, 2])))
    f = spark.createDataFrame(rows, "template_family_id string, fingerprint_hash string, page_roles array<string>, field_names array<string>, anchor_tokens array<string>, confidence double, apply_count int, created_at int, table_enabled boolean, page_count int")
    for threshold in (0.72, 0.5, 0.2):
        got = {(x.template_family_id, x.fingerprint_hash): x.cluster for x in lifecycle.split_clusters(f, threshold).collect()}
        assert got == leaders_by_hand(f.collect(), threshold) and len(set(got.values())) > 2
    texts = f.withColumn("field_names", F.col("anchor_tokens"))
    assert {(x.template_family_id, x.fingerprint_hash): x.cluster for x in lifecycle.split_clusters(texts).collect()} == leaders_by_hand(texts.collect())


def test_leader_clusters_reads_whole_texts(spark, tmp_path):
    head = " ".join(f"a{k:02}" for k in range(120))
    docs = [(k, f"{head} " + " ".join(f"{end}{k:03}" for k in range(400)), "en", "s") for k, end in enumerate(("x", "x", "y"))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.fingerprint_hash: r.cluster for r in catalogue.leader_clusters(spark, str(tmp_path)).collect()}
    assert got["0"] == got["1"] != got["2"]


def test_jaccard_links_as_by_hand(spark, tmp_path):
    r = random.Random(5)
    bases = [[f"{k}w{i}" for i in range(r.randint(1, 40))] + ["the", "of", "and"] for k in range(8)]
    texts = [" ".join(sorted(x for x in r.choice(bases) if r.random() < r.choice([0.9, 0.97, 1.0]))) for _ in range(300)] + ["", None, "  ", "a", "A"]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {k: frozenset((t or "").lower().split()) for k, t in docs}
    near = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.8
    want = {k: (min((j for j, b in sets.items() if b == a), default=None) if a else None, sum(near(a, b) for j, b in sets.items() if j != k)) for k, a in sets.items()}
    assert {x.id: (x.class_id, x.links) for x in catalogue.jaccard_links(spark, str(tmp_path)).collect()} == want
    assert sum(n for _, n in want.values()) > 500


def test_similar_classes_drops_long_unlike_sets_by_parities(spark, monkeypatch):
    r = random.Random(6)
    rows = [(k, [f"w{i}" for i in r.sample(range(4000), 2000)]) for k in range(40)] + [(50, [None, "a"]), (51, ["a", None, None]), (52, [])]
    made, write = {}, scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, name: made.setdefault(name, write(df, name)))
    got = {x.id: (x.class_id, x.links) for x in routing.similar_classes(spark.createDataFrame(rows, "id long, tokens array<string>"), 0.8).collect()}
    assert made["met"].count() == 0  # each pair would have carried 4,000 words
    assert got == {k: (k, 0) for k in range(40)} | {50: (50, 1), 51: (50, 1), 52: (None, 0)}


def test_similar_classes_sends_a_set_once_to_a_cell(spark, monkeypatch):
    sets = {k: frozenset(f"w{i}" for i in range(60) if i != k) for k in range(60)} | {60 + k: frozenset(f"v{k % 3}x{i}" for i in range(9 + k // 3)) for k in range(12)}
    data = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, tokens array<string>")
    want = {k: sum(len(a & b) / len(a | b) >= 0.8 for j, b in sets.items() if j != k) for k, a in sets.items()}
    for size in (512, 16, 1):
        monkeypatch.setattr(routing, "CELL", size)
        assert {x.id: x.links for x in routing.similar_classes(data, 0.8).collect()} == want
    pairs = spark.createDataFrame([(a, b) for a in range(60) for b in range(a)], "right_id long, left_id long")
    monkeypatch.setattr(routing, "CELL", 512)
    assert routing._celled(pairs).select("cell").distinct().count() == 1  # 60 texts travel, not 1,770 pairs of them


def test_hamming_nearest_all_as_by_hand(spark, tmp_path):
    texts = [f"text {k % 97 if k % 3 else k} " + "x" * (k % 11) for k in range(900)] + [None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    h = {k: hashlib.md5(t.encode()).hexdigest()[:16] for k, t in enumerate(texts) if t is not None}
    far = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    want = {k: min((far(x, y), y) for j, y in h.items() if j != k) for k, x in h.items() if k % 20 == 0}
    assert {r.doc_id: (r.total_distance, r.fingerprint_hash) for r in catalogue.hamming_nearest_all(spark, str(tmp_path)).collect()} == want
    q = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", F.substring(F.md5("text"), 1, 16).alias("visual_hash"))
    assert {r.doc_id: (r.total_distance, r.fingerprint_hash) for r in routing.nearest_hashes(q.where("doc_id % 20 = 0"), q, block=8).collect()} == want


def test_truth(spark):
    rows = spark.createDataFrame([("d", "Invoice No", "7"), ("d", "TOTAL", "$1,200.50"), ("d", "Amount Due", "9"), ("d", "VAT", "n/a"), ("d", "odd", "x")], "doc_id string, name string, value string")
    got = {r.field: r.annotation for r in truth.upgraded(rows).collect()}
    assert got["total"].value == "1200.5" and got["invoiceNumber"].status == "present" and got["tax"].status == "unclear" and set(got) == {"invoiceNumber", "total", "tax"}
    one = spark.createDataFrame([(("derived", "5"),), (("present", "6"),), ((None, "7"),)], "a struct<status:string,value:string>")
    assert [r[0] for r in one.select(truth.canonical(F.col("a"))).collect()] == [None, "6", "7"]
    stems = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "stem string")
    local = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", "1")], "stem string, content string")
    source = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "stem string, content string")
    assert {tuple(r) for r in truth.sync_audit(stems, local, source).collect()} == {("a", "match"), ("b", "mismatch"), ("c", "missing_local"), ("d", "missing_source")}
    assert {(r.stem, r.action) for r in truth.sync_changes(local, source).collect()} == {("a", "unchanged"), ("b", "updated"), ("c", "copied")}


def test_tokens(spark):
    t = spark.createDataFrame([(1, 0, "$1"), (1, 1, "234.56"), (1, 2, "x")], "d int, s int, t string")
    assert [r.t for r in history.merged_tokens(t, ["d"], "s", "t").orderBy("s").collect()] == ["$1234.56", "x"]


def test_providers(spark):
    docs = spark.createDataFrame([(1, "visit harbor street animal clinic"), (2, "harbor animal place clinic"), (3, "none")], "doc_id int, text string")
    aliases = spark.createDataFrame([(0, "H", "Harbor Street Animal Clinic"), (1, "P", "place")], "provider_no int, provider_name string, alias string")
    assert {tuple(r) for r in routing.resolved_providers(docs, aliases).collect()} == {(1, "H", 1.0), (2, "P", 1.0)}
