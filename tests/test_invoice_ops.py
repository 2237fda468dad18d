"""Operators of pages, figures, families and runs on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import config
from ledgerloom.functions import classify as cl
from ledgerloom.functions import rules
from ledgerloom.functions.text import key_values
from ledgerloom.operators import diagnostics, lifecycle, profiles, reconcile, routing, store, truth
from ledgerloom.page import parties, rows, values
from ledgerloom.plans import invoice_catalogue
from ledgerloom.sources import files
from ledgerloom.sources.workspace import Workspace

TOKENS = "doc_id long, page_no int, token_seq long, text string, x long, y long, w long, h long, page_w long, page_h long"


def page(doc, lines):
    out = []
    for y, cells in lines:
        for x, text in cells:
            for w in text.split():
                out.append((doc, 0, len(out), w, x, y, 10 * len(w), 20, 1000, 1000))
                x += 10 * len(w) + 8
    return out


@pytest.fixture(scope="module")
def pages(spark):
    one = page(1, [(20, [(40, "Harbor Trading Ltd")]), (110, [(40, "12 Main Street")]), (200, [(40, "Bill To:"), (600, "Invoice No: HS-20417")]), (250, [(40, "Jordan Lee"), (600, "Date: 05/03/2024")]),
                   (400, [(40, "Description"), (400, "Qty"), (700, "Amount")]), (450, [(40, "1 Exam visit"), (700, "45.00")]), (700, [(600, "Subtotal"), (800, "45.00")]), (750, [(600, "Tax"), (800, "3.60")]), (800, [(600, "Total"), (800, "48.60")])])
    two = page(2, [(30, [(40, "Seller:"), (600, "Customer:")]), (80, [(40, "Widget Corp"), (600, "Ann Smith")]), (130, [(40, "5 High Road"), (600, "9 Low Road")])])
    t = rows.token_rows(spark.createDataFrame(one + two, TOKENS)).cache()
    return t, rows.row_texts(t).cache()


def test_blocks(pages):
    _, texts = pages
    got = {(r.doc_id, r.row_no): (r.row_class, r.block_no) for r in parties.row_blocks(texts).collect()}
    assert got[1, 0] == ("party", 0) and got[1, 4][0] == "table" and got[1, 6][0] == "summary"
    assert got[1, 6][1] <= got[1, 7][1]
    assert len({b for (d, _), (_, b) in got.items() if d == 1}) >= 4 and got[2, 0][1] == 0


def test_parties(pages):
    tokens, texts = pages
    got = {(r.doc_id, r.field): r.value for r in parties.parties(tokens).collect()}
    assert got[1, "sellerName"] == "Harbor Trading Ltd" and got[1, "customerName"] == "Jordan Lee"
    assert got[2, "sellerName"] == "Widget Corp" and got[2, "customerName"] == "Ann Smith"


def test_fallback_values(pages):
    tokens, texts = pages
    got = {(r.doc_id, r.field): r.value for r in values.fallback_values(tokens, texts).collect()}
    assert got[1, "invoiceDate"] == "05/03/2024" and got[1, "invoiceNumber"] == "HS-20417"
    assert (got[1, "subtotal"], got[1, "tax"], got[1, "total"]) == ("45.00", "3.60", "48.60") and (1, "dueDate") not in got
    assert not [k for k in got if k[0] == 2]


def test_label_neighbours(spark, pages):
    tokens, _ = pages
    labels = spark.createDataFrame([(1, 0, "Totl"), (1, 0, "zzzzzzz"), (1, 0, "")], "doc_id long, page_no int, label string")
    assert {r.label: r.text for r in values.label_neighbours(tokens, labels).collect()} == {"Totl": "48.60"}


def test_refined(spark):
    rows_ = [("d", "invoiceDate", "Date: 2024-01-05", "2024-01-06", ""), ("d", "total", "9.00", "Total 113.40", "$ 113.40 9.00"), ("d", "subtotal", "105.00", "105.00", ""), ("d", "tax", "8.40", "", ""), ("d", "invoiceNumber", "HS", "No HS-20417", "HS-20417"),
             ("e", "invoiceDate", "soon", "2024-01-06 or 2024-02-07", None), ("e", "total", None, None, None), ("e", "notes", "as it is", "x", "y")]
    got = {(r.doc_id, r.field): r.refined for r in values.refined(spark.createDataFrame(rows_, "doc_id string, field string, value string, region string, neighbour string")).collect()}
    assert got["d", "invoiceDate"] == "2024-01-06" and got["d", "total"] in ("113.40", "$ 113.40") and got["d", "subtotal"] == "105.00" and got["d", "tax"] == "8.40"
    assert got["d", "invoiceNumber"] == "HS-20417" and got["e", "invoiceDate"] == "soon" and got["e", "total"] is None and got["e", "notes"] == "as it is"


def test_names(spark):
    texts = ["Acme Acme Ltd", "| Smith | Widget Corp", "Tax Invoice Harbor Ltd a@b.com", "canada", None, "Global Group 4711 rest"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    got = cl.named(d, "t").orderBy("k").collect()
    assert [r["__long"] for r in got] == ["Acme Ltd", "Smith", "Harbor Ltd", "", "", "Global Group"] and got[1]["__short"] == "Smith"
    pairs = [("and Acme Ltd", "Bob", "Acme Ltd"), ("Ltd Smith", None, "Smith"), ("Ann and Bob Harbor", "Bob Harbor", "Ann and"), (None, "x", None), ("Corp", "x", "Corp")]
    p = spark.createDataFrame(pairs, "a string, b string, c string")
    assert all(r[0] == r[1] for r in p.select(cl.without_overlap(F.col("a"), F.col("b")), "c").collect())


def test_key_values(spark):
    text = "a: 1\nb: 2\na: 3\n: 4\nc:\n d : x: y\n" + "\n".join(f"k{i}: v" for i in range(500))
    got = spark.createDataFrame([(text,)], "t string").select(key_values(F.col("t"))).first()[0]
    assert {k: got[k] for k in ("a", "b", "d")} == {"a": "1", "b": "2", "d": "x: y"} and len(got) == 503


def test_summary_messages(spark):
    lines = spark.createDataFrame([("a", 1, "x", "1", "5", "5", None, None, None, None)], "doc_id string, line_no int, description string, quantity string, unit_price string, amount string, net_amount string, gross_amount string, tax_rate string, tax_amount string")
    inv = spark.createDataFrame([("a", 9.0, 1.0, 2.0, 13.0)], "doc_id string, subtotal double, tax double, shipping double, total double")
    r = reconcile.reconciled(inv, reconcile.normalized_lines(lines)).first()
    assert r.summary_errors == ["Subtotal mismatch: expected line sum 5.00, got 9.00", "Total mismatch: expected subtotal+tax+shipping 12.00, got 13.00"]
    assert [(p.field, p.kind, p.source) for p in r.provenance] == [("subtotal", "normalized", "scalar"), ("tax", "normalized", "scalar"), ("total", "normalized", "scalar")]
    c = F.col
    s = inv.select(reconcile.scalar_summary_errors(c("subtotal"), c("tax"), c("shipping"), c("total"), F.lit(8.0)), reconcile.scalar_summary_errors(c("subtotal"), c("tax"), c("shipping"), F.lit(12.0), F.lit(8.0))).first()
    assert [len(x) for x in s] == [2, 0]


def test_lines_stand_as_read(spark):
    kind = "doc_id string, line_no int, description string, quantity string, unit_price string, amount string, net_amount string, gross_amount string, tax_rate string, tax_amount string"
    lines = reconcile.normalized_lines(spark.createDataFrame([("a", 1, "x", "2", "5.00", "5.00", None, None, None, None), ("a", 2, "y", "1", "7.00", "7.00", None, None, None, None)], kind))
    assert sorted(r.amount for r in lines.collect()) == [7.0, 10.0]
    inv = reconcile.completed(spark.createDataFrame([("a", 12.0, 1.0, None, 13.0)], "doc_id string, subtotal double, tax double, shipping double, total double"), lines).cache()
    assert inv.first().lines_as_read and inv.first().subtotal == 12.0
    got = {r.line_no: (r.amount, r.amount_source) for r in reconcile.settled_lines(lines, inv).collect()}
    assert got == {1: (5.0, "summary_consistency"), 2: (7.0, "line_item")}


@pytest.mark.parametrize("threshold", [0.5, 0.55, 0.6, 0.7, 0.85, 0.95])
def test_prefixes_lose_no_pair(spark, threshold):
    sets = []
    for n in (20, 100, 180, 200, 220, 340):
        both = round(threshold * n)
        extra = (n - both) // 2
        shared = [f"{n}s{k}" for k in range(both)]
        sets += [(f"{n}a", shared + [f"{n}x{k}" for k in range(extra)]), (f"{n}b", shared + [f"{n}y{k}" for k in range(n - both - extra)])]
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= threshold}
    got = routing.similar_pairs(spark.createDataFrame(sets, "id string, tokens array<string>"), threshold).collect()
    assert {(r.left_id, r.right_id) for r in got} == want


def test_fuzzy_pairs_find_all(spark):
    r = random.Random(4)
    names = {"".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(150)} | {"thing", "things", "hting", ""}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    for k in (1, 2, 3):
        got = {(x.label, x.token, x.edits) for x in routing.fuzzy_pairs(spark.createDataFrame([(n,) for n in names], "name string"), "name", k).collect()}
        assert got == {(a, b, edits(a, b)) for a in names for b in names if a < b and edits(a, b) <= k}


def test_families_meet_by_region_alone(spark):
    regions = "struct<header:array<string>,identity:array<string>,summary:array<string>,footer:array<string>,generic:array<string>>"
    own = {"header": ["clinic"], "identity": ["no"], "summary": ["total"], "footer": ["bank"], "generic": ["x"]}
    d = spark.createDataFrame([("d", own, [], [], 1, "P", {"f": 1.0})], f"doc_id string, regions {regions}, roles array<string>, tokens array<string>, page_count int, provider_name string, alignment map<string,double>")
    f = spark.createDataFrame([("f", "established", 20, 0, 1.0, own, [], [], 1, "P", 0.0)], f"template_family_id string, status string, apply_count int, reject_count int, confidence double, regions {regions}, roles array<string>, tokens array<string>, page_count int, provider_name string, split_pressure double")
    assert [(r.template_family_id, r.family_score) for r in routing.family_matches(d, f).collect()] == [("f", 0.84)]
    with pytest.raises(ValueError, match="floor"):
        routing.family_matches(d, f, floor=0.5)
    assert sum((0.24, 0.16, 0.05, 0.08)) == pytest.approx(routing.APART) and sum(rules.REGION_WEIGHTS.values()) == pytest.approx(1.0)


def test_family_scores_equal_at_nine_digits_tie(spark):
    """0.75 of alignment less 0.06 for pages is 0.5 of alignment, but not in doubles; the first family wins, though it comes last."""
    regions = "struct<header:array<string>,identity:array<string>,summary:array<string>,footer:array<string>,generic:array<string>>"
    own = {"header": ["clinic"], "identity": ["no"], "summary": ["total"], "footer": ["bank"], "generic": ["x"]}
    d = spark.createDataFrame([("d", own, ["r"], ["t"], 1, "P", {"a": 0.75, "b": 0.5})], f"doc_id string, regions {regions}, roles array<string>, tokens array<string>, page_count int, provider_name string, alignment map<string,double>")
    rows = [(k, "established", 20, 0, 1.0, own, ["r"], ["t"], pages, "P", 0.0) for k, pages in (("b", 1), ("a", 5))]
    f = spark.createDataFrame(rows, f"template_family_id string, status string, apply_count int, reject_count int, confidence double, regions {regions}, roles array<string>, tokens array<string>, page_count int, provider_name string, split_pressure double")
    assert [tuple(r) for r in routing.family_matches(d, f).select("doc_id", "template_family_id", "family_score", "candidates").collect()] == [("d", "a", 0.93, 2)]


def test_merge_candidates_as_by_all_pairs(spark):
    """Also what only rounding lifts to the floor: 154 of 239 words is 0.83996."""
    r = random.Random(7)
    regions = "struct<header:array<string>,identity:array<string>,summary:array<string>,footer:array<string>,generic:array<string>>"
    some = lambda k, n: [x for x in (f"{k}{i}" for i in range(n)) if r.random() < 0.9]
    rows = [(f"{n:03}", "established", {"header": some(f"h{n % 9}_", 6), "identity": some("n", 2), "summary": some(f"s{n % 9}_", 4), "footer": some("total", 1), "generic": ["total", "date", None][: r.randint(0, 3)]}) for n in range(120)]
    rows += [("x", "established", {"header": [f"w{i}" for i in range(154)]}), ("y", "established", {"header": [f"w{i}" for i in range(239)]})]
    fixed = [F.array(F.lit("p")).alias("roles"), F.array(F.lit("t")).alias("fields"), *[F.lit("p").alias(c) for c in ("provider_name", "country_code", "document_family")], F.lit(1).alias("page_count"), F.lit(1).alias("apply_count"), F.lit(1).alias("reject_count"), F.lit(0.9).alias("confidence")]
    f = spark.createDataFrame(rows, f"template_family_id string, status string, regions {regions}").select("*", *fixed)
    a, b = (f.select(F.col("template_family_id").alias(i), F.struct(*[c for c in f.columns if c != "template_family_id"]).alias(s)) for i, s in (("target_id", "a"), ("source_id", "b")))
    want = a.crossJoin(b).where("target_id < source_id").select("source_id", "target_id", routing.merge_similarity(F.col("a"), F.col("b")).alias("similarity")).where("similarity >= 0.84")
    got = {tuple(x) for x in routing.merge_candidates(f).collect()}
    assert got == {tuple(x) for x in want.collect()} and ("y", "x", 0.84) in got and len(got) > 100


FAMILY = "template_family_id string, provider_name string, status string, apply_count long, reject_count long, confidence double"
PRINT = "fingerprint_hash string, template_family_id string, status string, apply_count long, reject_count long, confidence double"


def tables(spark):
    return {
        "families": spark.createDataFrame([("f", None, "established", 9, 0, 0.9), ("g", "G", "established", 5, 0, 1.0)], FAMILY),
        "fingerprints": spark.createDataFrame([("h1", "f", "established", 6, 0, 1.0), ("h2", "f", "provisional", 0, 4, 0.5), ("h3", "g", "established", 5, 0, 1.0)], PRINT),
        "results": spark.createDataFrame([("h1", "f", "a", True, "APPLY", 1.0), ("h2", "f", "b", False, "APPLY", 0.2), ("h3", "g", "c", True, "APPLY", 1.0)], "fingerprint_hash string, template_family_id string, invoice_path string, validation_passed boolean, route string, validation_score double"),
        "examples": spark.createDataFrame([(None, "f", "b"), ("h1", "f", "a"), ("h3", "g", "c")], "fingerprint_hash string, template_family_id string, invoice_path string"),
        "versions": spark.createDataFrame([("f", 4, "before", "t0")], "template_family_id string, version int, reason string, at string"),
    }


def test_split(spark):
    t = tables(spark)
    done = lifecycle.split_out(t, "f", spark.createDataFrame([("h2",)], "fingerprint_hash string"), "f-split-1", F.lit("t1"))
    f = {r.template_family_id: r for r in done["families"].collect()}
    assert f["f-split-1"].status == "degraded" and f["f-split-1"].reject_count == 4 and f["f"].reject_count == 0 and f["f"].status == "established" and f["g"].apply_count == 5
    assert {r.fingerprint_hash: r.template_family_id for r in done["results"].collect()} == {"h1": "f", "h2": "f-split-1", "h3": "g"}
    assert {r.invoice_path: r.template_family_id for r in done["examples"].collect()} == {"a": "f", "b": "f-split-1", "c": "g"}
    assert sorted((r.template_family_id, r.version) for r in done["versions"].collect()) == [("f", 4), ("f", 5), ("f", 6), ("f-split-1", 1)]
    for hashes in ([("h1",), ("h2",)], [("h3",)]):
        with pytest.raises(ValueError, match="members"):
            lifecycle.split_out(t, "f", spark.createDataFrame(hashes, "fingerprint_hash string"), "new", F.lit("t"))


def test_merge(spark):
    done = lifecycle.merged_into(tables(spark), "g", "f", F.lit("t1"))
    f = {r.template_family_id: r for r in done["families"].collect()}
    assert f["g"].status == "retired" and f["f"].provider_name == "G" and f["f"].apply_count == 11 and f["f"].reject_count == 4
    assert {r.template_family_id for r in done["fingerprints"].collect()} == {"f"} == {r.template_family_id for r in done["results"].collect()} == {r.template_family_id for r in done["examples"].collect()}
    assert done["versions"].count() == 5
    with pytest.raises(ValueError, match="differ"):
        lifecycle.merged_into(tables(spark), "f", "f", F.lit("t"))


def test_profiles(spark):
    a, b = '{"ocr":{"field_buffer_multipliers":{"date":1.0,"qty":2.0}},"table":{"enabled":true}}', '{"ocr":{"region_buffer_multiplier":1.5,"field_buffer_multipliers":{"date":1.3}},"table":{"ocr_engine":" x "}}'
    d = spark.createDataFrame([(a, b), (None, b)], "a string, b string").select(profiles.merged(profiles.read_profile(F.col("a")), profiles.read_profile(F.col("b"))).alias("m"))
    one, two = d.collect()
    assert one.m.ocr.field_buffer_multipliers == {"date": 1.3, "qty": 2.0} and one.m.ocr.region_buffer_multiplier == 1.5 and one.m.table.enabled and two.m.table.enabled is None
    s = d.select(profiles.summary(F.col("m")).alias("s"), profiles.table_settings(F.col("m")).alias("t")).first()
    assert s.s.table_enabled and s.s.field_override_count == 0 and s.t.ocr_engine == "x" and s.t.row_gap_multiplier == 1.5
    fields = spark.createDataFrame([("t", 0, "total", "currency"), ("t", 1, "total", "string")], "template_id string, page_no int, field string, field_type string")
    built = profiles.template_profiles(fields, spark.createDataFrame([("t", 0, True, True)], "template_id string, page_no int, has_table boolean, scanned boolean")).first().profile
    assert built.ocr.field_type_overrides == {"total": "string"} and built.table.row_gap_multiplier == 1.25 and built.ocr.region_buffer_multiplier == 1.15
    fam = d.limit(1).select(F.lit("f").alias("template_family_id"), F.lit("old").alias("provider_name"), F.lit("provisional").alias("status"), F.col("m").alias("profile"))
    done, versions = profiles.updated(fam, fam.select("template_family_id", F.lit(None).cast("string").alias("provider_name"), F.lit("established").alias("status"), F.lit(None).cast(fam.schema["profile"].dataType).alias("profile")), F.lit("now"))
    assert (done.first().provider_name, done.first().status) == ("old", "established") and versions.first().reason == "manual_update"


def test_replace_survives_a_crash(spark, tmp_path, monkeypatch):
    at = f"{tmp_path}/t"
    store.append(spark.createDataFrame([(1,)], "k int"), at)
    read = lambda: sorted(r.k for r in spark.read.parquet(store.current(spark, at)).collect())
    store.replace(spark.read.parquet(at).withColumn("k", F.col("k") + 1), at)
    assert read() == [2]
    spark.createDataFrame([(99,)], "k int").write.parquet(f"{at}/data-torn")  # what a crash leaves: a version that no marker names
    assert read() == [2]
    store.append(spark.createDataFrame([(3,)], "k int"), at)
    assert read() == [2, 3]
    store.replace(spark.read.parquet(store.current(spark, at)).where("k = 3"), at)
    assert read() == [3]


def test_workspace_runs_and_variants(spark, tmp_path):
    w = Workspace(spark, str(tmp_path))
    r = spark.createDataFrame([(1, "f", "a", True, None), (2, None, "b", False, "bad")], "id long, template_family_id string, invoice_name string, validation_passed boolean, error string")
    w.append("results", r)
    ids = {w.record_run(w.read("results"), "d"), w.record_run(w.read("results"), "d")}
    assert len(ids) == 2 and {(x.total_invoices, x.accepted, x.rejected, x.errors) for x in w.read("runs").collect()} == {(2, 1, 1, 1)} and w.read("run_invoices").count() == 4
    other = w.isolated("variant")
    assert other.read("results").count() == 0
    w.copy_family("f", other)
    assert [x.invoice_name for x in other.read("results").collect()] == ["a"]
    w.delete("results", "id", [1])
    assert [x.id for x in w.read("results").collect()] == [2]


def test_sources_and_environment(spark, tmp_path):
    assert files.documents(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(FileNotFoundError):
        files.dataset_path("none", str(tmp_path), must_exist=True)
    with pytest.raises(ValueError, match="LEDGERLOOM_DATABASE_URL"):
        config.environment({})
    assert config.environment({"LEDGERLOOM_DATABASE_URL": " x "}) == {"database_url": "x"}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"vendor": "V", "Total": "5"}')
    assert files.canonical_records(spark, f"{tmp_path}/r").first().record.fields["totalAmount"] == "5.0"


def test_truth_records(spark):
    texts = ['{"document":{"seller":null},"vendor":"V","line_items":[{"index":7,"qty":"x"},3]}', '{"foo":1}', "[1]", None, '{"summary":{}}']
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(truth.normalized_truth(F.col("t"))).collect()]
    assert got[0].fields["sellerName"] is None and [(x["index"], x.fields["quantity"]) for x in got[0].lines] == [(7, None)]
    assert got[1] is None and got[2] is None and got[3] is None and got[4].lines == []


def test_events_and_errors(spark):
    r = spark.createDataFrame([(1, "h", "f", "APPLY", True, None, 1.0, True), (2, "h", "f", "APPLY", False, None, 0.1, None), (3, "i", "f", "DISCOVERY", False, None, 0.1, None), (4, "h", None, "APPLY", True, "bad", 1.0, None)], "id long, fingerprint_hash string, template_family_id string, attempted_route string, validation_passed boolean, error string, validation_score double, has_truth boolean")
    got = sorted((e.key, e.seq, e.event, e.checked) for e in diagnostics.outcome_events(r).collect())
    assert got == [("f", 1, "apply", True), ("f", 2, "reject", False), ("h", 1, "apply", True), ("h", 2, "reject", False)]
    x = spark.createDataFrame([("1",), ("x",)], "t string")
    n = F.col("t").try_cast("int")
    assert {(e.t, e.value, e.error) for e in diagnostics.captured(x, n, F.when(n.isNull(), "no number")).collect()} == {("1", 1, None), ("x", None, "no number")}


def test_rows_over_many_pages_and_batches(spark):
    made = [t for k in range(300) for t in page(k, [(10, [(40, "a b c")]), (12, [(200, "d")]), (200, [(40, "e f")])])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows.token_rows(spark.createDataFrame(made, TOKENS).repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1800 and {(r.doc_id, r.text): (r.row_no, r.place) for r in got} == {(k, w): p for k in range(300) for w, p in zip("abcdef", [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)], strict=True)}


def test_catalogue_has_both(spark):
    assert {"invoice_ladder", "row_classifier", "run_summary", "token_rows"} <= set(invoice_catalogue.QUERIES)
