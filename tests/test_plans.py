import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom import cli, config
from ledgerloom.functions import labels
from ledgerloom.operators import reports
from ledgerloom.page import discovery, fields, rows, tables
from ledgerloom.plans import catalogue, process
from ledgerloom.sources import files
from ledgerloom.sources.workspace import Workspace
from ledgerloom.streaming import jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return float(v) if v.__class__.__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    r = duck.execute(catalogue.ORACLE_SQL[name])
    named = [x[0] for x in r.description]
    assert sorted(named) == cols
    assert got == sorted(repr(tuple(plain(row[named.index(c)]) for c in cols)) for row in r.fetchall())


def test_rollup_of_all_results(spark):
    kept = catalogue.results(spark, SF).drop("template_family_id").join(catalogue.table(spark, SF, "orders").selectExpr("o_orderkey AS id", "o_custkey AS template_family_id"), "id")
    want = {r.template_family_id: r.n for r in kept.where("template_family_id % 4 != 3 AND validation_passed").groupBy("template_family_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r.template_family_id: r.apply_count for r in catalogue.weighted_confidence_rollup(spark, SF).collect()}
    assert want and all(got[k] >= n for k, n in want.items())


def test_keywords_and_header_words_are_whole(spark):
    got = {r.group: r["values"].split(",") for r in catalogue.anchor_keyword_sets(spark, SF).collect()}
    words = catalogue.table(spark, SF, "documents").select("source", F.explode(F.split(F.lower("text"), " ")).alias("w")).where(F.col("w").isin(*catalogue.TERMS)).distinct().collect()
    assert got == {g: sorted(r.w for r in words if r.source == g) for g in {r.source for r in words}} and max(map(len, got.values())) > 4
    assert any(len(w) <= 12 for r in catalogue.page_header_tokens(spark, SF).limit(20).collect() for w in (r.header or "x" * 13).split(","))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_reports_shuffle_partial_sums(spark):
    plan = reports.run_summary(catalogue.results(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan and "Python" not in plan


INVOICE = "Harbor Street Animal Clinic\nInvoice Number: HS-2041\nInvoice Date: 03/05/2024\nUSD\nRecheck visit 1 45.00 45.00\nBlood test 2 30.00 60.00\nSubtotal: 105.00\nTax: 8.40\nTotal: 113.40"


def test_text_invoice(spark):
    pages = spark.createDataFrame([("a", 0, INVOICE), ("b", 0, INVOICE.replace("Total: 113.40", "Total: 999.00"))], "doc_id string, page_no int, text string")
    got = {r.doc_id: r for r in process.normalized(pages).collect()}
    assert got["a"].status == "reconciled" and got["a"].line_sum == 105.0 and got["b"].status == "inconsistent" and got["b"].issue_types == ["total_mismatch"]
    truth = spark.createDataFrame([(d, f, v) for d in "ab" for f, v in (("invoice_number", "HS-2041"), ("total", "113.40"), ("invoice_date", "2024-03-05"))], "doc_id string, field string, value string")
    v = {r.doc_id: r for r in process.validated(pages, truth, spark.createDataFrame([("a", 2), ("b", 2)], "doc_id string, truth_lines int")).collect()}
    assert v["a"].passed and v["a"].matched == 5 and not v["b"].passed and v["b"].error_counts == {"field_mismatch": 1}
    assert process.context(pages).where("doc_id = 'a'").first().currency_code == "USD"
    assert process.normalized(files.demo(spark)).first().total == 113.4


def page(spark, lines, doc=1):
    out, seq = [], 0
    for r, line in enumerate(lines):
        x = 20
        for word in line.split(" "):
            if word:
                out.append((doc, 0, seq, word, x, 20 + 40 * r + seq % 3, 10 * len(word), 20, 1000, 1000))
                seq += 1
            x += 10 * len(word) + 10
    return spark.createDataFrame(out, "doc_id long, page_no int, token_seq long, text string, x long, y long, w long, h long, page_w long, page_h long")


LINES = ["Harbor Clinic", "Invoice No: HS-2041", "Date: 2024-03-05", "Description Qty Price Amount", "Recheck visit 1 45.00 45.00", "with notes", "Blood test 2 30.00 60.00", "Subtotal 105.00", "Total: $113.40"]


def test_page(spark):
    t = page(spark, LINES)
    r = rows.token_rows(t)
    assert [x.text for x in rows.row_texts(r).orderBy("row_no").collect()] == LINES
    found = {x.field: x for x in fields.page_discovery(t).collect()}
    assert found["invoiceNumber"].value == "HS-2041" and found["total"].value == "$113.40" and found["invoiceDate"].value == "2024-03-05"
    items = tables.page_lines(r).orderBy("line_no").collect()
    assert [(i.description, i.quantity, i.unit_price, i.amount) for i in items] == [("Recheck visit with notes", "1", "45.00", "45.00"), ("Blood test", "2", "30.00", "60.00")]
    s = fields.reconciled_summary(fields.summary_candidates(rows.row_texts(r))).first()
    assert (s.subtotal, s.tax, s.total) == (105.0, 8.4, 113.4)
    assert {x.field for x in fields.template(fields.page_discovery(t)).collect()} == set(found)


NOISE = ["invoice", "Invoice", "No:", "no.", "N0", "#", "Date", "date:", "due", "issued", "issue", "dates", "Total", "t0tal:", "sub", "subtota1", "and", "handling", "shippin", "to", "Bill", "billto:", "custmer", "cus", "tomer", "invoicno", "purchase", "0rder", "nunber", "tax", "id", "from\nthe", "from", "x", "-", "", None, "12.50", "2024-01-02", "S&H", "sales", "net", "amount", "vendor", "soldby"]


def noisy_pages(pages=60, seed=3):
    r = random.Random(seed)
    out = []
    for p in range(pages):
        for k in range(r.choice([1, 7, 40])):
            out.append((p // 3, p % 3, k, r.choice(NOISE), r.choice([20, 120, 300, 480, 520, 560, 800]), 10 + 17 * r.randint(0, 50) + r.randint(0, 3), r.choice([40, 80]), r.choice([20, 20, 20, 33]), 1000, 1000))
    return out


def test_placed_scores_and_regions_are_those_of_the_columns(spark):
    r = random.Random(4)
    names = [(f, a) for f, spec in labels.FIELD_SPECS.items() for a in spec[3]]

    def near(a):
        k = r.randrange(len(a) + 1)
        return r.choice([a, a.title() + ":", a[:k] + a[k + 1 :], a[:k] + r.choice("x 0") + a[k:], f"{a} {r.choice(NOISE)}", f"{r.choice(NOISE)} {a}"])

    phrase = lambda a: near(a) if r.random() < 0.5 else " ".join(t for t in r.choices(NOISE, k=r.randint(1, 4)) if t is not None)
    rows = [(phrase(a), f, a, r.choice([0.1, 0.42, 0.5, 0.7]), r.choice([0.1, 0.34, 0.4, 0.6])) for f, a in r.choices(names, k=4000)]
    df = spark.createDataFrame(rows, "phrase string, field string, alias string, cx double, cy double")
    seen = 0
    for x in df.withColumn("score", labels.label_score(*map(F.col, ("phrase", "alias", "field", "cx", "cy")))).collect():
        base = discovery.placeless(x.phrase, x.alias, x.field)
        if base is None:
            assert x.score < 0.72
        else:
            assert discovery.placed(base, x.field, x.cx, x.cy) == x.score
            seen += x.score >= 0.72
    assert seen > 100
    boxes = [(r.randint(0, 990), r.randint(0, 1990), r.randint(1, 300), r.randint(1, 90), r.choice([900, 1000, 1237]), r.choice([2000, 2111]), r.random() < 0.5, r.random() < 0.5) for _ in range(2000)]
    cols = ("x", "y", "w", "h", "page_w", "page_h", "below", "address")
    got = spark.createDataFrame(boxes, "x long, y long, w long, h long, page_w long, page_h long, below boolean, address boolean").withColumn("r", labels.value_region(*map(F.col, cols))).collect()
    assert all((g.r.x, g.r.y, g.r.x + g.r.width, g.r.y + g.r.height) == discovery.region(*(g[c] for c in cols)) for g in got)


def test_a_piece_is_left_whole():
    r = random.Random(8)
    seen = 0
    for alias in sorted({discovery.ocr(a) for spec in labels.FIELD_SPECS.values() for a in spec[3]}):
        for most in (1, 2, 3):
            if len(alias) < 7 or most > alias.count(" ") + 1:
                continue
            pieces = discovery.left_whole(alias, most)
            for _ in range(300):
                p = alias
                for _ in range(r.randint(1, most)):
                    k = r.randrange(len(p) + 1)
                    p = p[:k] + r.choice(["", " ", "x", "xa"[: r.randint(0, 1)]]) + p[k + r.randint(0, 1) :]
                p = discovery.ocr(p)
                if p and discovery.edits(alias, p) <= most and not set(p.split(" ")) & set(alias.split(" ")):
                    seen += 1
                    assert any(x in p and " " not in x for x in pieces), (alias, most, p, pieces)
    assert seen > 500


def test_page_discovery_as_by_hand(spark):
    t = spark.createDataFrame(noisy_pages(), "doc_id long, page_no int, token_seq long, text string, x long, y long, w long, h long, page_w long, page_h long")
    r = rows.token_rows(t).collect()
    by_row = {}
    for x in sorted(r, key=lambda x: (x.doc_id, x.page_no, x.row_no, x.place)):
        by_row.setdefault((x.doc_id, x.page_no, x.row_no), []).append(x)
    best = {}
    for (d, p, row), ts in by_row.items():
        for k in range(len(ts)):
            for n in range(1, min(4, len(ts) - k) + 1):
                run = ts[k : k + n]
                phrase = " ".join(x.text for x in run if x.text is not None)
                for f, (_, _, _, names) in labels.FIELD_SPECS.items():
                    for a in names:
                        base = discovery.placeless(phrase, a, f)
                        score = 0 if base is None else discovery.placed(base, f, min(x.x for x in run) / 1000, min(x.y for x in run) / 1000)
                        if score >= 0.72:
                            best[d, p, f] = min(best.get((d, p, f), (1,)), (-score, row, k, n, a, phrase))
    found = t.transform(fields.paged).select("doc_id", "page_no", "text", "token_seq", "x", "y", "w", "h", "page_w", "page_h").mapInArrow(discovery.finder(0.72), f"doc_id long, page_no int, found {discovery.FOUND}").collect()
    got = {(x.doc_id, x.page_no, l.field): l.score for x in found for l in x.found}
    assert got and all(-best[k][0] == v for k, v in got.items())
    values = {}
    for (d, p, f), (_, row, k, n, _, _) in best.items():
        kind, at, _, _ = labels.FIELD_SPECS[f]
        run = by_row[d, p, row][k : k + n]
        x, y = min(q.x for q in run), min(q.y for q in run)
        a, b, c, e = discovery.region(x, y, max(q.x + q.w for q in run) - x, max(q.y + q.h for q in run) - y, 1000, 1000, at == "below", kind == "address")
        lines = [" ".join(q.text for q in ts if q.text is not None and a <= (q.x + q.w / 2) / 1000 <= c and b <= (q.y + q.h / 2) / 1000 <= e) for (i, j, _), ts in sorted(by_row.items()) if (i, j) == (d, p) and any(a <= (q.x + q.w / 2) / 1000 <= c and b <= (q.y + q.h / 2) / 1000 <= e for q in ts)]
        if lines:
            values[d, p, f] = lines
    assert {(x.doc_id, x.page_no, l.field): l.lines for x in found for l in x.found} == values


def test_page_discovery_shuffles_no_tokens(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(900))
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.page_discovery(spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(x.page_no, x.field) for x in found.collect()} >= {(p, f) for p in range(3) for f in ("invoiceNumber", "total")}
    flat, pages = catalogue.tokens(spark, str(tmp_path)), catalogue.token_pages(spark, str(tmp_path))
    whole = [c for c in flat.columns if c not in ("doc_id", "page_no", "text", "page_w", "page_h")]
    assert sorted((x.doc_id, x.page_no, *q) for x in pages.collect() for q in zip(*(x[c] for c in whole), strict=True)) == sorted((x.doc_id, x.page_no, *(x[c] for c in whole)) for x in flat.collect())


def test_measurements():
    assert tables.measurements(["2", "10.00", "20.00", "24.20"], ["21%"]) == {"quantity": "2", "unit_price": "10.00", "amount": "20.00", "gross_amount": "24.20", "tax_rate": "21%"}
    assert tables.measurements(["9.00"], [])["amount"] == "9.00"
    assert tables.measurements(["2", "20.00", "24.20"], ["21%"])["unit_price"] == "10.00"


def test_sources(spark, tmp_path):
    (tmp_path / "b.PNG").write_bytes(b"x")
    (tmp_path / "a.pdf").write_bytes(b"yy")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "a.json").write_text('{"total": "5"}')
    (tmp_path / "b.json").write_text("{broken")
    found = files.documents(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["a.pdf", "b.PNG"]
    pairs = {r.stem: r.record for r in files.paired(found, files.records(spark, str(tmp_path))).collect()}
    assert pairs["a"] == {"total": "5"} and not pairs["b"]
    (tmp_path / "m.manifest").write_text(json.dumps({"buckets": {"x": ["a.pdf", "none.pdf"], "y": ["a.pdf"]}}))
    chosen, missing = files.subset(found, files.manifest(spark, str(tmp_path / "m.manifest")))
    assert chosen.count() == 1 and [r.file for r in missing.collect()] == ["none.pdf"]
    assert files.dataset_path("x", "/data") == "/data/x" and files.dataset_path("./x", "/data") == "./x"
    work = tmp_path / "work"
    (work / "src").mkdir(parents=True)
    (work / ".git").mkdir()
    (work / "src" / "a.py").write_text("one\ntwo\n")
    (work / ".git" / "x").write_text("hidden")
    assert [(r.path, r.text) for r in files.workspace(spark, str(work)).collect()] == [("src/a.py", "one\ntwo\n")]


def test_workspace_and_commands(spark, tmp_path, capsys):
    w = Workspace(spark, str(tmp_path))
    assert w.read("results").count() == 0 and w.next_id("runs") == 1
    fam = spark.createDataFrame([("f1", "established", 9, 1), ("f2", "provisional", 0, 0)], "template_family_id string, status string, apply_count long, reject_count long").withColumn("field_override_count", F.lit(0))
    w.append("families", fam)
    w.upsert("families", fam.where("template_family_id = 'f2'").withColumn("status", F.lit("degraded")), ["template_family_id"], ["updated_at"])
    assert {r.template_family_id: r.status for r in w.read("families").collect()} == {"f1": "established", "f2": "degraded"}
    w.append("fingerprints", spark.createDataFrame([("h1", "f1", "x"), ("h2", "f2", "x")], "fingerprint_hash string, template_family_id string, status string"))
    cli.main(["family-merge", "--workspace", str(tmp_path), "--family", "f2", "--target", "f1"], spark)
    assert {r.template_family_id for r in w.read("fingerprints").collect()} == {"f1"}
    w.append("results", catalogue.results(spark, SF))
    for command in ("families", "rankings", "issues", "run-summary", "analyze-failures", "attention", "demo", "family-retirements", "family-suggestions"):
        cli.main([command, "--workspace", str(tmp_path), "--limit", "2"], spark)
    assert "stable" in capsys.readouterr().out
    w.clear("results")
    assert w.read("results").count() == 0


def test_streams(spark, tmp_path):
    kind = "job_id string, accuracy double, error string"
    source, out = str(tmp_path / "in"), f"{tmp_path}/p"
    spark.createDataFrame([("j", 0.5, None), ("j", 1.0, None), ("j", None, "bad")], kind).write.parquet(source)
    kept = {}
    jobs.upserting(jobs.files(spark, source, kind), lambda b: kept.update(n=kept.get("n", 0) + b.count()), f"{tmp_path}/c1").awaitTermination()
    assert kept["n"] == 3
    q = jobs.progress(jobs.files(spark, source, kind)).writeStream.outputMode("complete").format("memory").queryName("p").option("checkpointLocation", out).start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("p").first()) == ("j", 2, 1, 0.75)
    events = "key string, seq long, event string, score double, checked boolean"
    e = str(tmp_path / "e")
    spark.createDataFrame([("k", i, "apply", 1.0, True) for i in range(3)], events).coalesce(1).write.parquet(e)
    q = jobs.lifecycle(jobs.files(spark, e, events)).writeStream.outputMode("append").format("memory").queryName("life").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    spark.createDataFrame([("k", i, "apply", 1.0, True) for i in range(3, 6)], events).coalesce(1).write.mode("append").parquet(e)
    q.processAllAvailable()
    q.stop()
    last = spark.table("life").orderBy(F.desc("seq")).first()
    assert (last.apply_count, last.status, last.confidence) == (6, "established", 1.0)


def test_windows_of_time(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(f"{tmp_path}/ev")
    s = jobs.files(spark, f"{tmp_path}/ev", "ts timestamp, event_type string")
    q = jobs.windowed(s, "ts", "1 hour", "1 day").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{tmp_path}/ev").count()


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("apply_threshold: 0.5\n")
    assert config.load(str(tmp_path / "c.yaml")).apply_threshold == 0.5 and config.load(None).batch_size == 50
    (tmp_path / "d.yaml").write_text("none: 1\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "d.yaml"))
    rules = [{"profile": "air", "system": "Darwin", "model_name_patterns": ["MacBook Air*"]}, {"profile": "big", "min_memory_gb": 32}]
    assert config.machine_profile(rules, {"system": "Linux", "memory_gb": 64}) == "big" and config.machine_profile(rules, {"system": "Darwin", "model_name": "MacBook Air M2", "memory_gb": 8}) == "air"
