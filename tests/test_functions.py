import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import dates, labels, numbers, rules, sets, text


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(make(F.col("v"))).collect()]


def test_amounts(spark):
    given_ = ["$1,234.56", "1.234,56", "1,234", "12,34", "abc", None, "-5", "1.5", "", "EUR 7"]
    assert column(spark, given_, numbers.amount) == [1234.56, 1234.56, 1234.0, 12.34, 0.0, None, -5.0, 1.5, 0.0, 7.0]
    assert column(spark, given_, numbers.number) == [1234.56, 1234.56, 1234.0, 12.34, None, None, -5.0, 1.5, None, 7.0]
    assert column(spark, ["1,23", "1,234", "1,2"], numbers.token_number) == [1.23, 1234.0, 12.0]
    assert column(spark, ["1,234", "123456789012", "1e5", "1111111111"], numbers.plain_number) == [1.234, None, None, None]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=20))
def test_amounts_round_trip(spark, cents):
    shown = [f"{c / 100:,.2f}" for c in cents]
    assert column(spark, shown, numbers.amount) == [c / 100 for c in cents]
    assert column(spark, [s.replace(",", "_").replace(".", ",").replace("_", ".") for s in shown], numbers.amount) == [c / 100 for c in cents]


def test_votes_and_conventions(spark):
    assert column(spark, ["1,234.56", "1.234,56", "12.34", "12,34", "1,234", "12"], numbers.dot_vote) == [2, 0, 1, 0, 1, 0]
    assert column(spark, ["1,234.56", "1.234,56", "12.34", "12,34", "1.234", "12"], numbers.comma_vote) == [0, 2, 0, 1, 1, 0]
    assert column(spark, ["1.234", "1,5"], lambda c: numbers.amount_by_convention(c, F.lit("comma"))) == [1234.0, 1.5]
    assert column(spark, ["8.25%", "x"], numbers.percent) == [8.25, None]
    assert column(spark, ["a 1,200.50 b 3.00 3.00"], numbers.amounts_in) == [["1,200.50", "3.00"]]


def test_dates(spark):
    shown = ["2024/3/5", "05/03/2024", "13/02/24", "02/13/99", "31/31/2024", "2024-02-30", "March 5, 2024", "5 Mar 2024", "Mar 5th 2024", "soon", None]
    abroad = ["2024-03-05", "2024-03-05", "2024-02-13", "1999-02-13", "31/31/2024", "2024-02-30", "2024-03-05", "2024-03-05", "2024-03-05", "soon", None]
    assert column(spark, shown, lambda c: dates.iso(c, F.lit("DE"))) == abroad
    assert column(spark, ["05/03/2024"], lambda c: dates.iso(c, F.lit("us"))) == ["2024-05-03"]
    assert column(spark, ["due on the 7th of June 2023", "31/31/2024", "nothing", None], lambda c: dates.iso_fuzzy(c, F.lit(None).cast("string"))) == ["2023-06-07", "31/31/2024", "nothing", None]
    assert column(spark, ["1/2/2024", "13/2/2024", "2/2/2024", "x"], dates.ambiguous) == [True, False, False, False]
    assert column(spark, [datetime.date(1989, 1, 1), datetime.date(2024, 1, 1), None], dates.plausible, "date") == [False, True, False]


def test_text(spark):
    assert column(spark, ["  a \n b ", "", None], text.cleaned) == ["a b", None, None]
    assert column(spark, ["T0TAL: 5um"], text.ocr_text) == ["total sum"]
    assert column(spark, ["A-b 1"], text.key) == ["ab1"] and column(spark, ["A--b 1!"], text.anchor) == ["a b 1"]
    assert column(spark, ["kitten", "", "same"], lambda c: F.round(text.similarity(c, F.lit("same")), 4)) == [0.1667, 0.0, 1.0]
    assert column(spark, ["an invoice estimate", "Statement", "bill to x", "x"], text.document_family) == ["estimate", "statement", "invoice", "unknown"]
    assert column(spark, ["/a/b.PDF", "x.jpeg", "y.txt"], text.source_format) == ["pdf_scanned", "image", "unknown"]
    assert column(spark, ["/a/b.c.pdf", "b", ".hidden"], text.path_stem) == ["b.c", "b", ".hidden"]
    assert column(spark, ["a: 1\nb:2\na: 3\nnone\n: x"], text.key_values) == [{"a": "1", "b": "2"}]
    assert column(spark, ["Blood test 2 30.00 60.00", "Visit 1 45.00", "Total 1 5.00", "a: 1 2", "one 5", "word only here"], text.line_item) == [
        ("Blood test", "2", "30.00", "60.00"), ("Visit", "1", None, "45.00"), None, None, None, None,
    ]
    assert column(spark, ["usd 5", "used", "a.usd."], lambda c: text.has_marker(c, "usd")) == [True, False, True]
    assert column(spark, ["a b c"], lambda c: text.ngrams(F.split(c, " "), 2)) == [["a", "a b", "b", "b c", "c"]]
    slug = column(spark, ["Some Clinic, Ltd."], lambda c: text.family_slug(c, F.lit("x")))[0]
    assert slug.startswith("family-some-clinic-ltd-") and len(slug.rsplit("-", 1)[1]) == 12


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), min_size=1, max_size=20))
def test_hamming(spark, pairs):
    df = spark.createDataFrame([(k, f"{a:016x}", f"{b:016x}") for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    assert [r[0] for r in df.orderBy("k").select(sets.hamming(F.col("a"), F.col("b"))).collect()] == [(a ^ b).bit_count() for a, b in pairs]


def test_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"]), (None, ["a"]), (["a"], ["a"])], "a array<string>, b array<string>")
    assert [round(r[0], 4) for r in df.select(sets.jaccard(F.col("a"), F.col("b"))).collect()] == [0.3333, 0.0, 0.0, 1.0]
    assert column(spark, [{"b": "2", "a": "1"}], sets.sorted_json, "map<string,string>") == ['{"a":"1","b":"2"}']


def test_rules(spark):
    score = lambda c: F.create_map(*[x for k, v in rules.country_scores(c).items() for x in (F.lit(k), v)])
    assert column(spark, ["Austin, Texas 78701", "Toronto, Ontario M5V 3L9", "RFC Monterrey, Nuevo Leon"], score) == [{"US": 4, "CA": 0, "MX": 0}, {"US": 0, "CA": 6, "MX": 0}, {"US": 0, "CA": 0, "MX": 5}]
    issues = column(spark, ["Missing extracted field: vendor", "Mismatch on dueDate: expected 'a'", "Subtotal mismatch: x", "Total mismatch: x", "runtime error", "", "odd"], rules.error_issue)
    assert [tuple(x) for x in issues] == [
        ("party_block_extraction", "missing_field"), ("scalar_reconciliation", "field_mismatch"), ("summary_amount_resolution", "subtotal_mismatch"), ("summary_amount_resolution", "total_mismatch"),
        ("runtime_error", "runtime_error"), ("other", "unknown"), ("scalar_reconciliation", "other"),
    ]
    weight = lambda b, c, s: spark.range(1).select(rules.issue_weight(F.lit(b), F.lit(c), F.lit(s).cast("double"))).first()[0]
    assert weight("runtime_error", "runtime_error", None) == 3.125 and weight("line_item_detection", "line_item_count_mismatch", 0.4) == 1.3915 and weight("none", "other", 0.7) == 0.7875
    assert column(spark, [0.3, 0.6, 0.9, 0.97, None], rules.score_band, "double") == ["<0.5", "0.5-0.8", "0.8-0.95", ">=0.95", "unknown"]
    assert column(spark, ["MX", "GB", None, "US"], lambda c: rules.currency_error(c, F.lit("USD"))) == ["Currency mismatch for country MX: expected MXN, got USD", "Unsupported country code: GB", None, None]


@pytest.mark.parametrize(
    "match,family,score,native,ready,want",
    [("provisional", None, 0.0, False, True, "DISCOVERY"), ("provisional", None, 0.0, False, False, "APPLY"), ("degraded", None, 0.0, False, True, "DISCOVERY"), (None, "degraded", 0.8, False, True, "DISCOVERY"),
     (None, "degraded", 0.8, False, False, "APPLY"), (None, "established", 0.7, False, False, "FAIL"), (None, None, 0.0, True, False, "APPLY"), (None, None, 0.0, False, True, "DISCOVERY"), (None, None, 0.0, False, False, "FAIL")],
)
def test_route(spark, match, family, score, native, ready, want):
    lit = lambda v: F.lit(v).cast("string")
    assert spark.range(1).select(rules.route(lit(match), lit(family), F.lit(score), 0.75, F.lit(native), F.lit(ready))).first()[0] == want


def test_label_scores(spark):
    score = lambda p, a, f: spark.range(1).select(labels.label_score(F.lit(p), F.lit(a), F.lit(f), F.lit(0.1), F.lit(0.1))).first()[0]
    assert score("Invoice No:", "invoice no", "invoiceNumber") == 1.0
    assert score("Due Date", "invoice date", "invoiceDate") < 0.3
    assert score("Tax ID", "tax", "tax") == 0.0
    assert score("Invoice", "invoice no", "invoiceNumber") < 0.72
