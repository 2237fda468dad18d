"""More registered queries and their SQL: reading of rows and parties, the invoice's figures step by step, families, and what runs leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import classify as cl
from ledgerloom.functions import rules
from ledgerloom.functions.text import ocr_text
from ledgerloom.operators import diagnostics, profiles, reconcile, routing, truth
from ledgerloom.page import values
from ledgerloom.plans.catalogue import _R, ORACLE_SQL, QUERIES, query, results, table, tokens

__all__ = ["ORACLE_SQL", "QUERIES"]

# --- rows and parties -----------------------------------------------------------------------------------------------


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _contains(x: str, names) -> str:
    return "(" + " OR ".join(f"contains({x}, '{n}')" for n in names) + ")"


def _word(x: str, names) -> str:
    return f"regexp_matches({x}, '(^|[^a-z0-9])({'|'.join(names)})($|[^a-z0-9])')"


def _ocr(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), '01357', 'oiest'), '[^a-z0-9]+', ' ', 'g'))"


_BEGIN = "CASE (doc_id + i) % 9 WHEN 0 THEN 'Bill To: ' WHEN 1 THEN 'Subtotal 12.00 ' WHEN 2 THEN 'Invoice Date 2024-01-05 ' WHEN 3 THEN 'Description Qty Amount ' WHEN 4 THEN 'Phone 555 123 4567 ' WHEN 5 THEN '3 Exam 45.00 ' WHEN 6 THEN 'Total VAT 9.50 sold by Acme ltd ' ELSE '' END"
_PARTY_LABELS = [x for xs in cl.PARTY_LABELS.values() for x in xs]
_SUMMARY_CUES = sorted({x for xs in cl.SUMMARY_CUES.values() for x in xs})
_CLASSES = {
    "noise": f"(p = '' OR regexp_matches(p, '{cl.NOISE}'))",
    "party": f"(p <> '' AND ({_contains('p', _PARTY_LABELS)} OR list_has_any(string_split(p, ' '), {_list(cl.BUSINESS_SUFFIXES)})))",
    "summary": _contains("p", _SUMMARY_CUES),
    "headers": "(" + " + ".join(f"{_word('p', names)}::INT" for names in cl.TABLE_HEADERS.values()) + ")",
    "banner": f"p IN ({', '.join(repr(b) for b in cl.BANNERS)})",
    "metadata": f"(p <> '' AND NOT {_contains('p', cl.SUM_PHRASES)} AND ({_word('p', cl.METADATA_LABELS)} OR contains(p, 'issue')) AND regexp_matches(t, '[0-9]'))",
}


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
a AS (SELECT doc_id, {_BEGIN} || x AS t FROM l), b AS (SELECT *, {_ocr('t')} AS p FROM a),
c AS (SELECT *, {', '.join(f'{x} AS {k}' for k, x in _CLASSES.items())} FROM b),
d AS (SELECT *, len(string_split(p, ' ')) >= 8 AND summary AND regexp_matches(t, '[0-9]') AND (party OR noise) AS mixed,
  p <> '' AND (headers >= 2 OR p IN ('item', 'items') OR (headers >= 1 AND {_contains('p', cl.TABLE_WORDS)}) OR (regexp_matches(t, '^\\s*[|]?\\s*\\d{{1,3}}[.:]?\\b') AND regexp_matches(t, '\\p{{L}}'))) AS tabular,
  noise OR regexp_matches(t, '\\b\\d{{3}}[- ]?\\d{{3}}[- ]?\\d{{4}}\\b') OR regexp_matches(p, '\\b[a-z]\\d[a-z]\\b') OR length(regexp_replace(t, '[^0-9]', '', 'g')) >= 5 AS contact FROM c)
SELECT doc_id, count(*) AS n_rows, count(*) FILTER (noise) AS noise, count(*) FILTER (party) AS party, count(*) FILTER (summary) AS summary, count(*) FILTER (mixed) AS mixed, sum(headers)::BIGINT AS headers, count(*) FILTER (tabular) AS tabular,
  count(*) FILTER (metadata) AS metadata, count(*) FILTER (banner) AS banner, count(*) FILTER (contact) AS contact FROM d GROUP BY 1""")
def row_classifier(spark, d):
    """The eight kinds of rows over all lines of the documents, counted by document."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).select("doc_id", F.concat(F.expr(_BEGIN), "x").alias("t"))
    c = lines.select("doc_id", cl.row_classes(F.col("t")).alias("c"))
    named = {"noise": "noise", "party": "party", "summary": "summary", "mixed": "mixed", "tabular": "table", "metadata": "metadata", "banner": "banner", "contact": "contact"}
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("c.headers").alias("headers"), *[F.count_if(f"c.{x}").alias(k) for k, x in named.items()])


_NAME = "CASE c_custkey % 8 WHEN 0 THEN 'Acme Ltd ' || c_custkey || ' Main Street' WHEN 1 THEN c_name || ' Trading GmbH, Canada' WHEN 2 THEN ' | Harbor & Sons  Bill To Jordan' WHEN 3 THEN 'JORDAN LEE 2468 rue Suite 9' WHEN 4 THEN 'Widget Corp www.widget.com total' WHEN 5 THEN 'ABC' WHEN 6 THEN 'Ann - Smith ann@smith.com' ELSE c_mktsegment || ' Partners plc' END"
_STOPS = _list([*cl.BOUNDARY_WORDS, *cl.STREET_WORDS, *cl.ADDRESS_STOPS, *cl.COUNTRY_NAMES])
_PLACES = _list([*cl.BOUNDARY_WORDS, *cl.STREET_WORDS, *cl.ADDRESS_STOPS, *cl.PLACE_WORDS])
_EDGES = "regexp_replace(regexp_replace({x}, '^[ :,|-]+', ''), '[ :,|-]+$', '')"


@query(f"""
WITH a AS (SELECT c_custkey AS doc_id, {_NAME} AS t FROM customer), b AS (SELECT *, {_EDGES.format(x="trim(regexp_replace(t, '[ ]+', ' ', 'g'))")} AS s FROM a),
w AS (SELECT doc_id, t, list_filter(string_split(s, ' '), lambda x: x <> '') AS ws FROM b), p AS (SELECT *, list_transform(ws, lambda x: {_ocr('x')}) AS ps FROM w),
e AS (SELECT *, list_transform(range(1, len(ps) + 1), lambda i: ps[i] <> '' AND (list_contains({_STOPS}, ps[i]) OR regexp_matches(ws[i], '(?i)https?://|www\\.|@') OR regexp_matches(ps[i], '^[0-9]{{5}}$')
  OR (regexp_matches(ps[i], '^[0-9]{{1,5}}$') AND list_has_any(ps[i + 1:i + 3], {_PLACES})))) AS ends FROM p),
k AS (SELECT *, coalesce(list_position(ends, TRUE), 0) AS cut FROM e), f AS (SELECT *, CASE WHEN cut > 0 THEN cut - 1 ELSE len(ws) END AS n FROM k),
g AS (SELECT doc_id, t, array_to_string(list_transform(list_filter(range(1, n + 1), lambda i: ps[i] <> ''), lambda i: ws[i]), ' ') AS joined FROM f)
SELECT doc_id, t AS raw, {_EDGES.format(x='joined')} AS party FROM g""")
def party_trim(spark, d):
    """Parties' names cut at the first word of an address, a label, a country or a link."""
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_NAME).alias("raw"))
    return x.withColumn("party", cl.trimmed_party(F.col("raw")))


@query(f"""
WITH a AS (SELECT c_custkey AS doc_id, {_NAME} AS t FROM customer), b AS (SELECT *, {_ocr('t')} AS p, string_split({_ocr('t')}, ' ') AS ws FROM a),
c AS (SELECT *, list_has_any(ws, {_list(cl.BUSINESS_SUFFIXES)}) AS suffix, upper(t) = t AS caps, len(ws) AS n FROM b)
SELECT doc_id, CASE WHEN p = '' OR {_contains('p', cl.ACCOUNT_MARKERS)} OR p IN ({', '.join(repr(x) for x in cl.COUNTRY_NAMES)}) THEN -1.0::DOUBLE WHEN p IN ({', '.join(repr(x) for x in cl.ADDRESS_STOPS)}) OR ends_with(p, ' to') THEN -0.6::DOUBLE
  WHEN NOT regexp_matches(p, '[a-z]') THEN -0.5::DOUBLE WHEN n = 1 AND suffix THEN -0.45::DOUBLE WHEN n <= 3 AND len(list_filter(ws, lambda x: NOT regexp_matches(x, '^[a-z]{{1,3}}$'))) = 0 AND caps AND NOT suffix THEN -0.5::DOUBLE WHEN n > 8 THEN -0.2::DOUBLE
  WHEN regexp_matches(p, '{cl.NOISE}') THEN -0.5::DOUBLE WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) >= 5 THEN -0.3::DOUBLE
  ELSE round(0.2::DOUBLE + CASE WHEN suffix THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN n IN (2, 3, 4) THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN caps AND n <= 4 THEN 0.08::DOUBLE ELSE 0 END, 6) END AS score FROM c""")
def party_line_scores(spark, d):
    """How well rows read as a party's name."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.round(cl.party_line_score(F.expr(_NAME)), 6).alias("score"))


_LABELLED = "CASE o_orderkey % 7 WHEN 0 THEN 'Invoice No: HS-' || o_orderkey || ' Date 5' WHEN 1 THEN 'INV # ' || o_orderkey || ' |' WHEN 2 THEN 'Invoice ' || o_orderkey || ' due now' WHEN 3 THEN 'inv : A-' || o_orderkey || ' street 5' WHEN 4 THEN 'Date of issue: 2024-01-05' WHEN 5 THEN ' invoice date - 5 May 2024 ,' ELSE o_orderpriority || ' www.x.com' END"
_IDENT = "trim(regexp_replace(regexp_replace(regexp_replace(s, '(?i)^\\s*(?:invoice(?:\\s*(?:no\\.?|number|#))?|inv(?:\\s+(?:no\\.?|number)|\\s*#|\\s*:))\\s*[:#-]?\\s*', ''), '^[ :,|-]+|[ :,|-]+$', '', 'g'), '[|,;:\\s-]+$', ''))"


@query(f"""
WITH a AS (SELECT o_orderkey AS doc_id, {_LABELLED} AS raw FROM orders), b AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS s FROM a),
c AS (SELECT doc_id, raw, regexp_replace(regexp_replace(s, '(?i)^\\s*(?:date(?:\\s+of\\s+issue)?|invoice\\s+date|issue\\s+date|of\\s+issue)\\b(?:\\s*[:#-]|\\s+)?\\s*', ''), '^[ :,|-]+|[ :,|-]+$', '', 'g') AS day, {_IDENT} AS u FROM b),
w AS (SELECT *, list_filter(string_split(u, ' '), lambda x: x <> '') AS ws FROM c),
e AS (SELECT *, list_transform(ws, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) AS ps FROM w),
f AS (SELECT *, coalesce(list_position(list_transform(range(1, len(ws) + 1), lambda i: ps[i] <> '' AND (list_contains({_list(cl.NUMBER_STOPS)}, ps[i]) OR regexp_matches(ws[i], '(?i)https?://|www\\.|@'))), TRUE), 0) AS cut FROM e),
g AS (SELECT *, array_to_string(list_transform(list_filter(range(1, CASE WHEN cut > 0 THEN cut ELSE len(ws) + 1 END), lambda i: ps[i] <> ''), lambda i: ws[i]), ' ') AS joined FROM f)
SELECT doc_id, raw, day, CASE WHEN len(ws) >= 2 AND regexp_matches(joined, '[0-9]') THEN {_EDGES.format(x='joined')} ELSE u END AS number FROM g""")
def label_cleanup(spark, d):
    """Dates and invoice numbers without the labels that came along with them."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_LABELLED).alias("raw"))
    return x.withColumns({"day": cl.date_text(F.col("raw")), "number": cl.invoice_number_text(F.col("raw"))})


_AT = {"x": "CAST(l_partkey % 100 AS DOUBLE) / 100", "y": "CAST(l_suppkey % 100 AS DOUBLE) / 100"}
_FIELD = "CASE l_linenumber % 3 WHEN 0 THEN 'subtotal' WHEN 1 THEN 'tax' ELSE 'total' END"
_ROW = "CASE l_quantity % 5 WHEN 0 THEN 'Subtotal due' WHEN 1 THEN 'Sales tax' WHEN 2 THEN 'Total' WHEN 3 THEN 'Date of order' ELSE 'Balance due' END"
_VALUE = "CASE l_linenumber % 4 WHEN 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) WHEN 1 THEN '$' || CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) WHEN 2 THEN 'INV-' || l_orderkey ELSE '-' || CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR) END"
_SPARK_VALUE = _VALUE.replace("VARCHAR", "STRING")


def _points(*cases) -> str:
    return " + ".join(f"(CASE WHEN {c} THEN {n}::DOUBLE ELSE 0::DOUBLE END)" for c, n in cases)


@query(f"""
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_AT['x']} AS x, {_AT['y']} AS y, {_FIELD} AS f, lower({_ROW}) AS p, {_VALUE} AS v FROM lineitem),
b AS (SELECT *, length(regexp_replace(v, '[^0-9]', '', 'g')) AS dg, length(regexp_replace(v, '[^A-Za-z]', '', 'g')) AS al, try_cast(regexp_replace(v, '[^0-9.,-]', '', 'g') AS DOUBLE) AS n FROM a),
c AS (SELECT *, dg * 0.18::DOUBLE + least(al, 4) * 0.06::DOUBLE + {_points(('dg = 0', -0.6), ('length(v) < 3', -0.5), ('dg <= 3', -0.25), ('dg = 4', -0.75), ("contains(v, '$')", -0.8), ('x > 0.8', -0.15), ('x < 0.7', 0.04))} + greatest(0.0::DOUBLE, 0.16::DOUBLE - y * 0.18::DOUBLE) AS number_score,
  0.4::DOUBLE + CASE f WHEN 'total' THEN {_points(('x > 0.55', 0.12), ('y > 0.55', 0.14))} ELSE {_points(('x > 0.5', 0.08), ('y > 0.5', 0.10))} END
  + {_points(('n < 0', -1.4), ('n < 1', -0.4), ('n >= 1 AND n < 10', -0.2), ("NOT regexp_matches(v, '[.,$]')", -0.18), ("regexp_matches(v, '^[0-9]{1,2},?$')", -0.5), ('x > 0.7', 0.18), ('x < 0.35', -0.08), ('y > 0.65', 0.18), ("contains(p, 'date')", -0.45))}
  + CASE WHEN contains(p, 'subtotal') AND f = 'subtotal' THEN 0.28::DOUBLE WHEN contains(p, 'tax') AND f = 'tax' THEN 0.28::DOUBLE WHEN contains(p, 'total') AND NOT contains(p, 'subtotal') THEN CASE WHEN f LIKE '%total%' THEN 0.34::DOUBLE ELSE 0 END
    WHEN contains(p, 'balance due') AND f LIKE '%total%' THEN 0.3::DOUBLE ELSE 0 END AS amount_score FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(number_score, 6) AS number_score, round(CASE WHEN n IS NULL THEN -1 ELSE amount_score END, 6) AS amount_score FROM c""")
def candidate_scores(spark, d):
    """How well tokens of rows, by what they say and where they stand, read as invoice numbers and as sums."""
    a = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{_AT['x']} AS x", f"{_AT['y']} AS y", f"{_FIELD} AS f", f"{_ROW} AS r", f"{_SPARK_VALUE} AS v")
    c = F.col
    number, amount = cl.invoice_candidate_score(c("v"), c("x"), c("y")), cl.amount_candidate_score(c("f"), c("v"), c("x"), c("y"), c("r"))
    return a.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(number, 6).alias("number_score"), F.round(amount, 6).alias("amount_score"))


_READ = "CASE doc_id % 4 WHEN 0 THEN 'HELLO' WHEN 1 THEN '12' WHEN 2 THEN 'a' ELSE text END"


@query(f"""
WITH t AS (SELECT doc_id, i // 400 AS page_no, i, CASE i % 4 WHEN 0 THEN 'HELLO' WHEN 1 THEN '12' WHEN 2 THEN '--' ELSE w END AS w, (i * 37 % 101)::DOUBLE AS conf, CASE WHEN (doc_id + i) % 3 = 0 THEN 180 ELSE 0 END AS angle
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents)),
s AS (SELECT *, length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) AS al, length(regexp_replace(w, '[^0-9]', '', 'g')) AS dg FROM t),
p AS (SELECT doc_id, page_no, angle, round(sum((CASE WHEN al + dg > 0 THEN conf / 100 + CASE WHEN al >= 2 THEN 0.5::DOUBLE WHEN dg >= 2 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN upper(w) = w AND al >= 3 THEN 0.1::DOUBLE ELSE 0 END END)::DECIMAL(18,6)), 4)::DOUBLE AS score FROM s GROUP BY 1, 2, 3),
q AS (SELECT doc_id, page_no, coalesce(max(score) FILTER (angle = 0), 0) AS a, coalesce(max(score) FILTER (angle = 180), 0) AS b FROM p GROUP BY 1, 2)
SELECT doc_id, page_no::INT AS page_no, CASE WHEN b > a * 1.1::DOUBLE AND b > a + 1 THEN 180 ELSE 0 END AS angle FROM q""")
def upright_pages(spark, d):
    """Which way up pages read better, by their tokens and how sure each is."""
    w = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    i = F.col("i")
    t = w.select(
        "doc_id", F.expr("cast(i div 400 as int)").alias("page_no"), F.when(i % 4 == 0, "HELLO").when(i % 4 == 1, "12").when(i % 4 == 2, "--").otherwise(F.col("w")).alias("text"),
        (i * 37 % 101).cast("double").alias("confidence"), F.when((F.col("doc_id") + i) % 3 == 0, 180).otherwise(0).alias("angle"),
    )
    return values.upright(values.readability(t))


@query("SELECT l_orderkey AS doc_id, bool_or(l_discount > 0.09) AS quality_flag, (CASE WHEN bool_or(l_discount > 0.09) THEN 16 ELSE 8 END)::INT AS region_buffer FROM lineitem GROUP BY 1")
def quality_gate(spark, d):
    return values.quality_gate(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_discount") > 0.09).alias("quality_flag")))


_CELLS = "FROM (SELECT doc_id, i // 400 AS page_no, i % 400 AS k, w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents))"
_SPELT = "CASE k % 40 WHEN 16 THEN 'Totai:' WHEN 17 THEN '$' || doc_id || '.50' WHEN 24 THEN 'Invoice' ELSE w END"


@query(f"""
WITH t AS (SELECT doc_id, page_no, k, {_SPELT} AS w, k % 8 * 100 + 20 AS x, k // 8 * 40 + 10 + k % 3 AS y {_CELLS}),
n AS (SELECT *, regexp_replace(lower(w), '[^a-z0-9]+', '', 'g') AS q FROM t), l AS (SELECT unnest(['Total', 'Invoice No']) AS label, unnest([['total', 'total'], ['invoiceno', 'invoice', 'no']]) AS ks),
m AS (SELECT doc_id, page_no, label, k, x, y, q, list_min(list_transform(ks, lambda s: levenshtein(q, s))) AS e FROM n, l WHERE q <> ''),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, label ORDER BY e, k) AS r FROM m) WHERE r = 1 AND e <= greatest(1, length(q) // 3)),
j AS (SELECT b.doc_id, b.page_no, label, t.w, t.x, (t.y + 10) // 20 AS line, t.k FROM b JOIN t ON t.doc_id = b.doc_id AND t.page_no = b.page_no AND abs(t.y - b.y) <= 20 AND trim(t.w) <> '' AND t.x > b.x + 80 AND t.x <= 855)
SELECT doc_id, page_no::INT AS page_no, label, string_agg(trim(w), ' ' ORDER BY line, x, k) AS text FROM j GROUP BY 1, 2, 3""")
def label_neighbours(spark, d):
    """What stands to the right of the token that spells a label best, on every page."""
    k = F.col("token_seq") % 40
    t = tokens(spark, d).withColumn("text", F.when(k == 16, "Totai:").when(k == 17, F.concat(F.lit("$"), "doc_id", F.lit(".50"))).when(k == 24, "Invoice").otherwise(F.col("text")))
    labels = t.select("doc_id", "page_no").distinct().withColumn("label", F.explode(F.array(F.lit("Total"), F.lit("Invoice No"))))
    return values.label_neighbours(t, labels)


# --- an invoice's figures step by step ------------------------------------------------------------------------------

_LINE_TEXT = {
    "quantity": "CAST(CAST(l_quantity AS INT) AS VARCHAR)",
    "unit_price": "CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END",
    "amount": "CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END",
    "net_amount": "CASE WHEN l_orderkey % 3 = 1 THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) END",
    "gross_amount": "CASE WHEN l_orderkey % 3 = 0 OR l_orderkey % 6 = 1 THEN CAST(CAST(FLOOR(l_extendedprice * (1 + l_tax)) AS DECIMAL(12,2)) AS VARCHAR) END",
    "tax_rate": "CASE WHEN l_orderkey % 3 < 2 THEN CAST(CAST(l_tax * 100 AS INT) AS VARCHAR) || '%' END",
}
_NUM = {k: f"try_cast(replace({k}, '%', '') AS DOUBLE)" for k in _LINE_TEXT}
_LINES_SQL = f"""lt AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_partkey, l_suppkey, {', '.join(f'{x} AS {k}' for k, x in _LINE_TEXT.items())} FROM lineitem JOIN part ON l_partkey = p_partkey),
l0 AS (SELECT doc_id, line_no, l_partkey, l_suppkey, {_NUM['quantity']} AS q, {_NUM['unit_price']} AS p0, {_NUM['amount']} AS raw_amount, {_NUM['net_amount']} AS n0, {_NUM['gross_amount']} AS g, {_NUM['tax_rate']} AS r FROM lt),
l1 AS (SELECT *, coalesce(n0, raw_amount, g) AS a0, round((g / (1 + r / 100))::VARCHAR::DECIMAL(38,14), 2)::DOUBLE AS fit, g IS NOT NULL AND coalesce(r, 0) <> 0 AS rated FROM l0),
l2 AS (SELECT *, CASE WHEN rated AND (a0 IS NULL OR a0 <= greatest(1.0::DOUBLE, fit * 0.25::DOUBLE) OR abs(a0 * (1 + r / 100) - g) > greatest(0.05::DOUBLE, g * 0.03::DOUBLE)) THEN fit ELSE a0 END AS a1 FROM l1),
l3 AS (SELECT *, CASE WHEN rated THEN coalesce(n0, a1) ELSE n0 END AS n1, round((q * p0)::VARCHAR::DECIMAL(38,14), 2)::DOUBLE AS prod, coalesce(q > 1, FALSE) AS several FROM l2),
l4 AS (SELECT *, several AND coalesce(abs(a1 - p0) <= 0.02::DOUBLE, FALSE) AS repeats FROM l3),
l5 AS (SELECT *, CASE WHEN a1 IS NULL OR (repeats AND prod IS NOT NULL) THEN prod ELSE a1 END AS a2 FROM l4), l6 AS (SELECT *, round((a2 / q)::VARCHAR::DECIMAL(38,14), 2)::DOUBLE AS each FROM l5),
l7 AS (SELECT *, coalesce(several AND NOT repeats AND abs(prod - a2) > greatest(0.02::DOUBLE, a2 * 0.015::DOUBLE) AND (abs(each - p0) <= greatest(3.0::DOUBLE, p0 * 0.1::DOUBLE) OR p0 <= greatest(1.0::DOUBLE, each * 0.25::DOUBLE)), FALSE) AS aligned FROM l6),
ln AS (SELECT doc_id, line_no, l_partkey, l_suppkey, q AS quantity, CASE WHEN aligned THEN each ELSE p0 END AS unit_price, a2 AS amount, n1 AS net_amount, g AS gross_amount, r AS tax_rate, coalesce(round(g - n1, 2), round((n1 * r / 100)::VARCHAR::DECIMAL(38,14), 2)::DOUBLE) AS tax_amount, raw_amount FROM l7)"""


def _lines(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    own = {k: x.replace("VARCHAR", "STRING") for k, x in _LINE_TEXT.items()}
    texts = j.selectExpr("l_orderkey AS doc_id", "l_linenumber AS line_no", "l_partkey", "l_suppkey", "p_name AS description", *[f"{x} AS {k}" for k, x in own.items()], "CAST(NULL AS STRING) AS tax_amount")
    return reconcile.normalized_lines(texts)


@query(f"WITH {_LINES_SQL} SELECT doc_id, line_no, l_partkey, l_suppkey, quantity, unit_price, amount, net_amount, gross_amount, tax_rate, tax_amount FROM ln")
def line_normalize_tax(spark, d):
    """Line items as numbers that agree: amounts from gross and rate, from quantity and price, prices from amounts, and the tax."""
    return _lines(spark, d).select("doc_id", "line_no", "l_partkey", "l_suppkey", "quantity", "unit_price", "amount", "net_amount", "gross_amount", "tax_rate", "tax_amount")


_HEAD = {
    "subtotal": "CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE CAST(FLOOR(o_totalprice * 0.9) AS DOUBLE) END",
    "tax": "CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE CAST(FLOOR(o_totalprice * 0.05) AS DOUBLE) END",
    "shipping": "CASE WHEN o_orderkey % 7 = 0 THEN CAST(5 AS DOUBLE) END",
    "total": "CASE o_orderkey % 6 WHEN 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) END",
}
_SHIP = "coalesce(shipping, 0)"


def _fits(x: str) -> str:
    return f"({x} IS NOT NULL AND (total IS NULL OR coalesce(abs(total - ({x} + tax + {_SHIP})) <= 0.02::DOUBLE, FALSE) OR (tax IS NULL AND total + 0.02::DOUBLE >= {x} + {_SHIP})))"


def _apart(a: str, b: str) -> str:
    return f"coalesce(abs({a} - {b}) > 0.02::DOUBLE, FALSE)"


@query(f"""
WITH {_LINES_SQL},
k AS (SELECT *, CASE WHEN coalesce(abs(amount - raw_amount) > 0.02::DOUBLE AND abs(amount - round(quantity * unit_price, 2)) <= 0.02::DOUBLE, FALSE) THEN raw_amount ELSE amount END AS kept FROM ln),
s AS (SELECT doc_id, count(*) AS line_count, round(sum(amount::DECIMAL(18,4)), 2)::DOUBLE AS own_sum, round(sum(kept::DECIMAL(18,4)), 2)::DOUBLE AS plain_sum, round(sum(raw_amount::DECIMAL(18,4)), 2)::DOUBLE AS raw_sum, round(sum(net_amount::DECIMAL(18,4)), 2)::DOUBLE AS net_sum,
  round(sum(gross_amount::DECIMAL(18,4)), 2)::DOUBLE AS gross_sum, round(sum(tax_amount::DECIMAL(18,4)), 2)::DOUBLE AS tax_sum, bool_and(quantity IS NOT NULL AND unit_price IS NOT NULL AND amount IS NOT NULL) AS priced, bool_and(net_amount IS NOT NULL) AS netted,
  bool_and(gross_amount IS NOT NULL) AS grossed, bool_and(coalesce(tax_amount >= -0.02::DOUBLE, FALSE)) AS taxed, coalesce(bool_or(gross_amount + 0.02::DOUBLE < net_amount), FALSE) AS below,
  bool_or(coalesce(tax_rate, 0) > 0 AND coalesce(net_amount, 0) > 0) AND bool_and(coalesce(tax_amount, 0) <= 0.02::DOUBLE) AS untaxed FROM k GROUP BY 1),
h AS (SELECT o_orderkey AS doc_id, {', '.join(f'{x} AS {n}' for n, x in _HEAD.items())} FROM orders),
i0 AS (SELECT h.*, coalesce(line_count, 0) AS line_count, own_sum, plain_sum, raw_sum, net_sum, gross_sum, tax_sum, coalesce(priced, FALSE) AS priced, coalesce(netted, FALSE) AS netted, coalesce(grossed, FALSE) AS grossed, coalesce(taxed, FALSE) AS taxed, coalesce(below, FALSE) AS below, coalesce(untaxed, FALSE) AS untaxed FROM h LEFT JOIN s ON s.doc_id = h.doc_id),
i1 AS (SELECT *, coalesce(abs(subtotal - raw_sum) <= 0.02::DOUBLE, FALSE) AND {_apart('coalesce(own_sum, 0)', 'subtotal')} AND coalesce({_fits('raw_sum')}, FALSE) AS as_read, taxed AND NOT (grossed AND netted AND (below OR untaxed)) AS reliable FROM i0),
i2 AS (SELECT *, CASE WHEN as_read THEN plain_sum ELSE own_sum END AS line_sum, grossed AND (netted OR reliable) AS supported FROM i1),
i3 AS (SELECT *, subtotal IS NOT NULL AND line_sum IS NOT NULL AND priced AS both_known FROM i2),
i4 AS (SELECT * REPLACE (CASE WHEN subtotal IS NULL AND line_sum IS NOT NULL THEN nullif(line_sum, 0) WHEN both_known AND {_apart('subtotal', 'line_sum')} AND coalesce({_fits('line_sum')}, FALSE) AND NOT coalesce(abs(total - (subtotal + {_SHIP})) <= 0.02::DOUBLE, FALSE) THEN line_sum
    WHEN NOT both_known AND netted AND {_apart('subtotal', 'net_sum')} THEN net_sum ELSE subtotal END AS subtotal),
  CASE WHEN subtotal IS NULL AND line_sum IS NOT NULL THEN 'derived' WHEN both_known AND {_apart('subtotal', 'line_sum')} AND coalesce({_fits('line_sum')}, FALSE) AND NOT coalesce(abs(total - (subtotal + {_SHIP})) <= 0.02::DOUBLE, FALSE) THEN 'resolved'
    WHEN NOT both_known AND netted AND {_apart('subtotal', 'net_sum')} THEN 'resolved' WHEN subtotal IS NOT NULL THEN 'normalized' END AS subtotal_kind FROM i3),
i5 AS (SELECT * REPLACE (CASE WHEN reliable AND tax_sum IS NOT NULL AND tax IS NULL THEN nullif(tax_sum, 0) WHEN reliable AND tax_sum IS NOT NULL AND {_apart('tax', 'tax_sum')} THEN tax_sum ELSE tax END AS tax),
  CASE WHEN reliable AND tax_sum IS NOT NULL AND tax IS NULL THEN 'derived' WHEN reliable AND tax_sum IS NOT NULL AND {_apart('tax', 'tax_sum')} THEN 'resolved' WHEN tax IS NOT NULL THEN 'normalized' END AS tax_kind0 FROM i4),
i6 AS (SELECT * REPLACE (CASE WHEN tax IS NULL AND coalesce(round(total - subtotal - {_SHIP}, 2) > 0.02::DOUBLE, FALSE) THEN round(total - subtotal - {_SHIP}, 2) ELSE tax END AS tax),
  CASE WHEN tax IS NULL AND coalesce(round(total - subtotal - {_SHIP}, 2) > 0.02::DOUBLE, FALSE) THEN 'derived' ELSE tax_kind0 END AS tax_kind FROM i5),
i7 AS (SELECT * REPLACE (CASE WHEN supported AND gross_sum IS NOT NULL AND total IS NULL THEN nullif(gross_sum, 0) WHEN supported AND gross_sum IS NOT NULL AND {_apart('total', 'gross_sum')} THEN gross_sum ELSE total END AS total),
  CASE WHEN supported AND gross_sum IS NOT NULL AND total IS NULL THEN 'derived' WHEN supported AND gross_sum IS NOT NULL AND {_apart('total', 'gross_sum')} THEN 'resolved' WHEN total IS NOT NULL THEN 'normalized' END AS total_kind0 FROM i6),
i8 AS (SELECT * REPLACE (CASE WHEN total IS NULL THEN subtotal + tax + {_SHIP} ELSE total END AS total), CASE WHEN total IS NULL AND subtotal + tax IS NOT NULL THEN 'derived' ELSE total_kind0 END AS total_kind FROM i7),
i9 AS (SELECT *, line_count > 0 AND NOT priced AS e0, priced AND {_apart('line_sum', 'subtotal')} AS e1, reliable AND {_apart('tax_sum', 'tax')} AS e2, {_apart(f'round(subtotal + tax + {_SHIP}, 2)', 'total')} AS e3, supported AND {_apart('gross_sum', 'total')} AS e4 FROM i8)
SELECT doc_id, round(subtotal, 2) AS subtotal, subtotal_kind, round(tax, 2) AS tax, tax_kind, round(total, 2) AS total, total_kind, as_read AS lines_as_read,
  concat_ws(',', CASE WHEN e0 THEN 'incomplete_line_items' END, CASE WHEN e1 THEN 'subtotal_mismatch' END, CASE WHEN e2 THEN 'tax_mismatch' END, CASE WHEN e3 THEN 'total_mismatch' END, CASE WHEN e4 THEN 'gross_total_mismatch' END) AS issues,
  CASE WHEN e1 OR e2 OR e3 OR e4 THEN 'inconsistent' WHEN subtotal_kind IN ('derived', 'resolved') OR tax_kind IN ('derived', 'resolved') OR total_kind IN ('derived', 'resolved') OR priced OR (subtotal IS NOT NULL AND total IS NOT NULL) THEN 'reconciled'
    WHEN line_count > 0 OR subtotal IS NOT NULL OR total IS NOT NULL OR tax IS NOT NULL THEN 'partial' ELSE 'unavailable' END AS status FROM i9""")
def invoice_ladder(spark, d):
    """Invoices whose subtotal, tax and total the lines and one another fill and settle, with what still does not agree."""
    heads = table(spark, d, "orders").selectExpr("o_orderkey AS doc_id", *[f"{x} AS {n}" for n, x in _HEAD.items()])
    done = reconcile.reconciled(heads, _lines(spark, d))
    figures = [x for f in ("subtotal", "tax", "total") for x in (F.round(f, 2).alias(f), F.col(f"{f}_kind"))]
    return done.select("doc_id", *figures, "lines_as_read", F.array_join("issue_types", ",").alias("issues"), "status")


@query("SELECT l_orderkey AS doc_id, round(sum(l_extendedprice::DECIMAL(18,4)), 2)::DOUBLE AS total FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE l_extendedprice END AS l_extendedprice FROM lineitem) GROUP BY 1")
def line_amount_totals(spark, d):
    shown = F.when(F.col("l_linenumber") % 4 == 3, "n/a").otherwise(F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)))
    return diagnostics.amount_total(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), shown.alias("amount")))


# --- families -------------------------------------------------------------------------------------------------------

_JAC = "(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


def _regions(a: str, b: str) -> str:
    top = " + ".join(f"{_JAC.format(a=f'{a}.{k}', b=f'{b}.{k}')} * {w}::DOUBLE" for k, w in rules.REGION_WEIGHTS.items())
    low = " + ".join(f"CASE WHEN len({a}.{k}) > 0 OR len({b}.{k}) > 0 THEN {w}::DOUBLE ELSE 0::DOUBLE END" for k, w in rules.REGION_WEIGHTS.items())
    return f"(({top}) / ({low}))"


_PART_SQL = """pt AS (SELECT p_partkey, p_brand, p_mfgr, p_size, list_distinct(string_split(p_name, ' ')) AS header, list_distinct(string_split(p_type, ' ')) AS identity, ['s' || p_size % 6, 'c' || p_size % 4] AS summary, [p_mfgr] AS footer FROM (SELECT *, substr(p_brand, 1, 7) AS p_mfgr FROM part)),
px AS (SELECT *, list_distinct(list_concat(list_concat(list_concat(header, identity), summary), footer)) AS generic, CASE WHEN p_size % 2 = 0 THEN ['header_page', 'summary_page'] ELSE ['header_page'] END AS roles, 1 + p_size % 3 AS pages FROM pt)"""
_HEALTH = "greatest(0.6::DOUBLE, least(1.0::DOUBLE, 0.94::DOUBLE * (0.94::DOUBLE + least(f.p_size, 20) * 0.003::DOUBLE) * (0.9::DOUBLE + 0.9::DOUBLE * 0.1::DOUBLE) * (1.0::DOUBLE - least(1::DOUBLE / greatest(f.p_size + 1, 1) * 0.28::DOUBLE, 0.22::DOUBLE))))"


@query(f"""
WITH {_PART_SQL}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM px) WHERE k = 1),
j AS (SELECT d.p_partkey AS doc_id, f.p_brand AS template_family_id, abs((list_contains(f.roles, 'summary_page'))::INT - (list_contains(d.roles, 'summary_page'))::INT) AS strong, abs(f.pages - d.pages) AS apart,
  {_regions('d', 'f')} * 0.52::DOUBLE + 0.5::DOUBLE * 0.24::DOUBLE + {_JAC.format(a='d.roles', b='f.roles')} * 0.16::DOUBLE + {_JAC.format(a='d.header', b='f.header')} * 0.05::DOUBLE + CASE WHEN d.p_mfgr = f.p_mfgr THEN 0.08::DOUBLE ELSE 0 END AS raw, {_HEALTH} AS health FROM px d, f),
s AS (SELECT doc_id, template_family_id, round((raw - (strong * 0.08::DOUBLE + least(apart * 0.015::DOUBLE, 0.06::DOUBLE))) * health, 9) AS score FROM j WHERE strong <= 1)
SELECT doc_id, arg_max(template_family_id, score) AS template_family_id, round(max(score), 3) AS family_score, count(*) AS candidates FROM (SELECT * FROM s WHERE score >= 0.55 ORDER BY template_family_id) GROUP BY 1""")
def family_match(spark, d):
    """The best family of each document by regions, alignment, roles, tokens, provider and the family's health, against all families."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    regions = {"header": words("p_name"), "identity": words("p_type"), "summary": F.array(F.concat(F.lit("s"), (F.col("p_size") % 6).cast("string")), F.concat(F.lit("c"), (F.col("p_size") % 4).cast("string"))), "footer": F.array(F.substring("p_brand", 1, 7))}
    generic = F.array_distinct(F.concat(*regions.values()))
    roles = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("header_page"), F.lit("summary_page"))).otherwise(F.array(F.lit("header_page")))
    px = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.substring("p_brand", 1, 7).alias("provider_name"), F.struct(*[v.alias(k) for k, v in regions.items()], generic.alias("generic")).alias("regions"), roles.alias("roles"), words("p_name").alias("tokens"), (1 + F.col("p_size") % 3).alias("page_count"))
    first = px.groupBy("p_brand").agg(F.min_by(F.struct("p_size", "provider_name", "regions", "roles", "tokens", "page_count"), "p_partkey").alias("r"))
    f = first.select(F.col("p_brand").alias("template_family_id"), F.lit("provisional").alias("status"), F.col("r.p_size").alias("apply_count"), F.lit(1).alias("reject_count"), F.lit(0.9).alias("confidence"), F.lit(0.0).alias("split_pressure"), "r.provider_name", "r.regions", "r.roles", "r.tokens", "r.page_count")
    brands = F.array(*[F.lit(f"Brand#{n}") for n in range(100)])
    docs = px.withColumn("alignment", F.map_from_arrays(brands, F.transform(brands, lambda _: F.lit(0.5)))).withColumnRenamed("p_partkey", "doc_id")
    return routing.family_matches(docs, f).select("doc_id", "template_family_id", "family_score", "candidates")


def _letters(k: str, m: str) -> str:
    return f"list_transform(range(0, 12), lambda j: '{m}' || ({k} // 4) || '_' || (CASE WHEN j = 11 THEN 20 + {k} % 4 ELSE j END))"


_ALIKE_SQL = f"SELECT c_custkey AS k, {_letters('c_custkey', 'h')} AS header, {_letters('c_custkey', 's')} AS summary, ['total'] AS footer, ['n' || (c_custkey // 4)] AS identity, ['total', 'date'] AS generic, c_custkey % 5 AS pages, c_nationkey % 2 AS country, c_custkey % 7 AS a, c_custkey % 3 AS r FROM customer"


@query(f"""
WITH c AS ({_ALIKE_SQL}), j AS (SELECT a.k AS x, b.k AS y, a.a - a.r * 0.5 + 9 AS sa, b.a - b.r * 0.5 + 9 AS sb,
  round({_regions('a', 'b')} * 0.45::DOUBLE + 0.20::DOUBLE + 0.15::DOUBLE + 0.05::DOUBLE + 0.05::DOUBLE + 0.05::DOUBLE + CASE WHEN a.pages = b.pages THEN 0.05::DOUBLE ELSE 0 END, 4) AS similarity FROM c a JOIN c b ON a.k < b.k AND a.country = b.country AND a.k // 4 = b.k // 4)
SELECT CASE WHEN sa >= sb THEN y ELSE x END AS source_id, CASE WHEN sa >= sb THEN x ELSE y END AS target_id, similarity FROM j WHERE similarity >= 0.84""")
def merge_candidates(spark, d):
    """Pairs of families alike enough to merge, the weaker into the stronger. Only families of one group share more than the word total."""
    group, own = F.expr("c_custkey div 4").cast("string"), F.col("c_custkey") % 4
    letters = lambda m: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda j: F.concat(F.lit(m), group, F.lit("_"), F.when(j == 11, 20 + own).otherwise(j).cast("string")))
    one = lambda *xs: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    regions = F.struct(letters("h").alias("header"), one(F.concat(F.lit("n"), group)).alias("identity"), letters("s").alias("summary"), one("total").alias("footer"), one("total", "date").alias("generic"))
    f = table(spark, d, "customer").select(
        F.col("c_custkey").alias("template_family_id"), F.lit("established").alias("status"), regions.alias("regions"), one("header_page").alias("roles"), one("total").alias("fields"), F.lit("p").alias("provider_name"), (F.col("c_nationkey") % 2).cast("string").alias("country_code"),
        F.lit("invoice").alias("document_family"), (F.col("c_custkey") % 5).alias("page_count"), (F.col("c_custkey") % 7).alias("apply_count"), (F.col("c_custkey") % 3).alias("reject_count"), F.lit(0.9).alias("confidence"),
    )
    return routing.merge_candidates(f)


@query("""
WITH o AS (SELECT o_orderkey AS doc_id, p AS page_no, 1 + o_orderkey % 2 AS page_count, upper(substr(md5(o_orderpriority || p), 1, 8)) AS hi, (o_orderkey * 31 + p) % 65536 AS lo FROM orders, (VALUES (0), (1)) AS v(p) WHERE p <= o_orderkey % 2),
k AS (SELECT DISTINCT n_nationkey AS f, p AS page_no, 1 + n_nationkey % 2 AS page_count, upper(substr(md5(q || p), 1, 8)) AS hi, q, (n_nationkey * 2621 + p * 7) % 65536 AS lo FROM nation, (VALUES (0), (1)) AS v(p), (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) AS w(q) WHERE p <= n_nationkey % 2),
d AS (SELECT doc_id, q || '/' || f AS fingerprint_hash, o.page_count, bit_count(xor(('0x' || o.hi)::BIGINT, ('0x' || k.hi)::BIGINT)) + bit_count(xor(o.lo::BIGINT, k.lo::BIGINT)) AS n FROM o JOIN k USING (page_no, page_count))
SELECT doc_id, fingerprint_hash, sum(n)::BIGINT AS total_distance FROM d GROUP BY doc_id, fingerprint_hash, page_count HAVING max(n) <= 12.5 AND count(*) = page_count""")
def fingerprint_match(spark, d):
    """Known layouts all of whose pages are within 12.5 bits of a document's, page by page."""
    low = lambda n: F.lpad(F.hex(n % 65536), 8, "0")
    high = lambda c: F.upper(F.substring(F.md5(F.concat(c, F.col("page_no").cast("string"))), 1, 8))
    pages = lambda k: F.explode(F.sequence(F.lit(0), (k % 2).cast("int"))).alias("page_no")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority", (1 + F.col("o_orderkey") % 2).alias("page_count"), pages(F.col("o_orderkey")))
    o = o.select("doc_id", "page_no", "page_count", F.concat(high(F.col("o_orderpriority")), low(F.col("doc_id") * 31 + F.col("page_no"))).alias("visual_hash"))
    kinds = F.explode(F.array(*[F.lit(q) for q in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])).alias("q")
    k = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("f"), kinds).select("f", "q", (1 + F.col("f") % 2).alias("page_count"), pages(F.col("f")))
    k = k.select(F.concat("q", F.lit("/"), F.col("f").cast("string")).alias("fingerprint_hash"), "page_no", "page_count", F.concat(high(F.col("q")), low(F.col("f") * 2621 + F.col("page_no") * 7)).alias("visual_hash"))
    return routing.near_fingerprints(o, k)


_ERRORS = "list_transform(string_split(coalesce(joined_errors, ''), '|'), lambda e: lower(e))"


@query(f"""WITH {_R}, w AS (SELECT *, {_ERRORS} AS e, row_number() OVER (PARTITION BY template_family_id ORDER BY processed_at DESC, id DESC) AS n FROM r WHERE template_family_id IS NOT NULL),
x AS (SELECT template_family_id, invoice_name, n, len(list_filter(e, lambda v: (contains(v, 'missing extracted field:') OR contains(v, 'mismatch on ')) AND contains(v, 'date'))) > 0 AS a,
  len(list_filter(e, lambda v: contains(v, 'total mismatch') OR contains(v, 'subtotal mismatch') OR ((contains(v, 'missing extracted field:') OR contains(v, 'mismatch on ')) AND (contains(v, 'total') OR contains(v, 'subtotal') OR contains(v, 'tax') OR contains(v, 'amount'))))) > 0 AS b,
  len(list_filter(e, lambda v: contains(v, 'line item count mismatch') OR contains(v, 'line item arithmetic mismatch'))) > 0 OR id % 6 = 0 OR id % 4 = 0 AS c FROM w WHERE n <= 10),
u AS (SELECT template_family_id, 'date_ocr_boost' AS kind, invoice_name, n FROM x WHERE a UNION ALL SELECT template_family_id, 'summary_amount_ocr_boost', invoice_name, n FROM x WHERE b UNION ALL SELECT template_family_id, 'line_item_table_tuning', invoice_name, n FROM x WHERE c),
g AS (SELECT template_family_id, kind, count(*) AS support_count, array_to_string(list(invoice_name ORDER BY n)[1:3], ',') AS example_invoices, regexp_extract(template_family_id, '[0-9]+')::INT AS f FROM u GROUP BY 1, 2 HAVING count(*) >= 2),
h AS (SELECT *, CASE WHEN f % 3 = 0 THEN 'degraded' WHEN f % 10 = 9 THEN 'retired' ELSE 'established' END AS family_status FROM g),
q AS (SELECT *, support_count + CASE kind WHEN 'date_ocr_boost' THEN 0.0::DOUBLE WHEN 'summary_amount_ocr_boost' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN family_status = 'degraded' THEN 1.0::DOUBLE ELSE 0 END AS priority FROM h WHERE family_status <> 'retired' AND NOT (kind = 'line_item_table_tuning' AND f % 2 = 1) AND NOT (kind = 'date_ocr_boost' AND f % 5 = 2))
SELECT template_family_id, family_status, kind, support_count, priority, example_invoices, (row_number() OVER (PARTITION BY template_family_id ORDER BY priority DESC, kind))::INT AS queue_no FROM q""")
def family_update_queue(spark, d):
    """The changes of families' profiles that their last ten results speak for, but for those that a profile has already, in order of priority."""
    r = results(spark, d).withColumns({"table_detected": F.col("id") % 6 != 0, "line_item_source": F.when(F.col("id") % 4 == 0, "row_fallback").otherwise("table")})
    k = F.regexp_extract("template_family_id", "[0-9]+", 0).cast("int")
    tuned = F.when(k % 2 == 1, '"table":{"enabled":true,"row_gap_multiplier":1.1,"min_line_span_fraction":0.2},"postprocess":{"prefer_table_line_items":true},').otherwise("")
    wide = F.when(k % 5 == 2, '"ocr":{"region_buffer_multiplier":1.3,"field_buffer_multipliers":{"date":1.5}},').otherwise("")
    f = r.select("template_family_id").where("template_family_id IS NOT NULL").distinct().select(
        "template_family_id", F.when(k % 3 == 0, "degraded").when(k % 10 == 9, "retired").otherwise("established").alias("status"), F.array(F.lit("vendor")).alias("field_names"),
        profiles.read_profile(F.concat(F.lit("{"), tuned, wide, F.lit('"version":1}'))).alias("profile"),
    )
    found = profiles.suggestions(f, r)
    return found.select("template_family_id", "family_status", "kind", "support_count", "priority", F.array_join("example_invoices", ",").alias("example_invoices"), "queue_no")


# --- what runs leave behind -----------------------------------------------------------------------------------------


@query(f"""WITH {_R}, x AS (SELECT id, attempted_route, validation_score, string_split(coalesce(joined_errors, ''), '|') AS es, joined_errors IS NOT NULL AS said FROM r),
y AS (SELECT *, CASE WHEN said THEN len(list_filter(es, lambda e: starts_with(e, 'Missing extracted field:'))) ELSE 0 END AS missing, CASE WHEN said THEN len(list_filter(es, lambda e: starts_with(e, 'Mismatch on '))) ELSE 0 END AS wrong,
  said AND len(list_filter(es, lambda e: starts_with(e, 'Line item arithmetic mismatch') OR starts_with(e, 'Subtotal mismatch:') OR starts_with(e, 'Total mismatch:'))) > 0 AS arithmetic FROM x)
SELECT id, missing::INT AS scalar_field_missing_count, wrong::INT AS scalar_field_mismatch_count, coalesce(said AND wrong >= greatest(2, missing + 1) AND attempted_route = 'APPLY', FALSE) AS wrong_template_suspected,
  CASE WHEN validation_score IS NOT NULL OR id % 5 < 2 THEN id % 5 = 0 OR arithmetic END AS reconciliation_failure, validation_score < 1.0::DOUBLE AS validator_policy_failure FROM y""")
def result_diagnostics(spark, d):
    """Counts of failing fields, wrong templates and figures that do not add up, of every result."""
    status = F.when(F.col("id") % 5 == 0, "inconsistent").when(F.col("id") % 5 == 1, "reconciled")
    found = diagnostics.diagnostics(results(spark, d).withColumn("reconciliation_status", status))
    return found.select("id", "scalar_field_missing_count", "scalar_field_mismatch_count", "wrong_template_suspected", "reconciliation_failure", "validator_policy_failure")


@query(f"""WITH {_R}, u AS (SELECT id, unnest(string_split(joined_errors, '|')) AS e FROM r WHERE joined_errors IS NOT NULL)
SELECT id, e AS error, CASE WHEN starts_with(e, 'Missing extracted field:') THEN 'missing ' || trim(split_part(e, ':', 2)) WHEN starts_with(e, 'Mismatch on ') THEN 'mismatch on ' || trim(split_part(replace(e, 'Mismatch on ', ''), ':', 1)) WHEN starts_with(e, 'Line item count mismatch:') THEN 'line-item count mismatch'
  WHEN starts_with(e, 'Line item arithmetic mismatch') THEN 'line-item arithmetic mismatch' WHEN starts_with(e, 'Subtotal mismatch:') THEN 'subtotal does not match line items' WHEN starts_with(e, 'Total mismatch:') THEN 'total does not match subtotal + tax'
  WHEN starts_with(e, 'Currency mismatch for country') THEN 'country/currency mismatch' ELSE e END AS shown FROM u""")
def simplified_errors(spark, d):
    u = results(spark, d).select("id", F.explode("validation_errors").alias("error"))
    return u.withColumn("shown", diagnostics.simplified_error(F.col("error")))


@query(f"""WITH {_R}, p AS (SELECT o_orderkey AS k FROM orders), b AS (SELECT id AS k, CASE WHEN error IS NOT NULL THEN 'error' WHEN validation_passed THEN 'accepted' WHEN validation_passed IS NOT NULL THEN 'rejected' ELSE 'unvalidated' END AS s, validation_score AS v FROM r),
j AS (SELECT p.k, coalesce(b.s, 'missing') AS before_status, coalesce(a.s, 'missing') AS after_status, round(a.v - b.v, 4) AS score_delta FROM p LEFT JOIN b ON b.k = p.k LEFT JOIN b AS a ON a.k = p.k + 1)
SELECT 'p' || k AS invoice_path, before_status, after_status, score_delta, CASE WHEN before_status <> 'accepted' AND after_status = 'accepted' THEN 'fixed' WHEN before_status = 'accepted' AND after_status <> 'accepted' THEN 'broken' WHEN score_delta > 0 THEN 'improved' WHEN score_delta < 0 THEN 'declined' ELSE 'unchanged' END AS change FROM j""")
def benchmark_comparison(spark, d):
    """A benchmark's invoices before and after a change; here the later run has each order's neighbour's result."""
    r = results(spark, d)
    before = r.withColumn("invoice_path", F.concat(F.lit("p"), F.col("id").cast("string")))
    after = r.withColumn("invoice_path", F.concat(F.lit("p"), (F.col("id") - 1).cast("string")))
    return diagnostics.compared(before, before, after).select("invoice_path", "before_status", "after_status", "score_delta", "change")


@query(f"""WITH {_R}, e AS (SELECT template_family_id, 'in/' || id AS p FROM r WHERE id % 3 = 0), x AS (SELECT template_family_id, 'in/' || (id // 2) AS p FROM r)
SELECT DISTINCT template_family_id, p AS invoice_path FROM (SELECT * FROM e UNION ALL SELECT * FROM x) WHERE template_family_id IS NOT NULL""")
def family_example_paths(spark, d):
    r = results(spark, d)
    path = lambda k: F.concat(F.lit("in/"), k.cast("string"))
    return diagnostics.example_paths(r.where("id % 3 = 0").withColumn("invoice_path", path(F.col("id"))), r.withColumn("invoice_path", path(F.expr("id div 2"))))


@query("""SELECT o_custkey AS template_family_id, arg_min(o_orderkey, row(-(o_orderkey % 13), -(o_orderkey * 37 % 101), -(o_orderkey % 7), o_orderdate, o_orderkey)) AS fingerprint_hash FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def scored_representative(spark, d):
    k = F.col("o_orderkey")
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("template_family_id"), k.alias("fingerprint_hash"), (k % 13).alias("score"), (k * 37 % 101).alias("confidence"), (k % 7).alias("apply_count"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "P", "retired").otherwise("x").alias("status"))
    return diagnostics.scored_representative(f).select("template_family_id", "fingerprint_hash")


@query(f"""WITH {_R}, c AS (SELECT o_custkey AS f, o_orderkey AS h, o_orderkey % 3 AS cluster FROM orders), p AS (SELECT id + 1 AS h, count(*) AS n, count(*) FILTER (validation_passed) AS ok FROM r GROUP BY 1), j AS (SELECT f, cluster, n, ok, CASE WHEN h % 4 = 0 THEN 'inv-' || h END AS name FROM c LEFT JOIN p USING (h))
SELECT f AS template_family_id, cluster, count(*) AS fingerprints, coalesce(sum(n), 0)::BIGINT AS results, coalesce(sum(ok), 0)::BIGINT AS accepted, coalesce(array_to_string(list_sort(list_distinct(list(name) FILTER (name IS NOT NULL)))[1:3], ','), '') AS example_names FROM j GROUP BY 1, 2""")
def cluster_members(spark, d):
    """Clusters of a family's fingerprints with the results and examples of their members."""
    o = table(spark, d, "orders")
    clusters = o.select(F.col("o_custkey").alias("template_family_id"), F.col("o_orderkey").alias("fingerprint_hash"), (F.col("o_orderkey") % 3).alias("cluster"))
    r = results(spark, d).withColumn("fingerprint_hash", F.col("id") + 1)
    e = o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("fingerprint_hash"), F.concat(F.lit("inv-"), F.col("o_orderkey").cast("string")).alias("invoice_name"))
    return diagnostics.cluster_members(clusters, r, e).withColumn("example_names", F.array_join("example_names", ","))


@query(f"""WITH {_R} SELECT id, invoice_name FROM r WHERE (validation_passed = FALSE OR (validation_passed IS NULL AND route = 'REJECTED')) AND id % 100 // 10 = 3""")
def failed_below_folder(spark, d):
    """What failed below a folder whose name has signs of a pattern."""
    r = results(spark, d).withColumn("invoice_path", F.concat(F.lit("in/a_%"), F.expr("id % 100 div 10").cast("string"), F.lit("/"), "invoice_name"))
    return diagnostics.failed_below(r, "in/a_%3").select("id", "invoice_name")


_RECORD = """CASE o_orderkey % 4 WHEN 0 THEN '{"document":{"seller":"Acme","invoice no":"' || o_orderkey || '"},"Total":"$' || CAST(o_custkey AS VARCHAR) || '.50"}'
  WHEN 1 THEN '{"schemaVersion":"gt-v2","document":{"invoiceNumber":{"status":"present","value":"' || o_orderkey || '"},"sellerName":{"status":"derived","value":"Acme"}},"summary":{"totalAmount":{"status":"present","value":' || o_custkey || '}}}'
  WHEN 2 THEN '{"vendor":{"value":"Harbor"},"VAT":"n/a","line_items":[{"qty":"2"},{"qty":"3"}]}' ELSE '{"foo":1}' END"""


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN o_orderkey::VARCHAR END AS invoice_number, CASE o_orderkey % 4 WHEN 0 THEN 'Acme' WHEN 2 THEN 'Harbor' END AS seller, CASE o_orderkey % 4 WHEN 0 THEN o_custkey + 0.5::DOUBLE WHEN 1 THEN o_custkey::DOUBLE END AS total,
  CASE o_orderkey % 4 WHEN 2 THEN 2 WHEN 3 THEN NULL ELSE 0 END::INT AS n_lines, o_orderkey % 4 < 2 AS ready FROM orders""")
def ground_truth_records(spark, d):
    """Ground-truth records of both generations as canonical fields and lines."""
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), truth.normalized_truth(F.expr(_RECORD.replace("VARCHAR", "STRING"))).alias("t"))
    field = lambda k: F.col("t.fields")[k]
    return t.select("doc_id", field("invoiceNumber").alias("invoice_number"), field("sellerName").alias("seller"), field("totalAmount").cast("double").alias("total"), F.when(F.col("t").isNotNull(), F.size("t.lines")).alias("n_lines"), truth.discovery_ready(F.col("t")).alias("ready"))


@query(f"SELECT c_custkey AS doc_id, {_ocr('c_name')} AS plain, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS value FROM customer")
def value_by_alias(spark, d):
    """The value under the first of several names that a record has."""
    record = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("Customer-Name"), F.col("c_name"), F.lit("x"), F.lit("y"))).otherwise(F.create_map(F.lit("PHONE"), F.col("c_mktsegment")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), ocr_text(F.col("c_name")).alias("plain"), diagnostics.value_by_alias(record, ["customername", "phone"]).alias("value"))


@query("SELECT p_partkey AS doc_id, array_to_string(list_transform(['$ 5.00', '$5.00', p_partkey || '.10', '5 .00', p_partkey || '.10'][1:CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 2 END], lambda x: x), '|') AS given, CASE WHEN p_partkey % 2 = 0 THEN '$ 5.00|' || p_partkey || '.10|5 .00' ELSE '$ 5.00' END AS kept FROM part")
def distinct_candidates(spark, d):
    five = F.array(F.lit("$ 5.00"), F.lit("$5.00"), F.concat(F.col("p_partkey").cast("string"), F.lit(".10")), F.lit("5 .00"), F.concat(F.col("p_partkey").cast("string"), F.lit(".10")))
    given = F.slice(five, F.lit(1), F.when(F.col("p_partkey") % 2 == 0, 5).otherwise(2))
    x = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), given.alias("g"))
    return x.select("doc_id", F.array_join("g", "|").alias("given"), F.array_join(cl.distinct_candidates(F.col("g")), "|").alias("kept"))
