"""Values without a label's region: candidates of whole pages by score, and fields settled by what was read around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import classify as cl
from ledgerloom.functions import dates
from ledgerloom.functions.labels import FIELD_SPECS
from ledgerloom.functions.numbers import plain_number, token_number
from ledgerloom.functions.text import first_matching, key, let, ocr_text, words

PAGE = ["doc_id", "page_no"]
DATES = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{2,4}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b"
NUMBERS = r"(?i)\b[A-Z0-9][A-Z0-9./-]{2,}\b"
CONCEPTS = {"subtotal": ("subtotal",), "tax": ("tax",), "shipping": ("shipping",), "total": ("invoice_total", "amount_due", "balance_due")}


def _all(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.trim(v)))


def day(value: Column, country: Column | None = None) -> Column:
    """A text as a plausible DATE, else null."""
    d = dates.parsed(value, F.lit(None).cast("string") if country is None else country)
    return F.when(dates.plausible(d), d)


def concepts(plain: Column) -> Column:
    """Which sums a plain text speaks of; a subtotal or a tax is not the total as well."""
    named = F.array_compact(F.array(*[F.when(cl.contains_any(plain, ws), F.lit(k)) for k, ws in cl.SUMMARY_CUES.items()]))
    sums = F.array(*map(F.lit, CONCEPTS["total"]))
    return F.when(F.array_contains(named, "subtotal") | F.array_contains(named, "tax"), F.array_except(named, sums)).otherwise(named)


def fallback_values(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, page_no, field, value, score): the best candidate of each field on each page that scores enough.

    ``rows``: tokens with row_no and place; ``texts``: ``rows.row_texts`` of them. Dates come from rows in the upper 60 % of the
    page (a due date from rows that say so), invoice numbers from tokens in the upper 40 %, sums from rows that name them
    and are no table, no metadata and no more than three amounts. Of equal scores the first in reading order wins.
    """
    c = F.col
    x, y = c("x") / F.greatest("page_w", F.lit(1)), c("y") / F.greatest("page_h", F.lit(1))
    t = texts.withColumns({"p": ocr_text(c("text")), "rx": x, "ry": y})
    dated = t.where("ry <= 0.6").select(*PAGE, "row_no", "p", "rx", "ry", F.posexplode(_all(c("text"), DATES)).alias("place", "value"))
    dated = dated.withColumn("score", cl.date_candidate_score(day(c("value")), c("rx"), c("ry")))
    invoice = dated.select(*PAGE, F.lit("invoiceDate").alias("field"), "value", "score", "row_no", "place")
    due = dated.where(c("p").contains("due")).select(*PAGE, F.lit("dueDate").alias("field"), "value", "score", "row_no", "place")

    token = rows.select(*PAGE, "row_no", "place", F.trim("text").alias("token"), x.alias("x"), y.alias("y"))
    own = token.join(t.select(*PAGE, "row_no", "text", "p", "rx", "ry"), [*PAGE, "row_no"])
    figures = own.where(c("token").rlike(r"\d") & (c("ry") <= 0.4) & ~c("token").rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"))
    figures = figures.withColumn("value", cl.clean_candidate(F.lit("invoiceNumber"), c("token"))).where("value IS NOT NULL")
    digits = F.regexp_replace("value", r"\D", "")
    beside = F.when(c("p").contains("invoice") | c("p").contains("no"), F.lit(0.18) + F.when(F.length(digits).between(2, 6) & (F.length(digits) != 4), 0.08).otherwise(0.0)).otherwise(0.0)
    number = figures.select(*PAGE, F.lit("invoiceNumber").alias("field"), "value", (cl.invoice_candidate_score(c("value"), c("x"), c("y")) + beside).alias("score"), "row_no", "place")

    named = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.array(*map(F.lit, ks)).alias("ks")) for f, ks in CONCEPTS.items()]), lambda f: F.arrays_overlap(f["ks"], concepts(c("p"))))
    plain = ~cl.mixed(c("text"), c("p")) & ~cl.tableish(c("text"), c("p")) & ~cl.metadataish(c("text"), c("p")) & (F.size(_all(c("text"), cl.AMOUNT_TOKEN)) < 4)
    fields = F.explode(F.transform(named, lambda f: f["field"])).alias("field")
    by_token = own.where(plain).select(*PAGE, "row_no", "place", "text", "token", "x", "y", fields).withColumn("value", cl.clean_candidate(c("field"), c("token")))
    by_token = by_token.where(~cl.percentage_of(c("token"), c("text")))
    by_row = t.where(plain).select(*PAGE, "row_no", "text", c("rx").alias("x"), c("ry").alias("y"), fields, F.posexplode(_all(c("text"), cl.AMOUNT_TOKEN)).alias("place", "value")).where(~cl.percentage_of(c("value"), c("text")))
    sums = [(by_token, 0.0), (by_row, -0.05)]
    amounts = [df.where(token_number(c("value")) >= 0).select(*PAGE, "field", "value", (cl.amount_candidate_score(c("field"), c("value"), c("x"), c("y"), c("text")) + less).alias("score"), "row_no", "place") for df, less in sums]

    every = invoice
    for more in (due, number, *amounts):
        every = every.unionByName(more)
    every = every.withColumn("score", F.round("score", 6)).where(c("score") >= cl.candidate_reach(c("field")))
    best = every.groupBy(*PAGE, "field").agg(F.max_by(F.struct("value", "score"), F.struct("score", -c("row_no"), -c("place"))).alias("b"))
    return best.select(*PAGE, "field", "b.value", "b.score")


def with_fallbacks(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """``fields.values`` with the fallback value of each field that no label gave, at its score, 1 at most."""
    missing = fallback.join(found.select(*PAGE, "field"), [*PAGE, "field"], "left_anti")
    critical = F.col("field").isin(*[f for f, spec in FIELD_SPECS.items() if spec[2]])
    return found.unionByName(missing.select(*PAGE, "field", critical.alias("critical"), "value", F.round(F.least("score", F.lit(1.0)), 4).alias("confidence")))


def label_neighbours(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, page_no, label, text): what stands to the right of the token that spells a label, or one of its words, best.

    ``labels``: doc_id, page_no, label. A third of the token's letters may differ, one at least; of equally near tokens the first in
    reading order counts. A row's tokens are those whose centres are within the larger height, left of 95 % of the page.
    """
    c = F.col
    l = labels.select(*PAGE, "label", key(c("label")).alias("k"), F.filter(F.transform(words(c("label")), key), lambda w: w != "").alias("ws")).where("k != ''")  # noqa: E741
    t = tokens.select(*PAGE, "token_seq", "text", "x", "y", "w", "h", "page_w", key(c("text")).alias("tk"))
    edits = F.array_min(F.transform(F.concat(F.array("k"), "ws"), lambda w: F.levenshtein("tk", w)))
    met = l.join(t.where("tk != ''"), PAGE).withColumn("edits", edits)
    best = met.groupBy(*PAGE, "label").agg(F.min_by(F.struct("token_seq", "x", "y", "w", "h", "edits", "tk"), F.struct("edits", "token_seq")).alias("b")).where("b.edits <= greatest(1, length(b.tk) div 3)")
    near = F.abs((c("y") + c("h") / 2) - (c("b.y") + c("b.h") / 2)) <= F.greatest("b.h", "h")
    right = best.join(t, PAGE).where(near & (F.trim("text") != "") & (c("x") > c("b.x") + c("b.w")) & (c("x") <= c("page_w") * 0.95))
    lines = F.array_sort(F.collect_list(F.struct(F.floor((c("y") + c("h") / 2) / F.greatest("h", F.lit(1))), "x", "token_seq", F.trim("text").alias("text"))))
    return right.groupBy(*PAGE, "label").agg(F.array_join(F.transform(lines, lambda v: v["text"]), " ").alias("text"))


def settled_number(current: Column, region: Column, neighbour: Column) -> Column:
    """The invoice number among the current text and what was read around it; the current one unless another is clearly better."""

    def of(x: Column) -> Column:
        now = x["now"]
        # A text counts where it comes first: the current one, then the neighbours, then the region.
        first = F.filter(x["all"], lambda v, i: F.array_position(F.transform(x["all"], lambda u: u["t"]), v["t"]) == i + 1)
        bonus = lambda v, s: F.when(v["from"] == 0, F.when(s >= 8.0, 0.75).otherwise(0.0)).when(v["from"] == 1, 0.5).otherwise(0.0)
        letters = lambda t: F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
        scored = F.transform(first, lambda v: let(cl.invoice_number_score(v["t"], x["ref"]), lambda s: F.struct((s + bonus(v, s)).alias("s"), F.length(F.regexp_replace(v["t"], r"\D", "")).alias("d"), (-letters(v["t"])).alias("a"), v["t"].alias("t"))))
        ranked = F.sort_array(scored, asc=False)
        best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        plain = best["t"].rlike(r"\d") & ~best["t"].rlike("[A-Za-z]") & second["t"].rlike("[A-Za-z]") & (best["s"] >= second["s"] + 0.5)
        clear = best["s"] >= F.greatest(F.lit(3.0), F.coalesce(second["s"] + 1.5, F.lit(3.0)))
        return F.when(F.size(ranked) > 0, F.when(F.coalesce(plain, F.lit(False)) | clear, best["t"])), F.coalesce(F.nullif(now, F.lit("")), current)

    def chosen(x: Column) -> Column:
        best, kept = of(x)
        return F.coalesce(best, kept)

    found = lambda text, k: F.transform(F.filter(_all(cl.invoice_number_text(text), NUMBERS), lambda v: v.rlike(r"\d")), lambda v: F.struct(cl.invoice_number_text(v).alias("t"), F.lit(k).alias("from")))
    now = cl.invoice_number_text(current)
    own = F.filter(F.array(F.struct(now.alias("t"), F.lit(0).alias("from"))), lambda v: v["t"] != "")
    every = F.concat(own, found(neighbour, 1), found(region, 2))
    return let(F.struct(now.alias("now"), every.alias("all"), F.coalesce(F.nullif(now, F.lit("")), current).alias("ref")), chosen)


def settled_sum(field: Column, current: Column, candidates: Column, subtotal: Column, tax: Column, total: Column) -> Column:
    """A sum's text among the candidates, by what the other sums make of it; the current one where they say nothing.

    A total is the candidate nearest subtotal and tax if it is nearer than the current one; else, where the current one is too small, the
    least that is larger than the subtotal. A tax is the one nearest total less subtotal; else, where it is too small, the least
    larger one up to half the subtotal. A subtotal is the one nearest total less tax.
    """

    def of(s: Column) -> Column:
        v, now, low = s["v"], s["now"], F.lower(field)
        reference = F.greatest(F.coalesce(subtotal, F.lit(0.0)), F.coalesce(total, F.lit(0.0)), F.coalesce(tax, F.lit(0.0)))
        is_total, is_tax = low.contains("total") & ~low.contains("subtotal") | low.contains("amount"), low.contains("tax")
        tiny = now.isNull() | ((reference >= 100) & (now <= 20)) | (is_total & (subtotal >= 50) & (now + 0.01 < subtotal * 0.5)) | (is_tax & (subtotal >= 100) & (now <= F.greatest(F.lit(20.0), subtotal * 0.02)))
        tiny = F.coalesce(tiny, F.lit(False))

        def nearest(target: Column) -> Column:
            best = F.get(F.array_sort(F.transform(v, lambda x, i: F.struct(F.abs(x["n"] - target).alias("far"), i.alias("i"), x["t"].alias("t")))), F.lit(0))
            return F.when(target.isNotNull() & (now.isNull() | (best["far"] + 0.01 < F.abs(now - target))), best["t"])

        least = lambda keep: F.get(F.array_sort(F.transform(F.filter(v, keep), lambda x, i: F.struct(x["n"].alias("n"), i.alias("i"), x["t"].alias("t")))), F.lit(0))["t"]
        above = least(lambda x: x["n"] > subtotal + 0.01)
        small_total = F.when(subtotal.isNotNull() & (tiny | now.isNull() | (now <= subtotal + 0.01)), above)
        small_tax = F.when(tiny, least(lambda x: (x["n"] > 0) & (x["n"] <= subtotal * 0.5) & (x["n"] > F.greatest(F.coalesce(now, F.lit(0.0)), F.lit(0.0)) + 0.01)))
        by_others = first_matching([
            (is_total, F.coalesce(nearest(subtotal + tax), small_total)), (is_tax & F.coalesce(total >= subtotal, F.lit(False)), nearest(total - subtotal)), (is_tax, small_tax),
            (low.contains("subtotal") & F.coalesce(total >= tax, F.lit(False)), nearest(total - tax)),
        ])
        only = F.get(s["c"], F.lit(0))
        return F.when(F.size(s["c"]) == 1, only).when(F.size(v) <= 1, current).otherwise(F.coalesce(by_others, current))

    distinct = cl.distinct_candidates(F.coalesce(candidates, F.array().cast("array<string>")))
    numbers = F.filter(F.transform(distinct, lambda t: F.struct(plain_number(t).alias("n"), t.alias("t"))), lambda x: x["n"].isNotNull())
    return let(F.struct(distinct.alias("c"), numbers.alias("v"), plain_number(current).alias("now")), of)


def labelled_party(rows: DataFrame) -> DataFrame:
    """(doc_id, page_no, field, value, score): the best phrase to the right of a party's label in the same row.

    Phrases are runs of up to eight tokens for a customer and five for a seller, and the whole run up to a word of another field.
    """
    # The labels of parties within a row.
    aliases = {"sellerName": ("seller", "vendor", "supplier", "from", "remit"), "customerName": ("bill to", "customer", "buyer", "client", "invoice to", "ship to")}
    c = F.col
    row = Window.partitionBy(*PAGE, "row_no").orderBy("place")
    r = rows.withColumn("k", key(c("text")))
    tokens = r.groupBy(*PAGE, "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "k", "text"))), lambda t: F.struct(t["k"].alias("k"), t["text"].alias("text"))).alias("t"))
    spec = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("rank"), F.array(*[F.lit(w) for w in a.split()]).alias("ws")) for f, xs in aliases.items() for i, a in enumerate(xs)])
    ks = F.transform("t", lambda t: t["k"])
    at = lambda a: F.array_min(F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.slice(ks, i, F.size(a["ws"])) == a["ws"]))
    hit = tokens.select(*PAGE, "row_no", "t", F.explode(spec).alias("a")).withColumn("at", at(c("a"))).where("at IS NOT NULL")
    first = hit.groupBy(*PAGE, "row_no", c("a.field").alias("field")).agg(F.min_by(F.struct("t", (c("at") + F.size("a.ws")).alias("from")), "a.rank").alias("h"))
    right = first.select(*PAGE, "row_no", "field", F.slice("h.t", c("h.from"), F.greatest(F.size("h.t") - c("h.from") + 1, F.lit(0))).alias("t")).where(F.size("t") > 0)
    stop = F.array_position(F.transform("t", lambda t: t["k"].isin(*cl.NAME_STOPS)), True).cast("int")
    longest = F.when(c("field") == "customerName", 8).otherwise(5)
    name = lambda xs: cl.trimmed_party(F.array_join(F.transform(xs, lambda t: t["text"]), " "))
    whole = F.struct(F.lit(0).alias("from"), F.when(stop > 0, stop - 1).otherwise(F.size("t")).alias("n"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.transform(F.sequence(F.lit(1), F.least(longest, F.size("t") - i + 1)), lambda n: F.struct(i.alias("from"), n.alias("n")))))
    each = right.select(*PAGE, "row_no", "field", "t", F.posexplode(F.concat(F.array(whole), runs)).alias("i", "run"))
    each = each.withColumn("value", name(F.slice("t", F.greatest("run.from", F.lit(1)), F.col("run.n"))))
    each = each.withColumn("score", F.round(cl.party_candidate_score(c("field"), c("value")), 6)).where(c("score") >= F.when(c("i") == 0, 1.25).otherwise(1.1))
    best = each.groupBy(*PAGE, "field").agg(F.max_by(F.struct("value", "score"), F.struct("score", -c("row_no"), -c("i"))).alias("b"))
    return best.select(*PAGE, "field", "b.value", "b.score")


def refined(fields: DataFrame) -> DataFrame:
    """Fields (doc_id, field, value, region, neighbour: the texts in the field's region and beside its label) with ``refined``.

    Dates, numbers and sums are settled by the candidates in both texts; sums as the document's others make of them.
    """
    c = F.col
    both = F.concat_ws(" ", "region", "neighbour")
    low = F.lower("field")
    sums = {"subtotal": low == "subtotal", "tax": low == "tax", "total": low.isin("total", "totalamount")}
    doc = fields.groupBy("doc_id").agg(*[F.max(F.when(when, plain_number(c("value")))).alias(f"__{k}") for k, when in sums.items()])
    j = fields.join(doc, "doc_id")
    dated = cl.settled_date(c("value"), _all(both, DATES), day)
    number = settled_number(c("value"), c("region"), c("neighbour"))
    amount = settled_sum(c("field"), c("value"), _all(both, cl.AMOUNT_TOKEN), c("__subtotal"), c("__tax"), c("__total"))
    made = first_matching([(low.contains("date"), dated), (cl.is_sum(c("field")), amount), (low.contains("invoice") & (low.contains("number") | low.endswith("no")), number)], c("value"))
    return j.withColumn("refined", made).drop("__subtotal", "__tax", "__total")


def readability(tokens: DataFrame) -> DataFrame:
    """(doc_id, page_no, angle, score): how readable the tokens (text, confidence in percent) of a page at an angle are.

    A token adds its confidence, and more for two letters, two digits or three capitals; what has neither letter nor digit adds nothing.
    """
    c = F.col
    t = F.trim("text")
    letters, digits = F.length(F.regexp_replace(t, r"[^\p{L}]", "")), F.length(F.regexp_replace(t, r"\D", ""))
    upper = (F.upper(t) == t) & (letters >= 3)
    own = c("confidence") / 100 + F.when(letters >= 2, 0.5).when(digits >= 2, 0.2).otherwise(0.0) + F.when(upper, 0.1).otherwise(0.0)
    counted = F.when((c("confidence") >= 0) & (letters + digits > 0), own)
    return tokens.groupBy(*PAGE, "angle").agg(F.round(F.coalesce(F.sum(counted.cast("decimal(18,6)")), F.lit(0)), 4).cast("double").alias("score"))


def upright(scores: DataFrame) -> DataFrame:
    """(doc_id, page_no, angle): 180 where it reads better by more than a tenth and by more than 1, else 0."""
    at = lambda a: F.coalesce(F.max(F.when(F.col("angle") == a, F.col("score"))), F.lit(0.0))
    per = scores.groupBy(*PAGE).agg(at(0).alias("a"), at(180).alias("b"))
    return per.select(*PAGE, F.when((F.col("b") > F.col("a") * 1.1) & (F.col("b") > F.col("a") + 1.0), 180).otherwise(0).alias("angle"))


def quality_gate(pages: DataFrame, buffer: int = 8, multiplier: int = 2) -> DataFrame:
    """(doc_id, quality_flag, region_buffer): a document is flagged if one of its pages is, and its regions are then wider."""
    per = pages.groupBy("doc_id").agg(F.coalesce(F.bool_or("quality_flag"), F.lit(False)).alias("quality_flag"))
    return per.withColumn("region_buffer", F.when(F.col("quality_flag"), buffer * multiplier).otherwise(buffer))
