"""Fields on pages: labels found among the rows' phrases, and the values that stand by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.labels import FIELD_SPECS
from ledgerloom.functions.numbers import token_number
from ledgerloom.functions.text import first_matching, ocr_text, squeezed

MIN_LABEL = 0.72
AMOUNT, DATE = r"[$€£]?\s?[0-9][0-9,]*[.][0-9]{2}", r"[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{2,4}"

# The words of summary rows.
SUMMARY_LABELS = {
    "subtotal": ("subtotal", "sub total", "net amount"),
    "tax": ("tax", "vat", "gst", "hst", "sales tax"),
    "shipping": ("shipping", "handling", "freight"),
    "invoice_total": ("invoice total", "grand total", "total"),
    "amount_due": ("amount due",),
    "balance_due": ("balance due",),
    "total_due": ("total due",),
}


def aliases(spark) -> DataFrame:
    """(field, kind, below, critical, alias) of the fixed specifications."""
    return spark.createDataFrame([(f, kind, at == "below", critical, a) for f, (kind, at, critical, names) in FIELD_SPECS.items() for a in names], "field string, kind string, below boolean, critical boolean, alias string")


def phrases(rows: DataFrame, longest: int = 4) -> DataFrame:
    """Runs of 1 to ``longest`` neighbouring tokens of each row with their bounds."""
    w = Window.partitionBy("doc_id", "page_no", "row_no").orderBy("place")
    token = F.struct("text", "x", "y", "w", "h")
    x = rows.withColumn("run", F.filter(F.array(token, *[F.lead(token, k).over(w) for k in range(1, longest)]), lambda t: t.isNotNull()))
    x = x.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("run")))).withColumn("run", F.slice("run", F.lit(1), F.col("n")))
    right, low = F.array_max(F.transform("run", lambda t: t["x"] + t["w"])), F.array_max(F.transform("run", lambda t: t["y"] + t["h"]))
    left, top = F.array_min(F.transform("run", lambda t: t["x"])), F.array_min(F.transform("run", lambda t: t["y"]))
    return x.select("doc_id", "page_no", "row_no", "place", "n", "page_w", "page_h", F.array_join(F.transform("run", lambda t: t["text"]), " ").alias("phrase"), left.alias("x"), top.alias("y"), (right - left).alias("w"), (low - top).alias("h"))


def paged(tokens: DataFrame) -> DataFrame:
    """A row a page, with an array of each of its tokens' columns."""
    each = ("token_seq", "text", "x", "y", "w", "h")
    known = tokens.where("doc_id IS NOT NULL AND page_no IS NOT NULL")
    pages = known.groupBy("doc_id", "page_no").agg(F.collect_list(F.struct(*each)).alias("t"), F.first("page_w").alias("page_w"), F.first("page_h").alias("page_h"))
    return pages.select("doc_id", "page_no", *[F.col(f"t.{c}").alias(c) for c in each], "page_w", "page_h")


def discovered(pages: DataFrame, floor: float = MIN_LABEL) -> DataFrame:
    """(doc_id, page_no, field, value, confidence, page_confidence) of pages as ``paged`` gives them.

    Each field's best label of a page has a region; amounts are the last one in it, dates the first; names are its first line.
    """
    from ledgerloom.page.discovery import FOUND, finder

    longs = [F.col(c).cast("array<long>").alias(c) for c in ("token_seq", "x", "y", "w", "h")]
    whole = pages.select("doc_id", "page_no", "text", *longs, F.col("page_w").cast("long").alias("page_w"), F.col("page_h").cast("long").alias("page_h"))
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema}
    per = whole.mapInArrow(finder(floor), f"doc_id {kinds['doc_id']}, page_no {kinds['page_no']}, found {FOUND}")

    def read(l: Column) -> Column:  # noqa: E741
        text, first, kind = F.array_join(l["lines"], " "), F.get(l["lines"], F.lit(0)), l["kind"]
        amount = F.try_element_at(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)), F.lit(-1))
        date = F.nullif(F.regexp_extract(text, DATE, 0), F.lit(""))
        value = first_matching([(kind == "currency", amount), (kind == "date", F.coalesce(date, squeezed(first))), (kind == "address", squeezed(first))], squeezed(F.regexp_replace(first, "^[:#\\s]+", "")))
        return F.struct(l["field"].alias("field"), l["critical"].alias("critical"), F.nullif(value, F.lit("")).alias("value"), F.round(l["score"], 4).alias("confidence"))

    of = per.withColumn("found", F.filter(F.transform("found", read), lambda v: v["value"].isNotNull())).where(F.size("found") > 0)
    critical = sum(spec[2] for spec in FIELD_SPECS.values())
    mean = F.aggregate("found", F.lit(0.0), lambda s, v: s + v["confidence"]) / F.size("found")
    page = 0.6 * mean + 0.15 * F.size("found") / len(FIELD_SPECS) + 0.25 * F.size(F.filter("found", lambda v: v["critical"])) / critical
    return of.select("doc_id", "page_no", F.round(page, 4).alias("page_confidence"), F.explode("found").alias("v")).select("doc_id", "page_no", "v.*", "page_confidence")


def values(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, field, critical, value, confidence): ``discovered`` without what it says of whole pages."""
    return discovered(pages).drop("page_confidence")


def page_discovery(tokens: DataFrame) -> DataFrame:
    """``discovered`` of a table of tokens, whose pages are brought together first."""
    return discovered(paged(tokens))


def template(found: DataFrame) -> DataFrame:
    """A field's value in a document: that of its last page, with all pages that have one."""
    return found.groupBy("doc_id", "field").agg(F.max_by("value", "page_no").alias("value"), F.max("confidence").alias("confidence"), F.sort_array(F.collect_set("page_no")).alias("pages"))


def summary_candidates(row_texts: DataFrame) -> DataFrame:
    """(doc_id, page_no, row_no, concept, amount): rows that speak of sums, with their last amount."""
    plain = ocr_text(F.col("text"))
    named = F.array_compact(F.array(*[F.when(plain.rlike("(^|[^a-z0-9])(" + "|".join(ws) + ")($|[^a-z0-9])"), F.lit(c)) for c, ws in SUMMARY_LABELS.items()]))
    sums = ["invoice_total", "amount_due", "balance_due", "total_due"]
    only = F.when(F.array_contains(named, "subtotal") | F.array_contains(named, "tax"), F.array_except(named, F.array(*map(F.lit, sums)))).otherwise(named)
    amounts = F.regexp_extract_all("text", F.lit(AMOUNT), F.lit(0))
    x = row_texts.select("doc_id", "page_no", "row_no", only.alias("c"), amounts.alias("a")).where((F.size("a") > 0) & (F.size("a") < 4))
    return x.select("doc_id", "page_no", "row_no", F.explode("c").alias("concept"), token_number(F.element_at("a", -1)).alias("amount"))


def reconciled_summary(candidates: DataFrame) -> DataFrame:
    """A row a document: subtotal, tax, shipping and total; a missing tax is what the total has more, a total no larger than the subtotal is their sum."""
    pick = lambda *names: F.max_by(F.when(F.col("concept").isin(*names), F.col("amount")), F.when(F.col("concept").isin(*names), F.struct("page_no", "row_no")))
    per = candidates.groupBy("doc_id").agg(pick("subtotal").alias("subtotal"), pick("tax").alias("tax"), pick("shipping").alias("shipping"), pick("invoice_total", "amount_due", "balance_due", "total_due").alias("total"))
    c = F.col
    ship = F.coalesce("shipping", F.lit(0.0))
    left = F.round(c("total") - c("subtotal") - ship, 2)
    per = per.withColumn("tax", F.coalesce("tax", F.when((left > 0) & (left <= F.greatest("total", "subtotal")), left)))
    total = F.when(c("subtotal").isNotNull() & c("tax").isNotNull() & (c("total").isNull() | (c("total") <= c("subtotal") + 0.01)), F.round(c("subtotal") + c("tax") + ship, 2)).otherwise(c("total"))
    return per.withColumn("total", total)
