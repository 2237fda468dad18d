"""From documents' text to validated results: one plan for a batch of any size.

A batch sees the layouts and families as they were when it began; what it learns is folded in when it ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import rules, text
from ledgerloom.operators import reconcile, validate


def native_fields(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, lines) of documents' native text (doc_id, page_no, text).

    A field is what a line says before its colon, or what a pattern finds; the pattern's value wins. Line items are
    lines that end in two numbers or more. Everything but the final grouping works line by line.
    """
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", "page_no", "n", F.trim("line").alias("line")).where("line != ''")
    at = F.struct("page_no", "n")
    keyed = lines.where(F.col("line").contains(":")).select("doc_id", at.alias("at"), text.squeezed(F.regexp_extract("line", "^([^:]*):", 1)).alias("field"), text.squeezed(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"), F.lit(1).alias("rank"))
    named = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(f).alias("field"), text.squeezed(F.regexp_extract("line", p, text.FIELD_GROUP[f])).alias("value"))) for f, p in text.FIELD_PATTERNS.items()]))
    matched = lines.select("doc_id", at.alias("at"), F.explode(named).alias("x")).select("doc_id", "at", "x.field", "x.value", F.lit(0).alias("rank"))
    both = keyed.where("field != '' AND value != ''").unionByName(matched)
    fields = both.groupBy("doc_id", "field").agg(F.min_by("value", F.struct("rank", "at")).alias("value"))
    items = lines.select("doc_id", at.alias("at"), text.line_item(F.col("line")).alias("i")).where("i IS NOT NULL")
    numbered = items.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")))
    return fields, numbered.select("doc_id", "line_no", "i.*")


def invoices(fields: DataFrame) -> DataFrame:
    """A row a document: subtotal, tax, shipping and total as numbers, from fields by any of their names."""
    from ledgerloom.functions.numbers import number

    names = {"subtotal": ("subtotal",), "tax": ("tax",), "shipping": ("shipping",), "total": ("total", "totalamount", "amountdue", "balancedue", "grandtotal")}
    k = text.key(F.col("field"))
    return fields.groupBy("doc_id").agg(*[F.max(F.when(k.isin(*ns), number(F.col("value")))).alias(f) for f, ns in names.items()])


def normalized(pages: DataFrame) -> DataFrame:
    """Native text to reconciled invoices."""
    fields, lines = native_fields(pages)
    typed = lines.withColumns({c: F.lit(None).cast("string") for c in ("net_amount", "gross_amount", "tax_rate", "tax_amount")})
    return reconcile.reconciled(invoices(fields), reconcile.normalized_lines(typed))


def context(pages: DataFrame) -> DataFrame:
    """(doc_id, document_family, country_code, currency_code) from the text of all pages."""
    whole = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), " ").alias("t"))  # pages of one document
    code = rules.country(rules.country_scores(F.col("t")))
    x = whole.select("doc_id", "t", text.document_family(F.col("t")).alias("document_family"), code.alias("country_code"))
    return x.select("doc_id", "document_family", "country_code", rules.currency(F.col("t"), F.col("country_code")).alias("currency_code"))


def validated(pages: DataFrame, truth: DataFrame, truth_lines: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Validation of native text against ground truth (doc_id, field, value) and its number of lines (doc_id, truth_lines)."""
    fields, lines = native_fields(pages)
    done = normalized(pages)
    numbers = done.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in ("subtotal", "tax", "total")])).alias("x")).select("doc_id", "x.*").where("value IS NOT NULL")
    found = numbers.unionByName(fields.join(numbers.select("doc_id", "field"), ["doc_id", "field"], "left_anti"))
    found = validate.renamed_fields(found, mapping or {})
    counts = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found_lines"))
    docs = context(pages).join(truth_lines, "doc_id", "left").join(counts, "doc_id", "left").na.fill(0, ["truth_lines", "found_lines"])
    wrong = reconcile.line_mismatches(lines).select("doc_id", "error")
    return validate.validated(found, truth, docs, wrong)
