"""Extracted fields against ground truth, in long form: (doc_id, field, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import iso
from ledgerloom.functions.numbers import amount
from ledgerloom.functions.rules import SIMILARITY_THRESHOLD, currency_error, validation_category
from ledgerloom.functions.sets import jaccard
from ledgerloom.functions.text import squeezed, words

# What a field's name must hold to be compared as an amount.
AMOUNT_NAMES = ("price", "amount", "total", "tax", "shipping", "discount")


def values_match(found: Column, truth: Column, name: Column, country: Column, threshold: float = SIMILARITY_THRESHOLD, cent_scale: bool = False) -> Column:
    """Whether two texts agree, as the field's name says: amounts, quantities, dates, names, else sets of words. Null never does."""
    low = F.lower(name)
    a, b = amount(found), amount(truth)
    money = F.abs(a - b) < 0.01
    if cent_scale:
        money = money | (F.abs(a * 100 - b) < 0.01) | (F.abs(a - b * 100) < 0.01)
    s, t = F.lower(squeezed(found)), F.lower(squeezed(truth))
    longest = F.greatest(F.length(s), F.length(t))
    named = F.when(longest == 0, True).otherwise(1.0 - F.levenshtein(s, t) / longest >= threshold)
    v, w = F.array_distinct(words(s)), F.array_distinct(words(t))
    worded = F.when((F.size(v) == 0) | (F.size(w) == 0), s == t).otherwise(jaccard(v, w) >= threshold)
    is_amount = reduce(lambda x, y: x | y, [low.contains(n) for n in AMOUNT_NAMES])
    compared = F.when(is_amount, money).when(low.contains("qty") | low.contains("quantity"), F.bround(a, 3) == F.bround(b, 3)).when(low.contains("date"), iso(found, country) == iso(truth, country))
    return F.when(found.isNull() | truth.isNull(), False).otherwise(compared.when(low.contains("name"), named).otherwise(worded))


def renamed_fields(fields: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Fields by their canonical names; of two that meet under one name the later (by ``seq``, if there is one) wins."""
    if not mapping:
        return fields
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    named = fields.withColumn("field", F.coalesce(F.try_element_at(table, F.col("field")), F.col("field")))
    if "seq" not in fields.columns:
        return named
    others = [c for c in named.columns if c not in ("doc_id", "field")]
    return named.groupBy("doc_id", "field").agg(F.max_by(F.struct(*others), "seq").alias("r")).select("doc_id", "field", *[F.col(f"r.{c}").alias(c) for c in others])


def compared_fields(found: DataFrame, truth: DataFrame, countries: DataFrame | None = None, **how) -> DataFrame:
    """(doc_id, field, outcome, error) of every field whose truth is not null: matched, missing or mismatch."""
    t = truth.where(F.col("value").isNotNull()).select("doc_id", "field", F.col("value").alias("truth"))
    j = t.join(found.select("doc_id", "field", F.col("value").alias("found")), ["doc_id", "field"], "left")
    j = j.join(countries, "doc_id", "left") if countries is not None else j.withColumn("country_code", F.lit(None).cast("string"))
    same = values_match(F.col("found"), F.col("truth"), F.col("field"), F.col("country_code"), **how)
    outcome = F.when(F.col("found").isNull(), "missing").when(same, "matched").otherwise("mismatch")
    error = F.when(F.col("outcome") == "missing", F.concat(F.lit("Missing extracted field: "), "field")).when(
        F.col("outcome") == "mismatch", F.concat(F.lit("Mismatch on "), "field", F.lit(": expected '"), "truth", F.lit("', got '"), "found", F.lit("'"))
    )
    return j.withColumn("outcome", outcome).withColumn("error", error).select("doc_id", "field", "truth", "found", "outcome", "error")


def line_count_outcome(found: Column, truth: Column) -> Column:
    """(matched, mismatched, error) of the number of lines: within a fifth, one at least, all count as matched."""
    allowed = F.greatest(F.lit(1), F.bround(truth * 0.2))
    off = F.abs(truth - found) > allowed
    error = F.when(off, F.format_string("Line item count mismatch: expected %d, got %d", truth.cast("int"), found.cast("int")))
    return F.struct(F.when(off, 0).otherwise(truth).alias("matched"), F.when(off, 1).otherwise(0).alias("mismatched"), error.alias("error"))


def validated(found: DataFrame, truth: DataFrame, documents: DataFrame, more_errors: DataFrame | None = None, **how) -> DataFrame:
    """A row a document: matched, mismatched, score, passed, errors, error_counts.

    ``documents``: doc_id, country_code, currency_code, truth_lines, found_lines. ``more_errors``: (doc_id, error) of arithmetic.
    """
    each = compared_fields(found, truth, documents.select("doc_id", "country_code"), **how)
    by_field = each.groupBy("doc_id").agg(F.count_if(F.col("outcome") == "matched").alias("m"), F.count_if(F.col("outcome") != "matched").alias("x"), F.sort_array(F.collect_list("error")).alias("e"))
    lines = line_count_outcome(F.coalesce("found_lines", F.lit(0)), F.col("truth_lines"))
    d = documents.withColumns({"__l": F.when(F.col("truth_lines") > 0, lines), "__c": currency_error(F.col("country_code"), F.col("currency_code"))})
    d = d.join(by_field, "doc_id", "left")
    none = F.array().cast("array<string>")
    if more_errors is not None:
        d = d.join(more_errors.groupBy("doc_id").agg(F.sort_array(F.collect_list("error")).alias("__more")), "doc_id", "left")
        more = F.when(F.col("truth_lines") > 0, F.coalesce("__more", none)).otherwise(none)
    else:
        more = none
    errors = F.concat(F.coalesce("e", none), F.array_compact(F.array("__l.error")), more, F.array_compact(F.array("__c")))
    d = d.withColumn("errors", errors)
    matched = F.coalesce("m", F.lit(0)) + F.coalesce("__l.matched", F.lit(0))
    wrong = F.size("errors").cast("long")
    score = F.when(matched + wrong > 0, matched / (matched + wrong)).otherwise(1.0)
    kinds = F.transform("errors", validation_category)
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    return d.select("doc_id", matched.alias("matched"), wrong.alias("mismatched"), score.alias("score"), (F.abs(score - 1.0) < 0.001).alias("passed"), "errors", counts.alias("error_counts"))
