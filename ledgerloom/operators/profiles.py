"""Families' extraction profiles: built from a template, merged leaf by leaf, and the changes that recent results speak for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import contains_any
from ledgerloom.operators import history

PROFILE = (
    "version int, preferred_strategy string,"
    " ocr struct<region_buffer_multiplier:double,field_type_overrides:map<string,string>,field_buffer_multipliers:map<string,double>>,"
    " `table` struct<enabled:boolean,ocr_engine:string,row_gap_multiplier:double,min_line_span_fraction:double>,"
    " postprocess struct<refine_critical_fields:boolean,prefer_table_line_items:boolean>"
)
# How much wider than its region each kind of field is read, and what a profile says where it says nothing.
BUFFERS = {"string": 1.0, "date": 1.15, "currency": 0.9, "qty": 0.9, "address": 1.35}
ENGINE = "paddle"
ROW_GAP, LINE_SPAN = 1.5, 0.40


def read_profile(json: Column) -> Column:
    """A profile's JSON as a struct; nulls where it says nothing."""
    return F.from_json(F.coalesce(json, F.lit("{}")), PROFILE)


def _map_of(pairs: dict, kind: str) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]).cast(kind) if pairs else F.create_map().cast(kind)


def _both(a: Column, b: Column) -> Column:
    """Two maps as one; the second one's values win."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b))


def merged(base: Column, updates: Column) -> Column:
    """Two profiles as one, leaf by leaf: the update's value where it has one; maps are joined, and the update's entries win."""
    leaf = lambda *p: F.coalesce(reduce(lambda c, k: c[k], p, updates), reduce(lambda c, k: c[k], p, base)).alias(p[-1])
    both = lambda k: _both(base["ocr"][k], updates["ocr"][k]).alias(k)
    return F.struct(
        leaf("version"), leaf("preferred_strategy"),
        F.struct(leaf("ocr", "region_buffer_multiplier"), both("field_type_overrides"), both("field_buffer_multipliers")).alias("ocr"),
        F.struct(*[leaf("table", k) for k in ("enabled", "ocr_engine", "row_gap_multiplier", "min_line_span_fraction")]).alias("table"),
        F.struct(leaf("postprocess", "refine_critical_fields"), leaf("postprocess", "prefer_table_line_items")).alias("postprocess"),
    )


def sorted_json(profile: Column) -> Column:
    """A profile as JSON whose maps are in the order of their keys, so that equal profiles have equal texts."""
    ordered = lambda m: F.map_from_entries(F.array_sort(F.map_entries(m)))
    ocr = F.struct(profile["ocr"]["region_buffer_multiplier"].alias("region_buffer_multiplier"), ordered(profile["ocr"]["field_type_overrides"]).alias("field_type_overrides"), ordered(profile["ocr"]["field_buffer_multipliers"]).alias("field_buffer_multipliers"))
    rest = [F.struct(*[profile[k][x].alias(x) for x in names]).alias(k) for k, names in (("table", ("enabled", "ocr_engine", "row_gap_multiplier", "min_line_span_fraction")), ("postprocess", ("refine_critical_fields", "prefer_table_line_items")))]
    return F.to_json(F.struct(profile["version"].alias("version"), profile["preferred_strategy"].alias("preferred_strategy"), ocr.alias("ocr"), *rest))


def built(field_types: Column, has_table: Column, scanned: Column, engine: str = ENGINE) -> Column:
    """The profile of a template: the types of its fields (a map), whether a page has a table, whether it is a scan."""
    table = F.coalesce(has_table, F.lit(False))
    return F.struct(
        F.lit(1).alias("version"), F.lit("provider_template").alias("preferred_strategy"),
        F.struct(F.when(scanned, 1.15).otherwise(1.0).alias("region_buffer_multiplier"), field_types.alias("field_type_overrides"), _map_of(BUFFERS, "map<string,double>").alias("field_buffer_multipliers")).alias("ocr"),
        F.struct(table.alias("enabled"), F.lit(engine).alias("ocr_engine"), F.when(table, 1.25).otherwise(ROW_GAP).alias("row_gap_multiplier"), F.when(table, 0.32).otherwise(LINE_SPAN).alias("min_line_span_fraction")).alias("table"),
        F.struct(F.lit(True).alias("refine_critical_fields"), table.alias("prefer_table_line_items")).alias("postprocess"),
    )


def template_profiles(fields: DataFrame, pages: DataFrame, engine: str = ENGINE) -> DataFrame:
    """(template_id, profile) from templates' fields (template_id, page_no, field, field_type) and pages (template_id, page_no, has_table, scanned). A field's type is that of its last page."""
    last = fields.where("field != '' AND field_type IS NOT NULL").groupBy("template_id", "field").agg(F.max_by("field_type", "page_no").alias("t"))
    types = last.groupBy("template_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "t")))).alias("types"))
    per = pages.groupBy("template_id").agg(F.bool_or("has_table").alias("has_table"), F.coalesce(F.bool_or("scanned"), F.lit(False)).alias("scanned"))
    j = per.join(types, "template_id", "left")
    return j.select("template_id", built(F.coalesce("types", F.create_map().cast("map<string,string>")), F.col("has_table"), F.col("scanned"), engine).alias("profile"))


def summary(profile: Column) -> Column:
    """preferred_strategy, field_override_count, table_enabled and table_engine of a profile."""
    return F.struct(
        profile["preferred_strategy"].alias("preferred_strategy"), F.coalesce(F.size(F.map_keys(profile["ocr"]["field_type_overrides"])), F.lit(0)).alias("field_override_count"),
        F.coalesce(profile["table"]["enabled"], F.lit(False)).alias("table_enabled"), profile["table"]["ocr_engine"].alias("table_engine"),
    )


def table_settings(profile: Column, engine: Column | None = None, row_gap: float = ROW_GAP, line_span: float = LINE_SPAN) -> Column:
    """The engine and the limits with which a family's tables are read: the profile's, else the default ones."""
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    default = F.lit(None).cast("string") if engine is None else engine
    return F.struct(
        F.coalesce(said(profile["table"]["ocr_engine"]), said(default), F.lit(ENGINE)).alias("ocr_engine"),
        F.coalesce(profile["table"]["row_gap_multiplier"], F.lit(row_gap)).alias("row_gap_multiplier"), F.coalesce(profile["table"]["min_line_span_fraction"], F.lit(line_span)).alias("min_line_span_fraction"),
    )


def _hits() -> dict[str, Column]:
    """Which of the three kinds of failures a result's errors (lower case, ``e``) and its table speak of."""
    any_of = lambda f: F.exists("e", f)
    field = lambda x: x.contains("missing extracted field:") | x.contains("mismatch on ")
    rows = any_of(lambda x: x.contains("line item count mismatch") | x.contains("line item arithmetic mismatch"))
    return {
        "date_ocr_boost": any_of(lambda x: field(x) & x.contains("date")),
        "summary_amount_ocr_boost": any_of(lambda x: x.contains("total mismatch") | x.contains("subtotal mismatch") | (field(x) & contains_any(x, ("total", "subtotal", "tax", "amount")))),
        "line_item_table_tuning": rows | F.coalesce(~F.col("table_detected"), F.lit(False)) | F.coalesce(F.col("line_item_source") == "row_fallback", F.lit(False)),
    }


def patches(profile: Column, date_fields: Column, amount_fields: Column) -> dict[str, Column]:
    """The change of a profile that each kind of failure asks for."""
    at_least = lambda c, default, n: F.round(F.greatest(F.coalesce(c, F.lit(default)), F.lit(n)), 2)
    at_most = lambda c, default, n: F.round(F.least(F.coalesce(c, F.lit(default)), F.lit(n)), 2)
    ocr, table = profile["ocr"], profile["table"]
    buffer = lambda k: F.try_element_at(ocr["field_buffer_multipliers"], F.lit(k))
    typed = lambda names, kind: F.when(F.size(names) > 0, F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.lit(kind)))))
    none = lambda kind: F.lit(None).cast(kind)

    def patch(region=None, types=None, buffers=None, tuned=None) -> Column:
        gap, span = tuned or (none("double"), none("double"))
        return F.struct(
            none("int").alias("version"), none("string").alias("preferred_strategy"),
            F.struct((none("double") if region is None else region).alias("region_buffer_multiplier"), (none("map<string,string>") if types is None else types).alias("field_type_overrides"), (none("map<string,double>") if buffers is None else buffers).alias("field_buffer_multipliers")).alias("ocr"),
            F.struct(F.lit(True if tuned else None).cast("boolean").alias("enabled"), none("string").alias("ocr_engine"), gap.alias("row_gap_multiplier"), span.alias("min_line_span_fraction")).alias("table"),
            F.struct(none("boolean").alias("refine_critical_fields"), F.lit(True if tuned else None).cast("boolean").alias("prefer_table_line_items")).alias("postprocess"),
        )

    return {
        "date_ocr_boost": patch(at_least(ocr["region_buffer_multiplier"], 1.0, 1.25), typed(date_fields, "date"), F.create_map(F.lit("date"), at_least(buffer("date"), 1.15, 1.35))),
        "summary_amount_ocr_boost": patch(None, typed(amount_fields, "currency"), F.create_map(F.lit("currency"), at_least(buffer("currency"), 0.9, 1.05))),
        "line_item_table_tuning": patch(tuned=(at_most(table["row_gap_multiplier"], 1.5, 1.2), at_most(table["min_line_span_fraction"], 0.40, 0.28))),
    }


# How much more than its support a kind of suggestion counts.
PRIORITY = {"date_ocr_boost": 0.0, "summary_amount_ocr_boost": 0.5, "line_item_table_tuning": 1.0}


def suggestions(families: DataFrame, results: DataFrame, support: int = 2, recent: int = 10) -> DataFrame:
    """(template_family_id, family_status, kind, support_count, priority, example_invoices, profile_patch, queue_no): changes that enough of a
    family's recent results speak for and that its profile does not have yet, in the order of their priority.

    ``families``: template_family_id, status, profile (a struct), field_names (of its representative). ``results``: template_family_id, id,
    processed_at, invoice_name, validation_errors, table_detected, line_item_source.
    """
    c = F.col
    last = history.recent(results.where("template_family_id IS NOT NULL"), "template_family_id", [F.desc("processed_at"), F.desc("id")], recent)
    low = last.withColumn("e", F.transform(F.coalesce("validation_errors", F.array().cast("array<string>")), F.lower))
    hits = _hits()
    held = F.filter(F.array(*[F.when(h, F.lit(k)) for k, h in hits.items()]), lambda k: k.isNotNull())
    each = low.select("template_family_id", "position", "invoice_name", F.explode(held).alias("kind"))
    named = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "invoice_name"))), lambda x: x["invoice_name"]))  # of ``recent`` results at most
    per = each.groupBy("template_family_id", "kind").agg(F.count(F.lit(1)).alias("support_count"), F.slice(F.filter(named, lambda n: n != ""), 1, 3).alias("example_invoices")).where(c("support_count") >= support)
    names = F.coalesce("field_names", F.array().cast("array<string>"))
    dated = F.array_sort(F.array_distinct(F.filter(names, lambda n: F.lower(n).contains("date"))))
    sums = F.array_sort(F.array_distinct(F.filter(names, lambda n: contains_any(F.lower(n), ("total", "subtotal", "tax", "amount")))))
    j = per.join(families.where("status != 'retired'"), "template_family_id")
    change = reduce(lambda w, kv: w.when(c("kind") == kv[0], kv[1]), list(patches(c("profile"), dated, sums).items())[1:], F.when(c("kind") == "date_ocr_boost", patches(c("profile"), dated, sums)["date_ocr_boost"]))
    j = j.withColumn("profile_patch", change).where(sorted_json(merged(c("profile"), c("profile_patch"))) != sorted_json(c("profile")))
    more = reduce(lambda w, kv: w.when(c("kind") == kv[0], kv[1]), PRIORITY.items(), F.when(F.lit(False), 0.0))
    j = j.withColumn("priority", c("support_count") + more + F.when(c("status") == "degraded", 1.0).otherwise(0.0))
    order = Window.partitionBy("template_family_id").orderBy(F.desc("priority"), "kind")
    return j.select("template_family_id", c("status").alias("family_status"), "kind", "support_count", "priority", "example_invoices", "profile_patch", F.row_number().over(order).alias("queue_no"))


def queue(found: DataFrame) -> DataFrame:
    """Suggestions in the order in which they are looked at: the highest priority first, then by family and kind."""
    return found.orderBy(F.desc("priority"), "template_family_id", "kind")


def updated(families: DataFrame, changes: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(families, versions): families with the changes by hand (template_family_id, provider_name, status, profile; null: as it was)
    and a version (template_family_id, reason, at, status, profile) of each family that one names. Retired families stay as they are."""
    ch = changes.select("template_family_id", *[F.col(x).alias(f"__{x}") for x in ("provider_name", "status", "profile")], F.lit(True).alias("__changed"))
    j = families.join(ch, "template_family_id", "left").withColumn("__changed", F.coalesce("__changed", F.lit(False)) & (F.col("status") != "retired"))
    new = {
        "provider_name": F.when(F.col("__changed"), F.coalesce("__provider_name", "provider_name")).otherwise(F.col("provider_name")),
        "profile": F.when(F.col("__changed") & F.col("__profile").isNotNull(), merged(F.col("profile"), F.col("__profile"))).otherwise(F.col("profile")),
        "status": F.when(F.col("__changed"), F.coalesce("__status", "status")).otherwise(F.col("status")),
    }
    done = j.withColumns(new)
    versions = done.where("__changed").select("template_family_id", F.lit("manual_update").alias("reason"), at.alias("at"), "status", "profile")
    return done.select(*families.columns), versions


def accepted_suggestions(families: DataFrame, chosen: DataFrame) -> DataFrame:
    """Families with the patches of the chosen suggestions (template_family_id, kind, profile_patch) applied, in the order of their kinds."""
    out = families
    for kind in PRIORITY:
        one = chosen.where(F.col("kind") == kind).select("template_family_id", F.col("profile_patch").alias("__p"))
        out = out.join(one, "template_family_id", "left").withColumn("profile", F.when(F.col("__p").isNotNull(), merged(F.col("profile"), F.col("__p"))).otherwise(F.col("profile"))).drop("__p")
    return out
