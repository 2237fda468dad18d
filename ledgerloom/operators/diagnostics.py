"""What a run leaves behind about each document: counts, diagnostics, events for the life of families, lines of text, and comparisons of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import number, ratio
from ledgerloom.functions.rules import validation_category
from ledgerloom.functions.text import first_matching
from ledgerloom.operators import store


# --- counts ---------------------------------------------------------------------------------------------------------


def amount_total(lines: DataFrame, doc: str = "doc_id", amount: str = "amount") -> DataFrame:
    """(doc, total): the sum of the amounts in text that can be read, to the cent; null without one."""
    return lines.groupBy(doc).agg(F.round(F.sum(number(F.col(amount)).cast("decimal(18,4)")), 2).cast("double").alias("total"))


def template_counts(pages: DataFrame) -> DataFrame:
    """(template_id, field_count, label_count, has_table) of templates' pages (template_id, page_no, fields: field -> label_text, table).

    A label counts where a field has one; a table where a page has one.
    """
    labels = F.size(F.filter(F.map_values("fields"), lambda v: F.coalesce(F.trim(v), F.lit("")) != ""))
    held = F.coalesce("fields", F.create_map().cast("map<string,string>"))
    return pages.withColumn("fields", held).groupBy("template_id").agg(
        F.sum(F.size(F.map_keys("fields"))).alias("field_count"), F.sum(labels).alias("label_count"), F.coalesce(F.bool_or(F.col("table").isNotNull()), F.lit(False)).alias("has_table")
    )


def scalar_counts(record: Column, lines: Column) -> tuple[Column, Column]:
    """How many fields of a record (a map) have a value, and how many lines it has."""
    filled = F.size(F.map_keys(F.map_filter(record, lambda _, v: v.isNotNull())))
    return F.coalesce(filled, F.lit(0)), F.coalesce(F.size(lines), F.lit(0))


def value_by_alias(record: Column, aliases: Column | list[str]) -> Column:
    """The value of the first alias that a record (a map) has; names are compared by their letters and digits."""
    plain = lambda s: F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "")
    entries = F.map_entries(F.coalesce(record, F.create_map().cast("map<string,string>")))
    names = F.transform(entries, lambda e: plain(e["key"]))
    wanted = F.array(*[F.lit(a) for a in aliases]) if isinstance(aliases, list) else aliases
    # Of names that are alike the last one counts.
    at = lambda a: F.array_max(F.transform(names, lambda n, i: F.when(n == plain(a), i)))
    found = F.filter(F.transform(wanted, at), lambda i: i.isNotNull())
    return F.get(entries, F.get(found, F.lit(0)))["value"]


# --- diagnostics ----------------------------------------------------------------------------------------------------


def diagnostics(results: DataFrame) -> DataFrame:
    """Results with what their errors say: counts of missing and mismatched fields and of each kind, whether the template was the wrong one,
    whether the figures do not add up, and whether the policy failed.

    Reads attempted_route, validation_errors, validation_score, reconciliation_status (null: not reconciled).
    A wrong template is suspected where one was applied and at least two fields, and more than are missing, do not match.
    """
    c = F.col
    errors = F.coalesce("validation_errors", F.array().cast("array<string>"))
    count = lambda prefix: F.size(F.filter(errors, lambda e: e.startswith(prefix)))
    kinds = F.transform(errors, validation_category)
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    d = results.withColumns({"scalar_field_missing_count": count("Missing extracted field:"), "scalar_field_mismatch_count": count("Mismatch on "), "validation_error_counts": counts, "__n": F.size(errors)})
    wrong = (c("__n") > 0) & (c("scalar_field_mismatch_count") >= F.greatest(F.lit(2), c("scalar_field_missing_count") + 1)) & (c("attempted_route") == "APPLY")
    arithmetic = F.exists(errors, lambda e: e.startswith("Line item arithmetic mismatch") | e.startswith("Subtotal mismatch:") | e.startswith("Total mismatch:"))
    known = c("validation_score").isNotNull() | c("reconciliation_status").isNotNull()
    return d.withColumns({
        "wrong_template_suspected": F.coalesce(wrong, F.lit(False)), "reconciliation_failure": F.when(known, F.coalesce(c("reconciliation_status") == "inconsistent", F.lit(False)) | arithmetic),
        "validator_policy_failure": c("validation_score") < 1.0,
    }).drop("__n")


def outcome_events(results: DataFrame) -> DataFrame:
    """(key, family, seq, event, score, checked): what results add to the lives of fingerprints and families.

    An applied result that passed is a success of its fingerprint and its family, one that did not a rejection of both; a
    discovered one that passed is the first success of its fingerprint and one of its family. Errors add nothing.
    """
    c = F.col
    sound = results.where("error IS NULL AND validation_passed IS NOT NULL")
    event = F.when(c("validation_passed"), "apply").when(c("attempted_route") == "APPLY", "reject")
    each = sound.withColumn("event", event).where("event IS NOT NULL")
    keys = F.array(F.struct(c("fingerprint_hash").alias("key"), F.lit(False).alias("family")), F.struct(c("template_family_id").alias("key"), F.lit(True).alias("family")))
    long = each.select(F.explode(keys).alias("k"), c("id").alias("seq"), "event", F.coalesce("validation_score", F.lit(0.0)).alias("score"), F.coalesce("has_truth", F.lit(False)).alias("checked"))
    return long.select("k.key", "k.family", "seq", "event", "score", "checked").where("key IS NOT NULL")


def discovered_records(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fingerprints, families) that discoveries which passed make known: each once, from the first of its results."""
    won = results.where("error IS NULL AND validation_passed AND attempted_route = 'DISCOVERY'")
    first = lambda key, *names: won.where(f"{key} IS NOT NULL").groupBy(key).agg(*[F.min_by(n, "id").alias(n) for n in names])
    marked = {"status": F.lit("provisional"), "apply_count": F.lit(1).cast("long"), "reject_count": F.lit(0).cast("long")}
    fingerprints = first("fingerprint_hash", "template_family_id", "validation_score").withColumns(marked).withColumnRenamed("validation_score", "confidence")
    families = first("template_family_id", "provider_name", "country_code", "document_family", "validation_score").withColumns(marked).withColumnRenamed("validation_score", "confidence")
    return fingerprints, families


def captured(df: DataFrame, value: Column, problem: Column) -> DataFrame:
    """``df`` with value and error: the work of a row whose problem (null: none) keeps it from a value is an error of that row alone."""
    return df.withColumns({"value": F.when(problem.isNull(), value), "error": problem})


# --- lists of results -----------------------------------------------------------------------------------------------


def failed_below(results: DataFrame, folder: str, family: str | None = None, limit: int | None = None) -> DataFrame:
    """The results below a folder that did not pass, the last first; of one family and so many, if wanted. The folder is taken literally."""
    found = results.where(F.col("invoice_path").startswith(folder.rstrip("/") + "/")).where("validation_passed = false OR (validation_passed IS NULL AND route = 'REJECTED')")
    found = found if family is None else found.where(F.col("template_family_id") == family)
    found = found.orderBy(F.desc("processed_at"), F.desc("id"))
    return found if limit is None else found.limit(limit)


def in_input_order(results: DataFrame, inputs: DataFrame, key: str = "invoice_path") -> DataFrame:
    """Every input (key, ordinal) with its result, if it has one, in the order of the inputs."""
    return inputs.join(results, key, "left").orderBy("ordinal")


def example_paths(examples: DataFrame, results: DataFrame) -> DataFrame:
    """(template_family_id, invoice_path): the paths of a family's examples and of its results, each once."""
    pick = lambda df: df.select("template_family_id", "invoice_path").where("template_family_id IS NOT NULL AND invoice_path IS NOT NULL")
    return pick(examples).union(pick(results)).distinct()


def cluster_members(clusters: DataFrame, results: DataFrame, examples: DataFrame, shown: int = 3) -> DataFrame:
    """(template_family_id, cluster, fingerprints, results, accepted, example_names): clusters with what their fingerprints' results and examples say."""
    c = F.col
    per = results.where("fingerprint_hash IS NOT NULL").groupBy("fingerprint_hash").agg(F.count(F.lit(1)).alias("n"), F.count_if("validation_passed").alias("ok"))
    names = examples.where("fingerprint_hash IS NOT NULL").groupBy("fingerprint_hash").agg(F.slice(F.array_sort(F.collect_set("invoice_name")), 1, shown).alias("names"))
    j = clusters.join(per, "fingerprint_hash", "left").join(names, "fingerprint_hash", "left")
    every = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), 1, shown)
    return j.groupBy("template_family_id", "cluster").agg(F.count(F.lit(1)).alias("fingerprints"), F.coalesce(F.sum("n"), F.lit(0)).alias("results"), F.coalesce(F.sum("ok"), F.lit(0)).alias("accepted"), every.alias("example_names"))


def scored_representative(fingerprints: DataFrame, score: str = "score") -> DataFrame:
    """The live fingerprint that stands for each family beside a given document: best score, then most confident, most applied, oldest."""
    live = fingerprints.where("status != 'retired'")
    payload = F.struct(*[c for c in live.columns if c != "template_family_id"])
    order = F.struct(-F.col(score), -F.col("confidence"), -F.col("apply_count"), "created_at", "fingerprint_hash")
    return live.groupBy("template_family_id").agg(F.min_by(payload, order).alias("r")).select("template_family_id", "r.*")


# --- lines of text --------------------------------------------------------------------------------------------------


def simplified_error(error: Column) -> Column:
    """An error in few words."""
    e = F.trim(F.coalesce(error, F.lit("")))
    after = lambda mark, s: F.trim(F.substring_index(F.regexp_replace(s, "^" + mark, ""), ":", 1))
    return first_matching(
        [
            (e.startswith("Missing extracted field:"), F.concat(F.lit("missing "), F.trim(F.regexp_replace(e, "^Missing extracted field:", "")))),
            (e.startswith("Mismatch on "), F.concat(F.lit("mismatch on "), after("Mismatch on ", e))),
            (e.startswith("Line item count mismatch:"), "line-item count mismatch"),
            (e.startswith("Line item arithmetic mismatch"), "line-item arithmetic mismatch"),
            (e.startswith("Subtotal mismatch:"), "subtotal does not match line items"),
            (e.startswith("Total mismatch:"), "total does not match subtotal + tax"),
            (e.startswith("Currency mismatch for country"), "country/currency mismatch"),
        ],
        e,
    )


def shown_score(score: Column) -> Column:
    """A score as a percentage with one decimal, or n/a."""
    return F.when(score.isNull(), "n/a").otherwise(F.concat(F.format_string("%.1f", score * 100), F.lit("%")))


def shown_seconds(seconds: Column) -> Column:
    """Seconds left as 1h02m, 3m05s or 7s."""
    s = F.greatest(F.lit(0), seconds.cast("long"))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    whole = lambda a, b: F.floor(a / b).cast("long")
    return F.when(s >= 3600, F.concat(whole(s, 3600).cast("string"), F.lit("h"), two(whole(s % 3600, 60)), F.lit("m"))).when(s >= 60, F.concat(whole(s, 60).cast("string"), F.lit("m"), two(s % 60), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def result_line(results: DataFrame) -> DataFrame:
    """(invoice_name, line): a result in one line: its name, route, score and up to three errors in few words."""
    few = F.array_join(F.slice(F.transform(F.coalesce("validation_errors", F.array().cast("array<string>")), simplified_error), 1, 3), "; ")
    line = F.concat_ws(" | ", "invoice_name", F.coalesce("route", F.lit("?")), F.concat(F.lit("score="), shown_score(F.col("validation_score"))), F.nullif(few, F.lit("")))
    return results.select("invoice_name", line.alias("line"))


# --- comparisons ----------------------------------------------------------------------------------------------------


def compared(paths: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(invoice_path, before_status, after_status, before_score, after_score, score_delta, change, rank): a benchmark's invoices before and after.

    A path without a result is missing, one whose result has an error an error. Improvements rank before what got worse, and that before what stayed.
    """
    status = first_matching([(F.col("error").isNotNull(), "error"), (F.col("validation_passed"), "accepted"), (F.col("validation_passed").isNotNull(), "rejected")], "unvalidated")
    side = lambda df, p: df.select("invoice_path", status.alias(f"{p}_status"), F.col("validation_score").alias(f"{p}_score"))
    j = paths.select("invoice_path").join(side(before, "before"), "invoice_path", "left").join(side(after, "after"), "invoice_path", "left").na.fill("missing", ["before_status", "after_status"])
    c = F.col
    good = lambda p: c(f"{p}_status") == "accepted"
    delta = F.round(c("after_score") - c("before_score"), 4)
    change = first_matching([(~good("before") & good("after"), "fixed"), (good("before") & ~good("after"), "broken"), (delta > 0, "improved"), (delta < 0, "declined")], "unchanged")
    rank = reduce(lambda w, kv: w.when(c("change") == kv[1], kv[0]), enumerate(("fixed", "improved", "broken", "declined", "unchanged")), F.when(F.lit(False), 0))
    return j.withColumns({"score_delta": delta, "change": change}).withColumn("rank", rank)


def benchmark_statuses(compared_paths: DataFrame) -> DataFrame:
    """One row: how many invoices were fixed, broken and so on, the acceptance before and after, and whether the change helps, hurts or does neither."""
    c = F.col
    n = lambda k: F.count_if(c("change") == k).alias(k)
    per = compared_paths.agg(F.count(F.lit(1)).alias("invoices"), *[n(k) for k in ("fixed", "improved", "broken", "declined", "unchanged")], F.count_if(c("before_status") == "accepted").alias("b"), F.count_if(c("after_status") == "accepted").alias("a"), F.avg("score_delta").alias("mean_delta"))
    status = first_matching([((c("fixed") > c("broken")) | ((c("fixed") == c("broken")) & (c("improved") > c("declined"))), "helps"), ((c("broken") > c("fixed")) | (c("declined") > c("improved")), "hurts")], "neutral")
    return per.select("invoices", "fixed", "improved", "broken", "declined", "unchanged", F.round(ratio(c("b"), c("invoices")), 4).alias("before_rate"), F.round(ratio(c("a"), c("invoices")), 4).alias("after_rate"), F.round("mean_delta", 4).alias("mean_delta"), status.alias("status"))


# --- runs -----------------------------------------------------------------------------------------------------------


def run_rows(results: DataFrame, run_id: Column) -> tuple[DataFrame, DataFrame]:
    """(run, invoices) to append for a run: one row of totals, and a row a result. The id is the run's own, so that runs that end together do not share one."""
    invoices = results.withColumn("run_id", run_id)
    run = results.agg(F.count(F.lit(1)).alias("total"), F.count_if("validation_passed").alias("passed"), F.count_if(~F.col("validation_passed")).alias("failed"), F.count("error").alias("errors"))
    return run.withColumn("run_id", run_id), invoices


def progress(table: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs' progress with the last update (job_id, done, total, at) of each."""
    return store.upserted(table, updates, ["job_id"], ["at"])


def family_copy(tables: dict[str, DataFrame], family: str) -> dict[str, DataFrame]:
    """Of each table that has families the rows of one: what another workspace needs to look at it."""
    return {name: df.where(F.col("template_family_id") == family) for name, df in tables.items() if "template_family_id" in df.columns}


def positions(df: DataFrame, key: str, order: list) -> DataFrame:
    """Rows with their number within a key from 1, so that two sides meet by place."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
