"""Ground truth: legacy records to annotated fields, canonical values, and files in and out of step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import number
from ledgerloom.functions.text import cleaned, key, let

# The canonical fields of a ground truth, their kind, and the names older records give them, first ones first.
FIELDS = {
    "invoiceNumber": ("text", ("invoicenumber", "invoiceno", "invoiceid", "number")),
    "invoiceDate": ("text", ("invoicedate", "date", "issuedate")),
    "dueDate": ("text", ("duedate", "paymentdue")),
    "provider": ("text", ("provider", "seller", "vendor", "supplier", "companyname")),
    "customer": ("text", ("customer", "buyer", "client", "billto", "owner")),
    "currency": ("text", ("currency", "currencycode")),
    "subtotal": ("number", ("subtotal", "nettotal", "netamount")),
    "tax": ("number", ("tax", "vat", "taxamount", "salestax")),
    "shipping": ("number", ("shipping", "freight")),
    "total": ("number", ("total", "totalamount", "grandtotal", "amountdue", "invoicetotal")),
}


def annotated_text(raw: Column) -> Column:
    """(status, value, raw, confidence) of a text."""
    value = cleaned(raw)
    return F.struct(F.when(value.isNull(), "absent").otherwise("present").alias("status"), value.alias("value"), raw.alias("raw"), F.when(value.isNull(), 0.0).otherwise(1.0).alias("confidence"))


def annotated_number(raw: Column) -> Column:
    """The same of a number, whose value is text in plain digits; unclear where there is text but no number."""
    value = number(raw)
    status = F.when(cleaned(raw).isNull(), "absent").when(value.isNull(), "unclear").otherwise("present")
    return F.struct(status.alias("status"), value.cast("string").alias("value"), raw.alias("raw"), F.when(status == "present", 1.0).otherwise(0.0).alias("confidence"))


def first_alias(fields: DataFrame, aliases: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, field, raw): of each canonical field the value under its first name that the record has; a null there counts.

    ``fields``: doc, name, value. ``aliases``: field, alias, rank; a catalogue.
    """
    j = fields.withColumn("alias", key(F.col("name"))).join(aliases, "alias")
    return j.groupBy(doc, "field").agg(F.min_by(F.struct(F.col("value").alias("raw")), "rank").alias("x")).select(doc, "field", "x.raw")


def alias_table(spark) -> DataFrame:
    """(field, alias, rank) of the fixed names."""
    rows = [(f, a, k) for f, (_, names) in FIELDS.items() for k, a in enumerate(names)]
    return spark.createDataFrame(rows, "field string, alias string, rank int")


def upgraded(fields: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, field, annotation) of legacy records; those without any known field give none."""
    found = first_alias(fields, alias_table(fields.sparkSession), doc)
    numeric = F.col("field").isin(*[f for f, (kind, _) in FIELDS.items() if kind == "number"])
    return found.select(doc, "field", F.when(numeric, annotated_number(F.col("raw"))).otherwise(annotated_text(F.col("raw"))).alias("annotation"))


def canonical(annotation: Column) -> Column:
    """An annotation's value: only what is present counts; without a status the value itself."""
    return F.when(annotation["status"].isNull() | (annotation["status"] == "present"), annotation["value"])


def generated(value: Column, source: Column) -> Column:
    """An annotation of an extracted value: present as read, derived where it was worked out, else absent."""
    status = F.when(value.isNull(), "absent").when(source == "derived", "derived").otherwise("present")
    confidence = F.when(status == "present", 0.8).when(status == "derived", 0.55).otherwise(0.95)
    return F.struct(status.alias("status"), value.alias("value"), F.lit(None).cast("string").alias("raw"), confidence.alias("confidence"))


def sync_audit(stems: DataFrame, local: DataFrame, source: DataFrame) -> DataFrame:
    """(stem, status): of each invoice whether its local record equals the source's, differs, or is missing on a side.

    ``local`` and ``source``: stem, content.
    """
    side = lambda df, p: df.select("stem", F.sha2("content", 256).alias(p))
    j = stems.select("stem").distinct().join(side(local, "l"), "stem", "left").join(side(source, "s"), "stem", "left")
    status = F.when(F.col("s").isNull(), "missing_source").when(F.col("l").isNull(), "missing_local").when(F.col("l") == F.col("s"), "match").otherwise("mismatch")
    return j.select("stem", status.alias("status"))


def sync_changes(local: DataFrame, source: DataFrame) -> DataFrame:
    """(stem, action, content): what to write so that local records follow the source."""
    s = source.select("stem", F.col("content").alias("new"))
    j = s.join(local.select("stem", F.col("content").alias("old")), "stem", "left")
    action = F.when(F.col("old").isNull(), "copied").when(F.col("old") != F.col("new"), "updated").otherwise("unchanged")
    return j.select("stem", action.alias("action"), F.col("new").alias("content"))


# The fields of a record's sections and of its lines, their canonical names, and the names that older records give them.
SECTIONS = {
    "document": {
        "invoiceNumber": ("invoiceNumber", ("invoicenumber", "invoiceno", "invoiceid", "invoice")),
        "invoiceDate": ("invoiceDate", ("invoicedate", "date", "issuedate")),
        "sellerName": ("sellerName", ("sellername", "seller", "vendor", "supplier", "providername", "provider", "clinic", "hospital")),
        "customerName": ("customerName", ("customername", "customer", "client", "owner", "billto")),
        "currency": ("currency_code", ("currency", "currencycode")),
        "country": ("country_code", ("country", "countrycode")),
    },
    "summary": {
        "subtotal": ("subtotal", ("subtotal",)),
        "tax": ("tax", ("tax", "vat", "gst", "hst", "pst")),
        "discount": ("discount", ("discount",)),
        "shipping": ("shipping", ("shipping", "shippingandhandling", "handling", "sh")),
        "totalAmount": ("totalAmount", ("totalamount", "total", "amountdue", "balancedue")),
    },
}
LINE_FIELDS = {
    "description": ("description", ("description", "item", "service", "name")),
    "quantity": ("quantity", ("quantity", "qty", "units")),
    "unitPrice": ("unit_price", ("unitprice", "price", "rate")),
    "amount": ("amount", ("amount", "linetotal", "total")),
    "tax": ("tax_amount", ("tax", "vat", "gst", "hst", "pst")),
    "taxRate": ("tax_rate", ("taxrate", "vat", "tax")),
    "sku": ("sku", ("sku",)),
    "itemCode": ("item_code", ("itemcode", "code")),
}
NUMERIC = ("subtotal", "tax", "discount", "shipping", "totalAmount", "quantity", "unitPrice", "amount", "taxRate")
_OBJECT = "map<string,string>"


def _object(json: Column) -> Column:
    return F.coalesce(F.from_json(json, _OBJECT), F.create_map().cast(_OBJECT))


def legacy_value(value: Column, numeric: bool) -> Column:
    """(status, value) of a field of an older record, as its JSON: plain, or an object with value, raw and perhaps a status."""

    def read(x: Column) -> Column:
        """From (own text, stated status)."""
        blank = x["own"].isNull() | (x["own"] == "")
        return let(F.struct(blank.alias("blank"), (number(x["own"]).cast("string") if numeric else x["own"]).alias("v"), x["stated"].alias("stated")), told)

    def told(x: Column) -> Column:
        lost = F.when(x["blank"], "absent").otherwise("unclear")
        missing = x["blank"] | x["v"].isNull()
        status = F.when(x["stated"].isin("absent", "unclear", "derived"), x["stated"]).when(missing, lost).otherwise("present")
        return F.struct(status.alias("status"), F.when(F.coalesce(x["stated"], F.lit("present")).isin("present", "derived") & ~missing, x["v"]).alias("value"))

    def held(o: Column) -> Column:
        own = F.when(F.map_contains_key(o, "value"), F.try_element_at(o, F.lit("value"))).otherwise(F.try_element_at(o, F.lit("raw")))
        status = F.lower(F.trim(F.try_element_at(o, F.lit("status"))))
        return F.struct(own.alias("own"), F.when(status.isin("present", "absent", "unclear", "derived"), status).alias("stated"))

    plain = lambda v: F.struct(v.alias("own"), F.lit(None).cast("string").alias("stated"))
    return let(value, lambda v: let(F.when(F.coalesce(F.ltrim(v).startswith("{"), F.lit(False)), let(_object(v), held)).otherwise(plain(v)), read))


def _first_named(record: Column, other: Column, aliases: tuple[str, ...]) -> Column:
    """The value under the first alias that the record has, else that the other has; of alike names the last one's. A null there counts."""
    entries = F.transform(F.map_entries(record), lambda e: F.struct(key(e["key"]).alias("k"), e["value"].alias("v"), F.lit(0).alias("s")))
    if other is not None:
        entries = F.concat(entries, F.transform(F.map_entries(other), lambda e: F.struct(key(e["key"]).alias("k"), e["value"].alias("v"), F.lit(1).alias("s"))))
    names = F.array(*[F.lit(a) for a in aliases])
    known = F.transform(F.filter(entries, lambda e: F.array_contains(names, e["k"])), lambda e, i: F.struct(e["s"].alias("s"), F.array_position(names, e["k"]).alias("r"), (-i).alias("i"), e["v"].alias("v")))
    return F.get(F.array_sort(known), F.lit(0))["v"]


def normalized_truth(content: Column) -> Column:
    """(fields, lines) of a record's JSON: a map from canonical names to texts, and its lines as (index, fields); only what is present has a value.

    Older records are read by the names that they use, in their sections first and then in the record itself. Null for what is no record
    and for a record that has no known field and no section.
    """

    def present(value: Column) -> Column:
        """The value of an annotated field (its JSON), if it is present."""
        held = lambda o: F.when(F.coalesce(F.lower(F.trim(F.try_element_at(o, F.lit("status")))), F.lit("")).isin("", "present"), F.try_element_at(o, F.lit("value")))
        return let(value, lambda v: F.when(F.coalesce(F.ltrim(v).startswith("{"), F.lit(False)), let(_object(v), held)).otherwise(v))

    def cell(target: str, v2: Column, annotated: Column, old: Column, numeric: bool) -> Column:
        """(key, value, told) of a field, by the generation of its record."""
        new = lambda v: F.struct(F.lit(target).alias("key"), v.alias("value"), F.lit(1).alias("told"))
        legacy = lambda x: F.struct(F.lit(target).alias("key"), F.when(x["status"] == "present", x["value"]).alias("value"), F.when(x["status"].isin("present", "derived"), 1).otherwise(0).alias("told"))
        return F.when(v2, let(present(annotated), new)).otherwise(let(legacy_value(old, numeric), legacy))

    def named(cells: Column) -> Column:
        return F.map_from_entries(F.transform(cells, lambda x: F.struct(x["key"], x["value"])))

    def of(record: Column) -> Column:
        v2 = F.coalesce(F.lower(F.trim(F.try_element_at(record, F.lit("schemaVersion")))).startswith("gt-v2"), F.lit(False))
        raw_lines = F.coalesce(F.try_element_at(record, F.lit("lineItems")), F.try_element_at(record, F.lit("line_items")))
        rows = F.filter(F.coalesce(F.from_json(raw_lines, "array<string>"), F.array().cast("array<string>")), lambda x: F.ltrim(x).startswith("{"))
        parts = F.struct(record.alias("r"), v2.alias("v2"), rows.alias("rows"), *[_object(F.try_element_at(record, F.lit(s))).alias(s) for s in SECTIONS])
        return let(parts, built)

    def built(x: Column) -> Column:
        cells = F.array(*[cell(target, x["v2"], F.try_element_at(x[s], F.lit(name)), _first_named(x[s], x["r"], aliases), name in NUMERIC) for s, names in SECTIONS.items() for name, (target, aliases) in names.items()])

        def line(json: Column, i: Column) -> Column:
            def item(o: Column) -> Column:
                own = F.array(*[cell(target, x["v2"], F.try_element_at(o, F.lit(name)), _first_named(o, None, aliases), name in NUMERIC) for name, (target, aliases) in LINE_FIELDS.items()])
                stated = F.try_element_at(o, F.lit("index")).try_cast("int")
                return F.struct(F.when(x["v2"], stated).otherwise(F.coalesce(stated, i + 1)).alias("index"), named(own).alias("fields"))

            return let(_object(json), item)

        sections = F.exists(F.map_keys(x["r"]), lambda k: k.isin("document", "summary", "lineItems", "line_items"))
        some = lambda c: x["v2"] | sections | (F.size(x["rows"]) > 0) | F.exists(c, lambda e: e["told"] > 0)
        return let(cells, lambda c: F.when(some(c), F.struct(named(c).alias("fields"), F.transform(x["rows"], line).alias("lines"))))

    return F.when(F.ltrim(content).startswith("{"), let(_object(content), of))


def discovery_ready(truth: Column) -> Column:
    """Whether a normalized record has a total and a number or a date."""
    has = lambda k: truth["fields"][k].isNotNull()
    return F.coalesce(has("totalAmount") & (has("invoiceNumber") | has("invoiceDate")), F.lit(False))


def canonical_json(content: Column) -> Column:
    """``normalized_truth``, by the name under which records are read from files."""
    return normalized_truth(content)
