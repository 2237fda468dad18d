"""How well a phrase on a page spells a field's label, and where its value then stands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.sets import position_prior
from ledgerloom.functions.text import contains_any, key, let, ocr_text, similarity, words

# The fields of an invoice's page, the labels that name them, and where a value stands by its label.
FIELD_SPECS = {
    "invoiceNumber": ("string", "right", True, ("invoice no", "invoice no.", "invoice number", "invoice #", "inv no", "inv #")),
    "invoiceDate": ("date", "right", True, ("invoice date", "date", "issue date", "billing date")),
    "dueDate": ("date", "right", False, ("due date", "payment due", "due")),
    "purchaseOrder": ("string", "right", False, ("po", "po number", "purchase order", "purchase order number")),
    "subtotal": ("currency", "right", False, ("subtotal", "sub total", "net amount")),
    "tax": ("currency", "right", False, ("tax", "vat", "gst", "sales tax")),
    "shipping": ("currency", "right", False, ("shipping", "shipping and handling", "handling", "s&h", "s h")),
    "total": ("currency", "right", True, ("total", "invoice total", "amount due", "balance due", "total due")),
    "customerName": ("address", "below", False, ("bill to", "billto", "customer", "sold to", "invoice to", "client", "owner")),
    "sellerName": ("address", "below", False, ("seller", "vendor", "supplier", "from", "bill from", "billfrom", "remit to", "sold by")),
}
GENERIC_LABELS = ("number", "no", "date", "total", "amount", "name", "id")
PRIOR_KINDS = {"invoicenumber": "invoice_number", "invoicedate": "invoice_date", "duedate": "due_date", "total": "total", "subtotal": "subtotal", "tax": "tax"}


def label_score(phrase: Column, alias: Column, field: Column, cx: Column, cy: Column) -> Column:
    """From 0 to 1: likeness, shared words and their order, less for extra words and for what speaks for another field; places add a little."""

    def scored(x: Column) -> Column:
        p, a, pw, aw = x["p"], x["a"], F.split(x["p"], " "), F.split(x["a"], " ")
        shared = F.size(F.array_intersect(pw, aw)) / F.size(F.array_distinct(aw))
        in_order = F.size(F.filter(aw, lambda w, i: F.get(pw, i) == w)) / F.size(aw)
        extra = F.size(words(phrase)) - F.size(words(alias))
        low, alias_low, name = F.lower(phrase), F.lower(alias), key(field)
        numbered = ("#", "no", "number")
        issued = contains_any(p, ("issue", "issued"))
        terms = [
            similarity(p, a) * 0.55 + shared * 0.20 + in_order * 0.12,
            F.when(p == a, 0.15).when(p.startswith(a) | a.startswith(p), 0.08),
            F.when(F.trim(phrase).endswith(":"), 0.05),
            F.when(extra > 2, -F.least(F.lit(0.18), extra * 0.05)),
            F.when(extra < 0, -F.least(F.lit(0.26), -extra * 0.12)),
            F.when(contains_any(alias_low, numbered) & ~contains_any(low, numbered), -0.5),
            F.when((name == "invoicedate") & p.contains("due"), -0.85),
            F.when((name == "invoicedate") & issued, 0.22),
            F.when((name == "duedate") & p.contains("invoice"), -0.3),
            F.when((name == "duedate") & issued, -0.4),
            F.when(alias_low.contains(" to") & ~low.contains(" to") & ~low.endswith("to:"), -0.2),
            F.when(p.isin(*GENERIC_LABELS) & (a != p) & (a != F.concat(F.lit("invoice "), p)), -0.18),
            F.when(cx < 0.55, 0.05),
            position_prior(F.element_at(F.create_map(*[F.lit(v) for kv in PRIOR_KINDS.items() for v in kv]), name), cx, cy),
        ]
        total = reduce(lambda s, t: s + F.coalesce(t, F.lit(0.0)), terms)
        return F.when((p == "") | (a == "") | ((name == "tax") & p.contains("tax id")), 0.0).otherwise(F.least(total, F.lit(1.0)))

    return let(F.struct(ocr_text(phrase).alias("p"), ocr_text(alias).alias("a")), scored)


def value_region(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, below: Column, address: Column, widest: float = 0.45, address_lines: float = 4.0) -> Column:
    """The region (in shares of the page) in which a label's value stands: below the label, or to its right."""
    whole = lambda c: F.floor(c).cast("long")
    gap_x, gap_y = F.greatest(whole(page_w * 0.01), F.lit(6)), F.greatest(whole(page_h * 0.01), F.lit(6))
    bx = F.when(below, F.greatest(x - gap_x, F.lit(0))).otherwise(F.least(page_w - 1, x + w + gap_x))
    by = F.when(below, F.least(page_h - 1, y + h + gap_y)).otherwise(F.greatest(y - whole(h * 0.25), F.lit(0)))
    bw = F.least(whole(page_w * F.when(below, 0.45).otherwise(widest)), page_w - bx)
    bh = F.least(whole(h * F.when(below, address_lines).when(address, 1.6).otherwise(1.8)), page_h - by)
    bw = F.greatest(bw, F.least(whole(page_w * 0.08), F.greatest(page_w - bx, F.lit(1))))
    bh = F.greatest(bh, F.least(whole(page_h * 0.03), F.greatest(page_h - by, F.lit(1))))
    left, top = bx / page_w, by / page_h
    return F.struct(F.round(left, 6).alias("x"), F.round(top, 6).alias("y"), F.round(F.least(bw / page_w, 1.0 - left), 6).alias("width"), F.round(F.least(bh / page_h, 1.0 - top), 6).alias("height"))
