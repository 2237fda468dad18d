"""Business rules as ordered cases: countries, currencies, errors, weights, triage, routes and trust."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import clamp, ratio
from ledgerloom.functions.sets import jaccard
from ledgerloom.functions.text import contains_any, first_matching, has_marker, let

# What speaks for a country, and with how many points.
COUNTRY_MARKERS = {
    "US": ("usd", "united states", "zip code", "sales tax"),
    "CA": ("cad", "canada", "gst", "hst", "pst", "tps", "tvq", "postal code"),
    "MX": ("mxn", "mexico", "rfc", "iva", "c.p.", "codigo postal", "código postal"),
}
COUNTRY_CURRENCY = {"US": "USD", "CA": "CAD", "MX": "MXN"}
CA_POSTAL = r"\b[abceghj-nprstvxy]\d[abceghj-nprstv-z][ -]?\d[abceghj-nprstv-z]\d\b"
US_ZIP = r"\b\d{5}(-\d{4})?\b"
MX_POSTAL = r"\b(c[.]?\s*p[.]?|codigo postal|c[oó]digo postal)\s*:?\s*\d{5}\b"
MX_RFC = r"\b[a-z&ñ]{3,4}\d{6}[a-z0-9]{3}\b"
CA_PROVINCES = {
    "ab": "alberta", "bc": "british columbia", "mb": "manitoba", "nb": "new brunswick", "nl": "newfoundland and labrador", "ns": "nova scotia", "nt": "northwest territories",
    "nu": "nunavut", "on": "ontario", "pe": "prince edward island", "qc": "quebec", "sk": "saskatchewan", "yt": "yukon",
}
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "dc": "district of columbia",
    "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana",
    "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska",
    "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma",
    "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont",
    "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
}
MX_STATES = (
    "aguascalientes", "baja california", "campeche", "chiapas", "chihuahua", "coahuila", "colima", "durango", "guanajuato", "guerrero", "hidalgo", "jalisco", "mexico city",
    "michoacan", "morelos", "nayarit", "nuevo leon", "oaxaca", "puebla", "queretaro", "quintana roo", "san luis potosi", "sinaloa", "sonora", "tabasco", "tamaulipas", "tlaxcala",
    "veracruz", "yucatan", "zacatecas",
)
LINE_CATEGORIES = {
    "consultation": ("consult", "exam", "visit", "recheck", "evaluation"),
    "surgery": ("surgery", "surgical", "spay", "neuter", "anesthesia", "anaesthesia"),
    "diagnostics": ("lab", "x-ray", "xray", "scan", "diagnostic", "test", "ultrasound", "radiograph", "bloodwork"),
    "medication": ("tablet", "capsule", "drug", "med", "injection", "antibiotic", "prescription", "dose", "vaccine", "vaccination"),
    "consumables": ("bandage", "consumable", "syringe", "catheter", "supplies", "supply"),
    "hospitalization": ("hospital", "boarding", "overnight", "icu", "ward"),
}

# Buckets of issues, their weights, and the words of field names that lead to them, in order.
BUCKET_WEIGHTS = {
    "routing_preprocessing": 1.40,
    "party_block_extraction": 1.20,
    "summary_amount_resolution": 1.00,
    "line_item_detection": 1.15,
    "pdf_native_text_extraction": 1.10,
    "scalar_reconciliation": 0.95,
    "runtime_error": 2.50,
    "other": 0.75,
}
FIELD_HINTS = {
    "party_block_extraction": ("invoice no", "invoice number", "invoice id", "invoice#", "customer", "customer name", "supplier", "vendor", "seller", "buyer", "bill to", "ship to", "remit to", "payer", "account name", "company name"),
    "summary_amount_resolution": ("total", "subtotal", "amount due", "balance due", "invoice total", "grand total", "tax", "vat", "amount payable", "net total"),
    "line_item_detection": ("line item", "line-item", "item count", "line items", "quantity", "description", "sku", "table", "row"),
    "pdf_native_text_extraction": ("pdf", "native text", "text extraction", "ocr"),
    "routing_preprocessing": ("route", "routing", "preprocess", "preprocessing", "orientation", "deskew", "rotation", "rotate"),
}
CATEGORY_FACTORS = {"runtime_error": 1.25, "line_item_count_mismatch": 1.10, "line_item_arithmetic_mismatch": 1.10, "subtotal_mismatch": 1.05, "total_mismatch": 1.05, "currency_mismatch": 0.95}
ERROR_PREFIXES = {
    "Missing extracted field:": "missing_field",
    "Mismatch on ": "field_mismatch",
    "Line item count mismatch:": "line_item_count_mismatch",
    "Line item arithmetic mismatch": "line_item_arithmetic_mismatch",
    "Subtotal mismatch:": "subtotal_mismatch",
    "Total mismatch:": "total_mismatch",
    "Currency mismatch for country": "country_currency_mismatch",
}
REGION_WEIGHTS = {"header": 0.22, "identity": 0.28, "summary": 0.32, "footer": 0.12, "generic": 0.06}
TRIAGE_ORDER = ("over_broad_candidate", "high_value_unstable", "degraded_reuse", "suspiciously_tiny", "low_value_tail", "stable")

# Thresholds of the shipped configuration.
APPLY_THRESHOLD, DISCOVERY_THRESHOLD, SIMILARITY_THRESHOLD = 0.90, 0.95, 0.85
ESTABLISH_COUNT, ESTABLISH_CONFIDENCE, DEGRADATION, REDISCOVERY = 5, 0.95, 0.85, 3


def country_scores(text: Column) -> dict[str, Column]:
    """Points for each country from a text."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("[a-z]{2,}"), F.lit(0))
    zip_code, postal = low.rlike(US_ZIP), low.rlike(CA_POSTAL)

    def any_marker(code: str) -> Column:
        return reduce(lambda a, b: a | b, [has_marker(low, m) for m in COUNTRY_MARKERS[code]])

    def code_among(codes) -> Column:
        return F.arrays_overlap(words, F.array(*map(F.lit, codes)))

    def points(*cases) -> Column:
        return reduce(lambda a, b: a + b, [F.when(c, n).otherwise(0) for c, n in cases])

    return {
        "US": points((any_marker("US"), 3), (zip_code, 1), (zip_code & contains_any(low, US_STATES.values()), 3), (zip_code & code_among(US_STATES), 3)),
        "CA": points((any_marker("CA"), 3), (postal, 4), (contains_any(low, CA_PROVINCES.values()), 2), (postal & code_among(CA_PROVINCES), 3)),
        "MX": points((any_marker("MX"), 3), (low.rlike(MX_POSTAL) | (low.rlike(r"\d{6}") & low.rlike(MX_RFC)), 4), (contains_any(low, MX_STATES), 2)),
    }


def country(scores: dict[str, Column]) -> Column:
    """The country of most points, the first of US, CA and MX in ties; null below three."""
    best = F.greatest(*scores.values())
    return F.when(best >= 3, first_matching([(s == best, c) for c, s in scores.items()]))


def explicit_currency(text: Column) -> Column:
    low = F.lower(text)
    return first_matching([(has_marker(low, m), m.upper()) for m in ("cad", "mxn", "usd")])


def expected_currency(code: Column) -> Column:
    return first_matching([(code == c, cur) for c, cur in COUNTRY_CURRENCY.items()])


def currency(text: Column, code: Column) -> Column:
    """The currency that a text names, else its country's; without a country a dollar sign means USD."""
    return F.coalesce(explicit_currency(text), expected_currency(code), F.when(code.isNull() & text.contains("$"), "USD"))


def currency_error(code: Column, cur: Column) -> Column:
    """What is wrong with a country and its currency; null if nothing."""
    unsupported = F.concat(F.lit("Unsupported country code: "), code)
    other = F.concat(F.lit("Currency mismatch for country "), code, F.lit(": expected "), expected_currency(code), F.lit(", got "), cur)
    return F.when(~code.isin(*COUNTRY_CURRENCY), unsupported).when(expected_currency(code) != cur, other)


def line_category(description: Column) -> Column:
    low = F.lower(F.coalesce(description, F.lit("")))
    return first_matching([(contains_any(low, w), c) for c, w in LINE_CATEGORIES.items()], "other")


def field_bucket(name: Column) -> Column:
    """The bucket of issues that a field's name leads to."""
    plain = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    return let(plain, lambda p: first_matching([(contains_any(p, w), b) for b, w in FIELD_HINTS.items()], "scalar_reconciliation"))


def error_issue(error: Column, *, failed_run: Column | None = None, line_source: Column | None = None, table_found: Column | None = None, has_summary: Column | None = None, has_party: Column | None = None) -> Column:
    """(bucket, category) of an error, by its own words first, then by what is known of its invoice."""
    known = [(failed_run, ("routing_preprocessing", "runtime_error")), (None if line_source is None else line_source == "row_fallback", ("line_item_detection", "row_fallback"))]
    known += [(None if table_found is None else ~table_found, ("line_item_detection", "table_not_detected")), (has_summary, ("summary_amount_resolution", "summary_candidate_conflict")), (has_party, ("party_block_extraction", "party_block_diagnostic"))]

    def issue(bucket, category: str) -> Column:
        return F.struct((bucket if isinstance(bucket, Column) else F.lit(bucket)).alias("bucket"), F.lit(category).alias("category"))

    def of(x: Column) -> Column:
        text, plain = x["text"], x["plain"]
        cases = [
            (text == "", issue("other", "unknown")),
            (plain.startswith("runtime error") | plain.contains("exception"), issue("runtime_error", "runtime_error")),
            (plain.contains("line item count mismatch"), issue("line_item_detection", "line_item_count_mismatch")),
            (plain.contains("line item arithmetic mismatch"), issue("line_item_detection", "line_item_arithmetic_mismatch")),
            (plain.contains("subtotal mismatch"), issue("summary_amount_resolution", "subtotal_mismatch")),
            (plain.contains("total mismatch"), issue("summary_amount_resolution", "total_mismatch")),
            (plain.contains("currency mismatch"), issue("scalar_reconciliation", "currency_mismatch")),
            (x["missing"] != "", issue(field_bucket(x["missing"]), "missing_field")),
            (x["mismatch"] != "", issue(field_bucket(x["mismatch"]), "field_mismatch")),
        ]
        cases += [(F.coalesce(c, F.lit(False)), issue(*y)) for c, y in known if c is not None]
        return first_matching(cases, issue("scalar_reconciliation", "other"))

    def parts(text: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
        missing, mismatch = F.regexp_extract(text, r"(?i)^Missing extracted field:\s*(.+)$", 1), F.regexp_extract(text, r"(?i)^Mismatch on\s+(.+?):", 1)
        return F.struct(text.alias("text"), plain.alias("plain"), missing.alias("missing"), mismatch.alias("mismatch"))

    return let(let(F.trim(F.coalesce(error, F.lit(""))), parts), of)


def issue_weight(bucket: Column, category: Column, score: Column) -> Column:
    """A bucket's weight times its category's factor, more for a low score; to four places."""
    base = first_matching([(bucket == b, w) for b, w in BUCKET_WEIGHTS.items()], BUCKET_WEIGHTS["other"])
    factor = first_matching([(category == c, f) for c, f in CATEGORY_FACTORS.items()], 1.0)
    low = F.when(score < 0.5, 1.10).when(score < 0.8, 1.05).otherwise(1.0)
    return F.round(base * factor * low, 4)


def error_category(error: Column) -> Column:
    """An error's class by its prefix."""
    return first_matching([(error.startswith(p), c) for p, c in ERROR_PREFIXES.items()], "other")


def validation_category(error: Column) -> Column:
    """An error's class in a validation result, whatever its letters' case; all summary sums are one class."""
    low = F.lower(F.trim(error))
    sums = reduce(lambda a, b: a | b, [low.startswith(p) for p in ("subtotal mismatch", "tax mismatch", "total mismatch", "gross total mismatch")])
    cases = [
        (low.startswith("missing extracted field:"), "missing_field"),
        (low.startswith("mismatch on "), "field_mismatch"),
        (low.startswith("line item count mismatch"), "line_item_count_mismatch"),
        (low.startswith("line item arithmetic mismatch"), "line_item_arithmetic_mismatch"),
        (sums, "summary_arithmetic_mismatch"),
        (low.startswith("currency mismatch"), "country_currency_mismatch"),
    ]
    return first_matching(cases, "other")


def score_band(score: Column, threshold: float = DISCOVERY_THRESHOLD) -> Column:
    return first_matching([(score.isNull(), "unknown"), (score < 0.5, "<0.5"), (score < 0.8, "0.5-0.8"), (score < threshold, f"0.8-{threshold:.2f}")], f">={threshold:.2f}")


def rejected(score: Column, route: Column) -> Column:
    """Whether a validated result falls below its route's threshold."""
    return F.when(route == "APPLY", score < APPLY_THRESHOLD).when(route == "DISCOVERY", score < DISCOVERY_THRESHOLD).otherwise(False)


def trusted(apply_count: Column, confidence: Column) -> Column:
    """Enough checked successes to trust."""
    return F.coalesce((apply_count >= ESTABLISH_COUNT) & (confidence >= ESTABLISH_CONFIDENCE), F.lit(False))


def discovery_ready(total: Column, number: Column, date: Column) -> Column:
    """Whether a ground truth has a total and a number or a date."""
    return total.isNotNull() & (number.isNotNull() | date.isNotNull())


def triage(status: Column, applied: Column, rejects: Column, overrides: Column) -> Column:
    """(triage_class, triage_rank, invoice_count, pass_rate, reject_pressure, impact_score) of a family."""
    n = F.greatest(applied + rejects, F.lit(0))
    passing, pressure = ratio(applied, n), ratio(rejects, n)
    unresolved = (rejects > 0) | status.isin("degraded", "provisional")
    name = first_matching(
        [
            ((n >= 8) & (passing >= 0.8) & (pressure <= 0.2) & (status == "established"), "stable"),
            ((n >= 250) & (passing < 0.35) & (pressure >= 0.65), "over_broad_candidate"),
            ((n >= 40) & (rejects >= 15) & (passing < 0.5), "high_value_unstable"),
            ((n >= 15) & (rejects >= F.greatest(F.lit(8), applied * 2)) & (passing < 0.4), "degraded_reuse"),
            ((n <= 10) & unresolved & ((status == "degraded") | (overrides >= 3) | (rejects >= applied)), "suspiciously_tiny"),
        ],
        "low_value_tail",
    )
    rank = first_matching([(name == c, k) for k, c in enumerate(TRIAGE_ORDER)])
    return F.struct(
        name.alias("triage_class"), rank.alias("triage_rank"), n.alias("invoice_count"), F.round(passing, 4).alias("pass_rate"), F.round(pressure, 4).alias("reject_pressure"),
        F.round(rejects * 2.0 + n + overrides * 0.5, 2).alias("impact_score"),
    )


def reuse_multiplier(status: Column, applied: Column, rejects: Column, confidence: Column) -> Column:
    """A family's health, from 0.6 to 1, by its status, support, confidence and rejections."""
    a, r = F.greatest(applied, F.lit(0)), F.greatest(rejects, F.lit(0))
    by_status = first_matching([(status == s, m) for s, m in {"established": 1.0, "provisional": 0.94, "degraded": 0.78, "retired": 0.0}.items()], 0.9)
    pressure = r / F.greatest(a + r, F.lit(1))
    health = by_status * (0.94 + F.least(a, F.lit(20)) * 0.003) * (0.9 + clamp(confidence) * 0.1) * (1.0 - F.least(pressure * 0.28, F.lit(0.22)))
    return F.when((a == 0) & (r == 0) & (status != "degraded"), 1.0).otherwise(clamp(health, 0.6, 1.0))


def split_pressure(stored: Column, dominant: Column, average: Column, signatures: Column, members: Column) -> Column:
    """How much a family looks like several: the largest of its signals, each taken as none where it is null."""
    parts = [clamp(stored), F.greatest(F.lit(0.0), 1.0 - dominant), F.greatest(F.lit(0.0), 1.0 - average), F.when(members > 0, F.greatest(F.lit(0.0), (signatures - 1) / F.greatest(members, F.lit(1))))]
    return clamp(F.greatest(*[F.coalesce(p, F.lit(0.0)) for p in parts]))


def region_similarity(a: Column, b: Column) -> Column:
    """Weighted overlap of the token sets of two pages' regions; regions empty on both sides do not count."""
    def size(x: Column) -> Column:
        return F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))

    counts = {k: F.when((size(a[k]) > 0) | (size(b[k]) > 0), w).otherwise(0.0) for k, w in REGION_WEIGHTS.items()}
    total = reduce(lambda x, y: x + y, counts.values())
    shared = reduce(lambda x, y: x + y, [jaccard(a[k], b[k]) * w for k, w in REGION_WEIGHTS.items()])
    return F.when(total > 0, shared / total).otherwise(0.0)


def signature_similarity(a: Column, b: Column) -> Column:
    """Overlap of page roles, field names and anchor tokens; to four places."""
    return F.round(jaccard(a["page_roles"], b["page_roles"]) * 0.35 + jaccard(a["field_names"], b["field_names"]) * 0.35 + jaccard(a["anchor_tokens"], b["anchor_tokens"]) * 0.30, 4)


def role_deltas(expected: Column, observed: Column) -> Column:
    """(strong, variable): by how many header and summary pages, and line-item pages, two lists of roles differ."""

    def off(role: str) -> Column:
        return F.abs(F.size(F.filter(expected, lambda r: r == role)) - F.size(F.filter(observed, lambda r: r == role)))

    return F.struct((off("header_page") + off("summary_page")).alias("strong"), off("line_item_page").alias("variable"))


def family_score(aggregate: Column, alignment: Column, roles: Column, tokens: Column, same_provider: Column, strong: Column, variable: Column, page_delta: Column, health: Column, pressure: Column) -> Column:
    """How well a document fits a family."""
    raw = aggregate * 0.52 + alignment * 0.24 + roles * 0.16 + tokens * 0.05 + F.when(same_provider, 0.08).otherwise(0.0)
    raw = raw - (strong * 0.08 + variable * 0.02 + F.least(page_delta * 0.015, F.lit(0.06)))
    return raw * health - pressure * 0.12


def route(match_status: Column, family_status: Column, family_score: Column, family_threshold: float, native: Column, ready: Column) -> Column:
    """APPLY, DISCOVERY or FAIL, by the exact match, else the family, else native text, else the ground truth."""
    matched = match_status.isNotNull()
    family = ~matched & family_status.isNotNull() & (F.coalesce(family_score, F.lit(0.0)) >= family_threshold)
    return first_matching(
        [
            (matched & (match_status == "provisional") & ready, "DISCOVERY"),
            (family & (family_status == "provisional") & ready, "DISCOVERY"),
            (family & (family_status == "degraded") & ready, "DISCOVERY"),
            (family, "APPLY"),
            (matched & (match_status == "degraded") & ready, "DISCOVERY"),
            (matched, "APPLY"),
            (native & ~ready, "APPLY"),
            (ready, "DISCOVERY"),
        ],
        "FAIL",
    )


def extraction_strategy(matched: Column, family_matched: Column, own: Column) -> Column:
    return F.when(matched | family_matched, "provider_template").otherwise(own)


def family_status(applied: Column, rejects: Column, confidence: Column) -> Column:
    """A family's status from its rolled-up outcomes."""
    return first_matching(
        [
            ((rejects > applied) & (rejects > 0), "degraded"),
            ((applied >= ESTABLISH_COUNT) & (confidence >= ESTABLISH_CONFIDENCE), "established"),
            ((rejects >= REDISCOVERY) & (confidence < DEGRADATION), "degraded"),
        ],
        "provisional",
    )


def healing_authority(family_trusted: Column, fingerprint_trusted: Column) -> Column:
    """Whose trust allows a retry without ground truth: the family's precedes the fingerprint's."""
    return F.when(family_trusted, "family").when(fingerprint_trusted, "fingerprint")
