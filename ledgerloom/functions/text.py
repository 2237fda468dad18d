"""Strings: normal forms, edit distance, token sets, and the classifications that keywords decide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits that OCR confuses with letters, and the keywords of document families and line categories.
OCR_DIGITS, OCR_LETTERS = "01357", "oiest"
ESTIMATE_WORDS = ("estimate", "treatment plan")
STATEMENT_WORDS = ("statement", "account summary")
INVOICE_WORDS = ("invoice", "receipt", "bill to")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def squeezed(s: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def cleaned(s: Column) -> Column:
    """``squeezed``; null if nothing is left."""
    return F.nullif(squeezed(s), F.lit(""))


def ocr_text(s: Column) -> Column:
    """Lower case, look-alike digits as letters, anything but letters and digits as one space."""
    swapped = F.translate(F.lower(s), OCR_DIGITS, OCR_LETTERS)
    return F.trim(F.regexp_replace(swapped, "[^a-z0-9]+", " "))


def key(s: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")


def anchor(s: Column) -> Column:
    """Lower case with one space for anything but letters and digits."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def contains_any(s: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [s.contains(w) for w in words])


def first_matching(cases, default=None) -> Column:
    """The value of the first case (condition, value) that holds."""
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def words(s: Column) -> Column:
    """The words of a text as an array without empty ones."""
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def has_marker(s: Column, marker: str) -> Column:
    """A marker of two to four letters as a word of its own, any other as a substring; of lower-case text."""
    if 2 <= len(marker) <= 4 and marker.isascii() and marker.isalpha():
        return s.contains(marker) & s.rlike(f"(^|[^a-z]){marker}($|[^a-z])")
    return s.contains(marker)


def document_family(text: Column) -> Column:
    """estimate, statement, invoice or unknown, in this precedence."""
    low = F.lower(text)
    return first_matching(
        [(contains_any(low, ESTIMATE_WORDS), "estimate"), (contains_any(low, STATEMENT_WORDS), "statement"), (contains_any(low, INVOICE_WORDS), "invoice")], "unknown"
    )


def source_format(path: Column, native_text: Column | None = None) -> Column:
    """pdf_text, pdf_scanned, image or unknown, by the suffix and whether a PDF has text of its own."""
    low = F.lower(path)
    pdf = F.lit("pdf_scanned") if native_text is None else F.when(F.length(F.trim(F.coalesce(native_text, F.lit("")))) > 0, "pdf_text").otherwise("pdf_scanned")
    return first_matching([(low.endswith(".pdf"), pdf), (low.rlike(r"[.](png|jpg|jpeg)$"), "image")], "unknown")


def path_stem(path: Column) -> Column:
    """A path's last part without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)[.][^.]*$", "")


def in_dataset(path: Column, name: str) -> Column:
    """Whether a path has a part of that name."""
    return F.array_contains(F.split(path, "/"), name)


def key_values(text: Column) -> Column:
    """A map of ``key: value`` lines, split at the first colon; of equal keys the first line's value."""
    pairs = F.transform(F.split(text, "\n"), lambda x: F.struct(squeezed(F.regexp_extract(x, "^([^:]*):", 1)).alias("key"), squeezed(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("value")))
    sound = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    # Sorted by key and place, a key's first line is the one that another key stands before.
    placed = F.array_sort(F.transform(sound, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["value"].alias("value"))))
    first = let(placed, lambda xs: F.filter(xs, lambda p, i: (i == 0) | (F.get(xs, i - 1)["key"] != p["key"])))
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["key"], p["value"])))


# How native text names its fields. The last group holds the value.
FIELD_PATTERNS = {
    "invoice_number": r"(?i)\b(invoice|receipt)\s*(no|number|#)\b[:\s-]*(.+)",
    "invoice_date": r"(?i)\b(date|invoice date)\b[:\s-]*(.+)",
    "total": r"(?i)\b(total|amount due|balance due)\b[:\s-]*([$A-Z0-9., -]+)",
    "subtotal": r"(?i)\b(subtotal)\b[:\s-]*([$A-Z0-9., -]+)",
    "tax": r"(?i)\b(tax|gst|hst|pst|vat)\b[:\s-]*([$A-Z0-9., -]+)",
}
FIELD_GROUP = {"invoice_number": 3, "invoice_date": 2, "total": 2, "subtotal": 2, "tax": 2}


def native_field(lines: Column, name: str) -> Column:
    """A field's value from the first of the lines (an array) that its pattern finds."""
    pattern = FIELD_PATTERNS[name]
    return squeezed(F.regexp_extract(F.get(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(0)), pattern, FIELD_GROUP[name]))


_NUMBER = r"^([$€£]?\d[\d,]*[.]?\d{0,2}|\d+([.]\d+)?)$"
SUMMARY_WORDS = ("subtotal", "total", "tax", "balance due", "amount due")


def line_item(line: Column) -> Column:
    """(description, quantity, unit_price, amount) of a line that ends in two numbers or more; else null.

    The description is what stands before the longest run of numbers at the end.
    """
    tokens = F.split(squeezed(line), " ")
    n = F.size(tokens)
    last_word = F.array_max(F.transform(tokens, lambda t, i: F.when(~t.rlike(_NUMBER), i).otherwise(F.lit(-1))))
    head = F.slice(tokens, F.lit(1), last_word + 1)
    tail = F.slice(tokens, last_word + 2, F.greatest(n - last_word - 1, F.lit(0)))
    description = F.array_join(head, " ")
    sound = ~line.contains(":") & (n >= 3) & (last_word >= 0) & (n - last_word - 1 >= 2) & ~contains_any(F.lower(description), SUMMARY_WORDS)
    item = F.struct(description.alias("description"), F.element_at(tail, 1).alias("quantity"), F.when(F.size(tail) >= 3, F.element_at(tail, -2)).alias("unit_price"), F.element_at(tail, -1).alias("amount"))
    return F.when(sound, item)


def family_slug(provider: Column, signature: Column) -> Column:
    """``family-<slug>-<hash>``: up to 24 characters of the name and 12 of the signature's SHA-256."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(provider, F.lit("generic"))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 24)
    return F.concat(F.lit("family-"), slug, F.lit("-"), F.substring(F.sha2(signature, 256), 1, 12))


def ngrams(tokens: Column, longest: int = 4) -> Column:
    """All runs of 1 to ``longest`` neighbouring tokens, each joined by spaces, shorter runs first at each place."""
    runs = F.transform(tokens, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(tokens) - i)), lambda n: F.array_join(F.slice(tokens, i + 1, n), " ")))
    return F.when(F.size(tokens) > 0, F.flatten(runs)).otherwise(F.array().cast("array<string>"))
