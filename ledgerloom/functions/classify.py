"""What a row of a page is about, how well a text names a party, and how well a token is a field's value.

All of it is ``Column -> Column`` over a row's text; ``ocr_text`` is the plain form that the word lists are held against.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import token_number
from ledgerloom.functions.text import contains_any, first_matching, let, ocr_text, squeezed, words

# Words that name parties, sums, the columns of a table, addresses and countries.
BUSINESS_SUFFIXES = ("ltd", "limited", "llc", "inc", "corp", "co", "company", "gmbh", "plc", "pty", "ag", "bv")
PARTY_LABELS = {
    "vendor_block": ("vendor", "seller", "supplier", "from", "sold by"),
    "bill_to_block": ("bill to", "invoice to", "sold to", "customer", "client", "owner"),
    "ship_to_block": ("ship to", "deliver to", "delivery to"),
    "remit_to_block": ("remit to", "payment to", "pay to"),
}
SUMMARY_CUES = {
    "subtotal": ("subtotal", "sub total", "net amount"),
    "tax": ("tax", "sales tax", "vat", "gst"),
    "invoice_total": ("invoice total", "total"),
    "amount_due": ("amount due", "total due"),
    "balance_due": ("balance due",),
    "shipping": ("shipping", "shipping and handling", "handling", "s h"),
}
TABLE_HEADERS = {
    "description": ("description", "item", "product", "details", "service"),
    "quantity": ("qty", "quantity", "hours", "units"),
    "amount": ("amount", "total", "line total", "price", "unit price", "rate"),
}
TABLE_WORDS = ("gross", "net", "vat", "worth", "unit", "price", "quantity", "qty")
SUM_PHRASES = ("subtotal", "sales tax", "tax", "total due", "amount due", "balance due", "invoice total")
METADATA_LABELS = ("invoice", "date", "due", "iban", "swift", "id")
BANNERS = ("invoice", "tax invoice", "commercial invoice")
ADDRESS_STOPS = ("invoice", "invoice no", "invoice number", "date", "due date", "subtotal", "tax", "total", "amount due", "balance due")
BOUNDARY_WORDS = (
    "address", "addr", "attention", "attn", "bill", "city", "country", "date", "description", "email", "fax", "invoice", "phone", "postal", "postcode", "province", "summary", "table",
    "tax", "total", "subtotal", "vat", "website", "www", "zip",
)
STREET_WORDS = ("apt", "ave", "avenue", "blvd", "drive", "dr", "floor", "lane", "ln", "plaza", "rd", "road", "room", "route", "st", "street", "suite", "ste", "unit")
STREET_HINTS = ("street", "st", "road", "rd", "drive", "dr", "suite", "ste", "box", "oval", "plains", "course", "neck")
PLACE_WORDS = ("country", "city", "state", "province", "postal", "postcode", "zip")
COUNTRY_NAMES = ("canada", "mexico", "usa", "united states")
ACCOUNT_MARKERS = ("tax id", "iban", "swift", "routing", "account no")
NOISE = r"phone|tel\b|fax\b|vat\b|iban\b|swift code|bic\b"
EDGE = " :,-|"


def stripped(s: Column, marks: str = EDGE) -> Column:
    """Without any of the marks at either end."""
    kind = "[" + "".join("\\" + m if m in "-|]^\\" else m for m in marks) + "]+"
    return F.regexp_replace(F.regexp_replace(s, "^" + kind, ""), kind + "$", "")


def _digits(s: Column) -> Column:
    return F.length(F.regexp_replace(s, r"\D", ""))


def _any_word(ws: Column, names) -> Column:
    return F.arrays_overlap(ws, F.array(*[F.lit(n) for n in names]))


def _whole(plain: Column, names) -> Column:
    return plain.rlike("(?<![a-z0-9])(" + "|".join(names) + ")(?![a-z0-9])")


def noise(plain: Column) -> Column:
    """Whether a plain text is empty, or speaks of telephones and bank accounts."""
    return (plain == "") | plain.rlike(NOISE)


def party_cues(plain: Column) -> Column:
    """Whether a plain text has a label of parties or the suffix of a firm."""
    return (plain != "") & (contains_any(plain, [x for xs in PARTY_LABELS.values() for x in xs]) | _any_word(F.split(plain, " "), BUSINESS_SUFFIXES))


def summary_cues(plain: Column) -> Column:
    """Whether a plain text has a label of sums."""
    return contains_any(plain, sorted({x for xs in SUMMARY_CUES.values() for x in xs}))


def mixed(text: Column, plain: Column) -> Column:
    """Whether a row of eight words or more speaks of sums with a figure, and of a party or an account as well."""
    return (F.size(F.split(plain, " ")) >= 8) & summary_cues(plain) & text.rlike(r"\d") & (party_cues(plain) | noise(plain))


def header_count(plain: Column) -> Column:
    """How many of a table's columns a row names."""
    return reduce(lambda a, b: a + b, [_whole(plain, names).cast("int") for names in TABLE_HEADERS.values()])


def tableish(text: Column, plain: Column) -> Column:
    """Whether a row heads a table or is a numbered line of one."""
    n = header_count(plain)
    numbered = text.rlike(r"^\s*[|]?\s*\d{1,3}[.:]?\b") & text.rlike(r"\p{L}")
    return (plain != "") & ((n >= 2) | plain.isin("item", "items") | ((n >= 1) & contains_any(plain, TABLE_WORDS)) | numbered)


def metadataish(text: Column, plain: Column) -> Column:
    """Whether a row has a label of the invoice's own data and a figure, and no sum."""
    return (plain != "") & ~contains_any(plain, SUM_PHRASES) & (_whole(plain, METADATA_LABELS) | plain.contains("issue")) & text.rlike(r"\d")


def banner(plain: Column) -> Column:
    return plain.isin(*BANNERS)


def contactish(text: Column, plain: Column) -> Column:
    """Whether a row is empty, a way to reach someone, or an address with a number."""
    return noise(plain) | text.rlike(r"\b\d{3}[- ]?\d{3}[- ]?\d{4}\b") | plain.rlike(r"\b[a-z]\d[a-z]\b") | (_digits(text) >= 5)


def row_classes(text: Column) -> Column:
    """noise, party, summary, mixed, table, metadata, banner and contact as booleans, and the number of header words, of a row's text."""
    return let(
        F.struct(F.coalesce(text, F.lit("")).alias("t"), ocr_text(F.coalesce(text, F.lit(""))).alias("p")),
        lambda x: F.struct(
            noise(x["p"]).alias("noise"), party_cues(x["p"]).alias("party"), summary_cues(x["p"]).alias("summary"), mixed(x["t"], x["p"]).alias("mixed"), header_count(x["p"]).alias("headers"),
            tableish(x["t"], x["p"]).alias("table"), metadataish(x["t"], x["p"]).alias("metadata"), banner(x["p"]).alias("banner"), contactish(x["t"], x["p"]).alias("contact"),
        ),
    )


def trimmed_party(text: Column) -> Column:
    """A party's name: the words before the first that starts an address, a label, a country or a link.

    Words without a letter or digit are left out. A number ends the name if one of the next three words speaks of a place.
    """
    stops = (*BOUNDARY_WORDS, *STREET_WORDS, *ADDRESS_STOPS)

    def cut(ws: Column) -> Column:
        def of(plain: Column) -> Column:
            place = lambda i: F.exists(F.slice(plain, i + 2, F.lit(3)), lambda w: w.isin(*stops, *PLACE_WORDS))
            ends = lambda w, i: w.isin(*COUNTRY_NAMES, *stops) | F.get(ws, i).rlike(r"(?i)https?://|www\.|@") | w.rlike(r"^\d{5}$") | (w.rlike(r"^\d{1,5}$") & place(i))
            first = F.array_position(F.transform(plain, lambda w, i: (w != "") & ends(w, i)), True)
            kept = F.slice(F.arrays_zip(ws.alias("w"), plain.alias("p")), F.lit(1), F.when(first > 0, first.cast("int") - 1).otherwise(F.size(ws)))
            return F.array_join(F.transform(F.filter(kept, lambda x: x["p"] != ""), lambda x: x["w"]), " ")

        return let(F.transform(ws, ocr_text), of)

    return stripped(let(F.filter(F.split(stripped(squeezed(F.coalesce(text, F.lit("")))), " "), lambda w: w != ""), cut))


def _shorter(text: Column, original: Column) -> Column:
    """A customer's name without the firm that follows it in the same row."""

    def of(ws: Column, text: Column) -> Column:
        head, rest = F.get(ws, F.lit(0)), F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0)))
        capital = head.rlike(r"^\p{L}")
        upper = lambda w: w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")
        firm = F.size(F.filter(rest, upper)) >= 2
        all_caps = F.forall(rest, lambda w: ~w.rlike(r"^\p{L}+$") | (F.upper(w) == w))
        alone = head.rlike(r"^\p{Lu}") & (head != F.upper(head)) & all_caps & firm
        suffixed = _any_word(F.split(ocr_text(F.array_join(rest, " ")), " "), BUSINESS_SUFFIXES)
        piped = original.contains("|") & head.rlike(r"^\p{Lu}") & (suffixed | firm)
        bare = stripped(head, " :")
        first = original.contains("|") & bare.rlike(r"^\p{L}") & ~bare.rlike(r"\d")
        return F.when(F.coalesce(first, F.lit(False)), bare).when((F.size(ws) > 1) & capital & (alone | piped), head).otherwise(text)

    return let(F.struct(text.alias("t"), words(text).alias("w")), lambda x: of(x["w"], x["t"]))


def _undoubled(text: Column) -> Column:
    """Without the second of two equal runs of one to four words at the beginning."""

    def of(ws: Column) -> Column:
        sizes = F.filter(F.array(*[F.lit(k) for k in (4, 3, 2, 1)]), lambda k: (F.size(ws) >= k * 2) & (F.slice(ws, F.lit(1), k) == F.slice(ws, k + 1, k)))
        return let(F.get(sizes, F.lit(0)), lambda k: F.array_join(F.when(k.isNotNull(), F.concat(F.slice(ws, F.lit(1), k), F.slice(ws, k * 2 + 1, F.size(ws)))).otherwise(ws), " "))

    return let(words(text), of)


def line_score(t: Column, p: Column) -> Column:
    """``party_line_score`` of a text that is not null and its plain form."""
    ws = F.split(p, " ")
    n = F.size(ws)
    suffix, upper = _any_word(ws, BUSINESS_SUFFIXES), F.upper(t) == t
    initials = (n <= 3) & F.forall(ws, lambda w: w.rlike("^[a-z]{1,3}$")) & upper & ~suffix
    good = F.lit(0.2) + F.when(suffix, 0.35).otherwise(0.0) + F.when(n.isin(2, 3, 4), 0.15).otherwise(0.0) + F.when(upper & (n <= 4), 0.08).otherwise(0.0)
    return first_matching(
        [
            ((p == "") | contains_any(p, ACCOUNT_MARKERS) | p.isin(*COUNTRY_NAMES), -1.0),
            (p.isin(*ADDRESS_STOPS) | p.endswith(" to"), -0.6),
            (~p.rlike("[a-z]"), -0.5),
            ((n == 1) & suffix, -0.45),
            (initials, -0.5),
            (n > 8, -0.2),
            (noise(p), -0.5),
            (_digits(t) >= 5, -0.3),
        ],
        good,
    )


def party_line_score(text: Column) -> Column:
    """How well a text reads as a party's name, from -1; 0.2 and more for plain words, most for a firm's."""
    whole = F.coalesce(text, F.lit(""))
    return let(F.struct(whole.alias("t"), ocr_text(whole).alias("p")), lambda x: line_score(x["t"], x["p"]))


CUSTOMER_ROLES = ("bill_to_block", "ship_to_block")


def role_score(t: Column, p: Column, c: Column, cp: Column, score: Column, role: str) -> Column:
    """How well a row names the party of a role, from its text, the name it gives, both in plain form, and the name's ``line_score``."""
    numbered = c.rlike(r"\d")
    prefix = (cp != "") & p.startswith(cp) & (F.size(F.split(cp, " ")) <= 4)
    street = t.rlike(r"\d") & _any_word(F.split(p, " "), STREET_HINTS)
    postal = t.rlike(r",\s*[A-Z]{2}\b") | t.rlike(r"\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b")
    terms = [
        F.when(numbered, -0.35),
        F.when((F.size(F.split(cp, " ")) <= 2) & ~numbered, 0.18),
        F.when(t.contains("|"), 0.2) if role in CUSTOMER_ROLES else F.lit(0.0),
        F.when(_any_word(F.split(cp, " "), BUSINESS_SUFFIXES), 0.15) if role == "vendor_block" else F.lit(0.0),
        F.when(street, F.when(prefix, -0.15).otherwise(-0.55)),
        F.when(postal, F.when(prefix, -0.15).otherwise(-0.45)),
        F.when(contactish(c, cp), -0.55),
    ]
    return F.when((c == "") | banner(cp), -1.0).otherwise(score + reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in terms]))


def named(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with what rows say of parties, each column worked out once: ``__t`` and ``__p`` (the text, plain), ``__long`` and ``__short`` (the name it
    gives a seller and a customer), their plain forms and scores (``__lp``, ``__ls``, ``__sp``, ``__ss``), ``__rs`` (the text's own score), and ``__seller`` and ``__buyer`` (as rows of their blocks)."""
    c = F.col
    plain = F.regexp_replace(F.regexp_replace(c("__t"), r"\b\S+@\S+\b", " "), r"(?i)\b(?:e-?mail|email)\b", " ")
    bare = F.regexp_replace(plain, r"(?i)^(?:\s*(?:tax\s+invoice|commercial\s+invoice|invoice|invoices)\b[:\s-]*)+", "")
    first = F.get(F.filter(F.transform(F.split(c("__b"), r"\|"), lambda x: stripped(x, " :")), lambda x: x != ""), F.lit(0))
    cut = F.get(F.split(c("__n"), r"(?i)\b(?:invoice|invoices|date|due|www\.|https?://)\b", 2), F.lit(0))
    lead = stripped(F.get(words(c("__s")), F.lit(0)), " :")
    piped = F.ltrim(c("__b")).startswith("|") & lead.rlike(r"^\p{L}\D*$")
    few = c("__b").contains("|") & c("__s").isNotNull() & (F.size(F.split(ocr_text(c("__s")), " ")) <= 3)
    gone = c("__mixed") | ocr_text(c("__n")).isin(*COUNTRY_NAMES)
    d = df.withColumn("__t", F.coalesce(c(text), F.lit(""))).withColumn("__p", ocr_text(c("__t"))).withColumn("__b", bare).withColumn("__s", first)
    d = d.withColumn("__n", trimmed_party(F.when(c("__b").contains("|"), F.coalesce("__s", "__b")).otherwise(c("__b")))).withColumn("__n", stripped(cut, " :"))
    d = d.withColumn("__n", stripped(F.get(F.split(c("__n"), r"\b\d{3,}\b", 2), F.lit(0)), " :")).withColumn("__mixed", mixed(c("__t"), c("__p")))
    d = d.withColumn("__x", stripped(_shorter(c("__n"), c("__t")), " :"))
    d = d.withColumns({"__long": F.when(gone, "").otherwise(_undoubled(c("__n"))), "__short": F.when(F.coalesce(piped, F.lit(False)), lead).when(F.coalesce(few, F.lit(False)), c("__s")).otherwise(_undoubled(c("__x")))})
    d = d.withColumns({"__lp": ocr_text(c("__long")), "__sp": ocr_text(c("__short"))})
    away = c("__mixed") | c("__sp").isin(*COUNTRY_NAMES)
    d = d.withColumns({"__short": F.when(away, "").otherwise(c("__short")), "__sp": F.when(away, "").otherwise(c("__sp"))})
    d = d.withColumns({"__rs": line_score(c("__t"), c("__p")), "__ls": line_score(c("__long"), c("__lp")), "__ss": line_score(c("__short"), c("__sp"))})
    scores = {"__seller": role_score(c("__t"), c("__p"), c("__long"), c("__lp"), c("__ls"), "vendor_block"), "__buyer": role_score(c("__t"), c("__p"), c("__short"), c("__sp"), c("__ss"), "bill_to_block")}
    return d.withColumns(scores).drop("__b", "__s", "__n", "__x")


def row_block_class(t: Column, p: Column, seller: Column, buyer: Column) -> Column:
    """table, summary, party, metadata or other: what a row adds to a block, from its text, the plain form and its scores as a party's."""
    summary = (p == "summary") | (summary_cues(p) & ~mixed(t, p))
    return first_matching([(p == "", "other"), (tableish(t, p), "table"), (summary, "summary"), (party_cues(p), "party"), (F.greatest(seller, buyer) >= 0.22, "party"), (metadataish(t, p), "metadata")], "other")


def without_overlap(name: Column, other: Column, suffix_last: bool = False) -> Column:
    """A party's name without leading firm words, and without words of the other party that ran into it.

    Words that the other name has go from either end while an ``and`` or a comma still stands, and firm words of it from
    the rest. ``suffix_last``: a suffix before the last word goes behind it.
    """
    firm = F.array(*[F.lit(x) for x in ("and", "corporation", "corp", *BUSINESS_SUFFIXES)])
    shared = F.array(*[F.lit(x) for x in (*BUSINESS_SUFFIXES, "group", "sons", "corporation", "corp")])

    def lead(ws: Column) -> Column:
        """Leading firm words go, but for the last word."""
        at = F.array_position(F.transform(ws, lambda w: ~F.array_contains(firm, ocr_text(w))), True).cast("int")
        start = F.when(at == 0, F.size(ws)).otherwise(at)
        return F.slice(ws, F.greatest(start, F.lit(1)), F.size(ws))

    def joined(ws: Column, own: Column) -> Column:
        joins = lambda xs: F.exists(xs, lambda w: w.isin(",", "and"))

        def shave(xs: Column, front: bool) -> Column:
            edge = lambda a: F.get(a, F.lit(0)) if front else F.element_at(a, -1)
            rest = lambda a: F.slice(a, F.lit(2 if front else 1), F.size(a) - 1)
            step = lambda a, _: F.when((F.size(a) > 2) & F.array_contains(own, ocr_text(edge(a))) & joins(rest(a)), rest(a)).otherwise(a)
            return F.aggregate(F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs))).otherwise(F.array().cast("array<int>")), xs, step)

        kept = lambda xs: F.filter(xs, lambda w, i: (i == 0) | ~(F.array_contains(own, ocr_text(w)) & F.array_contains(shared, ocr_text(w))))
        return let(let(let(shave(ws, True), lambda a: shave(a, False)), lead), lambda a: F.when(F.size(kept(a)) > 0, kept(a)).otherwise(a))

    def ordered(ws: Column) -> Column:
        last, before = ocr_text(F.element_at(ws, -1)), ocr_text(F.try_element_at(ws, F.lit(-2)))
        swapped = F.array(F.element_at(ws, -1), F.try_element_at(ws, F.lit(-2)))
        return F.when((F.size(ws) >= 2) & before.isin(*BUSINESS_SUFFIXES) & ~last.isin(*BUSINESS_SUFFIXES), swapped).otherwise(ws)

    differs = other.isNotNull() & (ocr_text(other) != ocr_text(name))
    cut = let(lead(words(name)), lambda ws: F.when(differs, joined(ws, F.split(ocr_text(F.coalesce(other, F.lit(""))), " "))).otherwise(ws))
    done = let(cut, lambda ws: F.array_join(F.when(F.size(ws) > 0, ordered(ws)).otherwise(ws) if suffix_last else ws, " "))
    return F.when(name.isNull() | (F.trim(name) == ""), name).otherwise(done)


# --- labels before values -------------------------------------------------------------------------------------------

# The labels that a scanned date or invoice number may bring along, and the words that end a number.
DATE_LABEL = r"(?i)^\s*(?:date(?:\s+of\s+issue)?|invoice\s+date|issue\s+date|of\s+issue)\b(?:\s*[:#-]|\s+)?\s*"
INVOICE_LABEL = r"(?i)^\s*(?:invoice(?:\s*(?:no\.?|number|#))?|inv(?:\s+(?:no\.?|number)|\s*#|(?=\s*:)))\s*[:#-]?\s*"
NUMBER_STOPS = (*BOUNDARY_WORDS, "street", "st", "suite", "unit", "apt", "road", "rd", "lane", "ln", "drive", "dr", "floor")


def date_text(value: Column) -> Column:
    """A date's text without the label before it."""
    return stripped(F.regexp_replace(squeezed(F.coalesce(value, F.lit(""))), DATE_LABEL, ""))


def invoice_number_text(value: Column) -> Column:
    """An invoice number without its label and without what follows it; as it is where no figure would be left."""

    def of(text: Column) -> Column:
        ws = words(text)
        plain = lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", "")
        ends = F.transform(ws, lambda w, i: (plain(w) != "") & (plain(w).isin(*NUMBER_STOPS) | w.rlike(r"(?i)https?://|www\.|@")))
        first = F.array_position(ends, True).cast("int")
        kept = F.filter(F.slice(ws, F.lit(1), F.when(first > 0, first - 1).otherwise(F.size(ws))), lambda w: plain(w) != "")
        joined = F.array_join(kept, " ")
        return F.when((F.size(ws) >= 2) & joined.rlike(r"\d"), stripped(joined)).otherwise(text)

    bare = stripped(F.regexp_replace(squeezed(F.coalesce(value, F.lit(""))), INVOICE_LABEL, ""))
    return let(F.trim(F.regexp_replace(bare, r"[|,;:\s-]+$", "")), of)


# --- candidates for a field's value ---------------------------------------------------------------------------------

AMOUNT_TOKEN = r"[$€£]?\s*-?\d[\d,]*(?:\.\d{2})?"
DATE_TOKEN = r"(?i)(?:\d{4}[/-]\d{1,2}[/-]\d{1,2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{2,4})"
SUM_FIELDS = ("total", "subtotal", "tax", "amount", "shipping", "discount")


def is_sum(field: Column) -> Column:
    return contains_any(F.lower(field), SUM_FIELDS)


def clean_candidate(field: Column, value: Column) -> Column:
    """What of a text can be the field's value: its date, last amount or number; else 80 characters. Null where there is none."""
    v, low = F.trim(value), F.regexp_replace(F.lower(field), "[^a-z0-9]", "")
    found = lambda p: F.nullif(F.trim(F.regexp_extract(v, p, 0)), F.lit(""))
    last_amount = F.trim(F.element_at(F.regexp_extract_all(v, F.lit(AMOUNT_TOKEN), F.lit(0)), F.lit(-1)))
    bare = F.trim(F.regexp_replace(v, r"(?i)^(?:invoice(?:\s+no\.?|\s+number)?|inv\s+no\.?|no\.?|number)[:#\s.-]+", ""))
    number = F.nullif(F.regexp_extract(bare, r"(?i)\b[A-Z0-9][A-Z0-9./-]{1,}\b", 0), F.lit(""))
    numbered = low.contains("invoice") & (low.contains("number") | low.endswith("no") | low.contains("invoiceno"))
    amount = F.when(v.rlike(AMOUNT_TOKEN), last_amount)
    return F.when(v != "", first_matching([(low.contains("date"), found(DATE_TOKEN)), (is_sum(field), amount), (numbered, F.when(number.rlike(r"\d"), number))], F.trim(F.substring(v, 1, 80))))


def place_prior(field: Column, x: Column, y: Column) -> Column:
    """What a value's place on the page (in shares) speaks for a field."""
    k = F.regexp_replace(F.lower(field), "[^a-z0-9]", "")
    high = lambda at, slope: F.greatest(F.lit(0.0), F.lit(at) - y * slope)
    add = lambda c, n: F.when(c, n).otherwise(0.0)
    return first_matching(
        [
            (k.isin("invoicenumber", "ponumber", "purchaseorder"), high(0.16, 0.18) + add(x < 0.7, 0.04)),
            (k.contains("date"), high(0.14, 0.16) + add(x < 0.75, 0.03)),
            (k.isin("total", "totalamount") | (k.contains("amount") & ~k.contains("tax")), add(x > 0.55, 0.12) + add(y > 0.55, 0.14)),
            (contains_any(k, ("subtotal", "tax", "shipping", "discount")), add(x > 0.5, 0.08) + add(y > 0.5, 0.10)),
            (k == "sellername", add(y < 0.28, 0.12) + add(x < 0.55, 0.05)),
            (k == "customername", add((y >= 0.08) & (y <= 0.55), 0.06) + add(x < 0.7, 0.03)),
        ],
        0.0,
    )


def _sum_of(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0.0)) for t in terms])


def invoice_candidate_score(value: Column, x: Column, y: Column) -> Column:
    """How well a token at (x, y), in shares of the page, reads as the invoice's number."""
    v = F.trim(value)
    only = F.regexp_replace(v, r"\D", "")
    digits, letters = F.length(only), F.length(F.regexp_replace(v, r"[^\p{L}]", ""))
    return _sum_of([
        digits * 0.18 + F.least(letters, F.lit(4)) * 0.06, F.when(digits == 0, -0.6), F.when(F.length(v) < 3, -0.5), F.when(digits <= 3, -0.25), F.when(digits == 4, -0.75), F.when(v.rlike(r"^\d{5}-\d{3,4}$"), -1.3),
        F.when(F.lower(v).rlike(r"^\d+(?:st|nd|rd|th)$"), -1.5), F.when(v.rlike("[$€£]"), -0.8), F.when(ocr_text(v).isin("invoice", "number", "date", "total"), -0.8), place_prior(F.lit("invoiceNumber"), x, y), F.when(x > 0.8, -0.15),
    ])


def date_candidate_score(day: Column, x: Column, y: Column) -> Column:
    """How well a date (as a date; null: none that is valid) at (x, y) reads as the invoice's."""
    own = 0.5 + place_prior(F.lit("invoiceDate"), x, y)
    return F.when(F.year(day).between(1990, 2100), _sum_of([own, F.when(y > 0.55, -0.35), F.when(x > 0.85, -0.1)])).otherwise(-1.0)


def amount_candidate_score(field: Column, value: Column, x: Column, y: Column, row_text: Column) -> Column:
    """How well an amount at (x, y) in a row reads as the value of a field of sums."""

    def of(s: Column) -> Column:
        n, p, f = s["n"], s["p"], F.lower(field)
        named = first_matching([
            (p.contains("subtotal") & f.contains("subtotal"), 0.28), (p.contains("tax") & f.contains("tax"), 0.28),
            (p.contains("total") & ~p.contains("subtotal") & ~p.contains("tax"), F.when(f.contains("total") | f.contains("amount"), 0.34).otherwise(0.0)),
            (contains_any(p, ("amount due", "balance due")) & f.contains("total"), 0.3),
        ], 0.0)
        dated = p.contains("date") & ~contains_any(p, ("subtotal", "tax", "total", "amount due", "balance due"))
        score = _sum_of([
            0.4 + place_prior(field, x, y), F.when((n < 0) & is_sum(field), -1.4), F.when(n < 1, -0.4).when(n < 10, -0.2), F.when(~value.rlike(r"[.,$€£]"), -0.18), F.when(F.trim(value).rlike(r"^\d{1,2},?$"), -0.5),
            F.when(x > 0.7, 0.18).when(x < 0.35, -0.08), F.when(y > 0.65, 0.18), F.when(dated, -0.45), named,
        ])
        return F.when(n.isNull(), -1.0).otherwise(score)

    return let(F.struct(token_number(value).alias("n"), ocr_text(row_text).alias("p")), of)


def percentage_of(value: Column, row_text: Column) -> Column:
    """Whether the row shows the value as a percentage."""
    bare = F.trim(F.regexp_replace(F.trim(value), "^[$€£]+", ""))
    return (bare != "") & F.regexp_like(row_text, F.concat(F.lit(r"(?<!\d)\Q"), bare, F.lit(r"\E\s*%")))


def summary_amounts(row_text: Column) -> Column:
    """The different amounts of a row that are no percentages, in order; those within a cent of an earlier one go."""
    found = F.filter(F.transform(F.regexp_extract_all(row_text, F.lit(AMOUNT_TOKEN), F.lit(0)), lambda v: F.trim(v)), lambda v: ~percentage_of(v, row_text))
    numbers = F.filter(F.transform(found, token_number), lambda n: n >= 0)
    return F.aggregate(numbers, F.array().cast("array<double>"), lambda a, n: F.when(F.exists(a, lambda m: F.abs(m - n) < 0.01), a).otherwise(F.array_append(a, n)))


def repeated_triplet(row_text: Column) -> Column:
    """Whether a row repeats subtotal, tax and total side by side."""
    p = ocr_text(row_text)
    return (F.size(summary_amounts(row_text)) == 3) & p.contains("total") & contains_any(p, ("summary", "vat", "tax", "subtotal"))


# --- settling a field from what was read around it ------------------------------------------------------------------

# Words that no party's name holds, and the suffixes of firms where a name is settled.
NAME_STOPS = ("date", "invoice", "tax", "iban", "id", "qty", "description", "total", "subtotal", "amount", "due")
NAME_SUFFIXES = ("ltd", "limited", "llc", "inc", "corp", "company", "plc", "corporation")


def distinct_candidates(candidates: Column) -> Column:
    """Texts without those that equal an earlier one but for white space."""
    bare = lambda v: F.regexp_replace(v, r"\s+", "")
    return F.filter(candidates, lambda v, i: F.array_position(F.transform(candidates, bare), bare(v)) == i + 1)


def settled_date(current: Column, candidates: Column, day) -> Column:
    """A date's text: the current one where it is a date, else the only candidate that is one; ``day`` reads a text as a date.

    A current text that came with its label gives way to an only candidate that differs.
    """

    def of(x: Column) -> Column:
        only = F.get(x["v"], F.lit(0))
        sure = F.coalesce(day(x["c"]).isNotNull() & (x["c"] != ""), F.lit(False))
        labelled = (x["c"] != "") & (x["c"] != squeezed(F.coalesce(current, F.lit(""))))
        one = F.size(x["v"]) == 1
        kept = F.coalesce(F.nullif(x["c"], F.lit("")), current)
        return F.when(sure & one & (only != x["c"]) & labelled, only).when(sure & (F.size(x["v"]) > 0), kept).when(one, only).otherwise(kept)

    valid = F.filter(F.transform(F.coalesce(candidates, F.array().cast("array<string>")), date_text), lambda v: day(v).isNotNull())
    return let(F.struct(date_text(current).alias("c"), valid.alias("v")), of)


def settled_amount(current: Column, candidates: Column) -> Column:
    """The only different candidate, else the current text."""
    return let(distinct_candidates(F.coalesce(candidates, F.array().cast("array<string>"))), lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))).otherwise(current))


def invoice_number_score(candidate: Column, current: Column) -> Column:
    """How well a text reads as an invoice number, and how near its figures are to the current one's."""
    t = F.trim(candidate)
    only, now = F.regexp_replace(t, r"\D", ""), F.regexp_replace(F.coalesce(current, F.lit("")), r"\D", "")
    digits, letters, small = F.length(only), F.length(F.regexp_replace(t, r"[^\p{L}]", "")), F.length(F.regexp_replace(t, r"[^\p{Ll}]", ""))
    year = (digits == 4) & only.cast("string").between("1900", "2100")
    shared = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(only), F.length(now))), lambda k: F.substring(only, F.lit(1), k) == F.substring(now, F.lit(1), k))), F.lit(0))
    return _sum_of([
        F.least(digits, F.lit(8)) * 2.0 - letters * 0.5 - small * 1.5 + F.length(F.regexp_replace(t, "[^-/.]", "")) * 0.25, F.when((F.length(t) <= 4) & (digits < 4), -3.0), F.when((F.length(t) <= 6) & (letters > 0), -2.5),
        F.when((F.length(t) <= 6) & (digits < F.greatest(letters, F.lit(1))), -4.0), F.when(digits >= F.greatest(letters, F.lit(1)), 2.0), F.when((digits >= 6) & (letters == 0), 2.0).when((digits >= 3) & (letters == 0), 1.0),
        F.when((letters > 0) & (F.upper(t) == t), 1.0), F.when(year, -8.0), F.when((F.length(now) > 0) & (digits > 0), shared * 0.75 - F.abs(digits - F.length(now)) * 0.5),
    ])


def suspicious_party(value: Column) -> Column:
    """Whether a text can hardly be a party's name: empty, a country, one word that is no firm, many words or figures, an address for mail."""
    t = F.trim(F.coalesce(value, F.lit("")))
    ws = words(t)
    bare = F.transform(ws, lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
    country = F.regexp_replace(F.lower(t), "[^a-z0-9]", "").isin("canada", "mexico", "usa", "unitedstates")
    return (t == "") | country | ((F.size(ws) == 1) & ~_any_word(bare, NAME_SUFFIXES)) | (F.size(ws) > 8) | (_digits(t) >= 5) | t.contains("@")


def party_candidate_score(field: Column, text: Column) -> Column:
    """How well a phrase beside a party's label reads as its name."""

    def of(t: Column) -> Column:
        ws = words(t)
        n, letters, digits = F.size(ws), F.length(F.regexp_replace(t, r"[^\p{L}]", "")), _digits(t)
        bare = F.transform(ws, lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
        customer = field == "customerName"
        country = F.regexp_replace(F.lower(t), "[^a-z0-9]", "").isin("canada", "mexico", "usa", "unitedstates")
        score = _sum_of([
            F.when(letters >= 4, 1.0), F.when(digits > 0, -F.least(F.lit(1.2), digits * 0.2)), F.when(n <= 5, 0.8).when(n <= 8, 0.3).otherwise(-1.0), F.when(_any_word(bare, NAME_SUFFIXES), 0.8), F.when(customer & (n <= 3), 0.3),
            F.when(customer & n.between(3, 5), 0.6), F.when(customer & (n >= 4), 0.4), F.when(_any_word(bare, NAME_STOPS), -1.2), F.when((F.upper(t) == t) & (letters >= 4), 0.2),
        ])
        return F.when((t == "") | country, -1.0).otherwise(score)

    return let(squeezed(stripped(F.coalesce(text, F.lit("")))), of)


# --- pages as a whole -----------------------------------------------------------------------------------------------


def candidate_reach(field: Column) -> Column:
    """The least score of a fallback value."""
    low = F.lower(field)
    return F.when(low.contains("date") | low.contains("invoice"), 0.45).when(is_sum(field), 0.6).otherwise(0.25)
