"""Sellers and customers on a page: rows to blocks, blocks to roles, and the name that a block or a label gives.

Rows are those of ``rows.token_rows``. A page's blocks are found by one fold over its rows, all in the JVM; what follows is relational.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import classify as cl
from ledgerloom.functions.labels import FIELD_SPECS, label_score
from ledgerloom.functions.text import first_matching, let, ocr_text
from ledgerloom.page.fields import phrases
from ledgerloom.page.rows import row_texts
from ledgerloom.sources.scratch import written

PAGE = ["doc_id", "page_no"]
ROLES = ("vendor_block", "bill_to_block", "ship_to_block", "remit_to_block", "summary_block")
FIELD_OF = {"vendor_block": "sellerName", "remit_to_block": "sellerName", "bill_to_block": "customerName", "ship_to_block": "customerName"}
MIN_ROLE, MIN_NAME, MIN_LABEL = 0.35, 0.12, 0.8


def row_blocks(texts: DataFrame) -> DataFrame:
    """``rows.row_texts`` with its class, block_no and place in the block.

    A block ends where the gap to the next row is more than 28 or a twenty-fifth of the page, or where another kind of
    content begins: metadata, tables and sums end at once, a party's rows before sums or a table after two, before metadata
    after three, any other change in a block of four rows or of 18 % of the page.
    """
    c = F.col
    kept = cl.named(texts.where(F.trim("text") != "")).withColumn("row_class", cl.row_block_class(c("__t"), c("__p"), c("__seller"), c("__buyer")))
    kept = kept.select(*texts.columns, "row_class", c("__seller").alias("seller_score"), c("__buyer").alias("buyer_score"))
    page = kept.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("row_no", "y", "h", "row_class"))).alias("rows"), F.first("page_h").alias("page_h"))

    def ends(s, r):
        a, b = s["cls"], r["row_class"]
        tall = (s["k"] >= 4) | (s["bottom"] - s["top"] >= c("page_h") * 0.18)
        change = first_matching(
            [
                ((a == "party") & (b == "metadata"), s["k"] >= 3),
                ((a == "party") & b.isin("table", "summary"), s["k"] >= 2),
                ((a == "metadata") & b.isin("party", "table", "summary"), True),
                ((a == "table") & b.isin("party", "summary"), True),
                ((a == "summary") & b.isin("party", "table"), True),
            ],
            tall,
        )
        return (s["k"] == 0) | (r["y"] - s["bottom"] > F.greatest(F.lit(28), F.floor(c("page_h") * 0.04))) | ((a != "other") & (b != "other") & (a != b) & change)

    def step(s, r):
        def of(new):
            cls = F.when(r["row_class"] != "other", r["row_class"]).when(new, "other").otherwise(s["cls"])
            no = F.when(new, s["no"] + 1).otherwise(s["no"])
            k = F.when(new, 0).otherwise(s["k"])
            top, bottom = F.when(new, r["y"]).otherwise(F.least(s["top"], r["y"])), F.when(new, r["y"] + r["h"]).otherwise(F.greatest(s["bottom"], r["y"] + r["h"]))
            return F.struct(no.alias("no"), (k + 1).alias("k"), cls.alias("cls"), top.alias("top"), bottom.alias("bottom"), F.array_append(s["out"], F.struct(r["row_no"].alias("row_no"), no.alias("block_no"), k.alias("block_row"))).alias("out"))

        return let(ends(s, r), of)

    kind = "struct<no:int,k:int,cls:string,top:bigint,bottom:bigint,out:array<struct<row_no:int,block_no:int,block_row:int>>>"
    start = F.from_json(F.lit('{"no":-1,"k":0,"cls":"other","top":0,"bottom":0,"out":[]}'), kind)
    found = page.select(*PAGE, F.explode(F.aggregate("rows", start, step)["out"]).alias("b")).select(*PAGE, "b.*")
    return kept.join(found, [*PAGE, "row_no"])


def block_roles(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, block_no, role, score, x, y, w, h, rows): the role that a block most likely plays."""
    c = F.col
    b = blocks.withColumns({
        "p": ocr_text(c("text")), "vendor": F.when(c("block_row") < 2, c("seller_score")), "bill": F.when(c("block_row") < 2, c("buyer_score")),
        "numbered": F.exists(F.slice(F.split(F.trim("text"), r"\s+"), 1, 2), lambda w: w.rlike(r"^\d{1,3}$")), "amounts": F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(cl.AMOUNT_TOKEN), F.lit(0)))),
    })
    head = c("block_row") < 2
    firm = F.arrays_overlap(F.split("p", " "), F.array(*map(F.lit, cl.BUSINESS_SUFFIXES)))
    per = b.groupBy(*PAGE, "block_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda r: r["text"]), " ").alias("text"),
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(c("x") + c("w")) - F.min("x")).alias("w"), (F.max(c("y") + c("h")) - F.min("y")).alias("h"), F.first("page_w").alias("pw"), F.first("page_h").alias("ph"),
        F.count(F.lit(1)).alias("rows"), *[F.count_if(c("row_class") == k).alias(f"n_{k}") for k in ("party", "table", "summary", "metadata")], F.count_if("numbered").alias("n_numbered"), F.sum("amounts").alias("n_amounts"),
        F.coalesce(F.max("vendor") >= 0.25, F.lit(False)).alias("vendorish"), F.coalesce(F.max("bill") >= 0.2, F.lit(False)).alias("billish"), F.bool_or(head & firm).alias("firm"), F.bool_or(cl.banner(c("p"))).alias("banner"),
        F.bool_or((c("block_row") == 0) & cl.contactish(c("text"), c("p"))).alias("contact"),
    ).withColumn("p", ocr_text(c("text")))
    x, y = c("x") / F.greatest("pw", F.lit(1)), c("y") / F.greatest("ph", F.lit(1))
    kinds = sum((c(f"n_{k}") > 0).cast("int") for k in ("party", "table", "summary", "metadata"))
    both = lambda a, d: (c(f"n_{a}") > 0) & (c(f"n_{d}") > 0)
    sums = [w for k in ("subtotal", "tax", "amount_due", "invoice_total", "balance_due") for w in cl.SUMMARY_CUES[k]]
    # What speaks for a role or against it (condition, vendor, bill to, ship to, remit to, summary).
    terms = [
        (cl.contains_any(c("p"), sums), 0, 0, 0, 0, 1.2),
        (cl.summary_cues(c("p")) & ~cl.mixed(c("text"), c("p")), 0, 0, 0, 0, 0.5),
        *[(cl.contains_any(c("p"), cl.PARTY_LABELS[r]), *[1.1 if r == s else 0 for s in ROLES]) for r in ROLES[:4]],
        (y < 0.25, 0.45, 0, 0, 0, 0),
        ((x < 0.55) & (y < 0.35), 0.25, 0, 0, 0, 0),
        ((y < 0.25) & c("firm"), 0.6, 0, 0, 0, 0),
        (y > 0.75, 0, 0.5, 0.2, 0, 0),
        ((x < 0.75) & y.between(0.1, 0.8), 0, 0.15, 0, 0, 0),
        ((x > 0.5) & (y > 0.45), 0, 0, 0, 0, 0.35),
        (c("vendorish"), 0.3, 0, 0, 0, 0),
        (c("billish"), 0, 0.25, 0, 0, 0),
        ((c("n_amounts") >= 2) & y.between(0.25, 0.8), -0.9, -0.7, 0, 0, 0),
        (c("n_numbered") >= 2, -0.75, -0.6, 0, 0, 0),
        (both("party", "table"), -0.95, -0.85, 0, 0, -0.45),
        (both("summary", "table"), -0.85, -0.75, 0, 0, -0.55),
        (both("summary", "party"), -0.65, -0.65, 0, 0, -0.35),
        ((c("n_metadata") >= 2) & (c("n_table") > 0), -0.45, -0.35, 0, 0, 0),
        ((kinds >= 3) & (c("rows") >= 5), -0.65, -0.55, 0, 0, -0.4),
        ((c("h") / F.greatest("ph", F.lit(1)) > 0.32) & (kinds >= 2), -0.35, -0.25, 0, 0, -0.25),
        (c("banner"), -0.6, -0.6, 0, 0, 0),
        (c("contact"), -0.15, -0.15, 0, 0, 0),
        ((c("w") / F.greatest("pw", F.lit(1)) > 0.7) & (y > 0.85), 0, 0.3, 0, 0, 0),
    ]
    per = per.withColumn("held", F.array(*[F.coalesce(t[0], F.lit(False)) for t in terms]))
    score = lambda k: sum((F.when(F.get("held", F.lit(i)), float(t[k + 1])).otherwise(0.0) for i, t in enumerate(terms) if t[k + 1]), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct(F.round(score(k), 6).alias("score"), F.lit(-k).alias("o"), F.lit(r).alias("role")) for k, r in enumerate(ROLES)]))
    return per.withColumn("b", best).select(*PAGE, "block_no", "b.role", "b.score", "x", "y", "w", "h", "rows")


def row_segments(rows: DataFrame) -> DataFrame:
    """(doc_id, page_no, row_no, segment_no, text, x, y, right, bar): a row's tokens parted where the gap is 54 or 2.6 median widths at least."""
    c = F.col
    row = Window.partitionBy(*PAGE, "row_no")
    inorder = row.orderBy("x", "place")
    r = rows.withColumns({"width": F.greatest(F.lit(54.0), F.median(F.greatest("w", F.lit(1))).over(row) * 2.6), "gap": c("x") - F.lag(c("x") + c("w")).over(inorder)})
    r = r.withColumn("segment_no", F.sum(F.coalesce((c("gap") >= c("width")).cast("int"), F.lit(0))).over(inorder))
    words = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("x", "place", "text"))), lambda t: F.trim(t["text"])), lambda w: w != "")
    return r.groupBy(*PAGE, "row_no", "segment_no").agg(F.array_join(words, " ").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(c("x") + c("w")).alias("right"), F.bool_or(F.trim("text") == "|").alias("bar"))


def segment_score(role: str, width):
    """(score, name) of a segment with the columns of ``classify.named``: how well it names the party of a role, by its words and its place in a width; -1 where it gives no name."""
    c = F.col
    short = role in cl.CUSTOMER_ROLES
    name, plain, own = (c("__short"), c("__sp"), c("__ss")) if short else (c("__long"), c("__lp"), c("__ls"))
    wide = F.greatest(width, F.lit(1))
    left, ws = c("x") / wide, F.split(plain, " ")
    if not short:
        place = F.greatest(F.lit(0.0), 0.16 - left * 0.22)
    else:
        alone = (F.size(ws) == 1) & plain.isin(*cl.BUSINESS_SUFFIXES)
        place = F.greatest(F.lit(0.0), (c("right") / wide - 0.42) * 0.28) + F.when(left < 0.2, -0.08).otherwise(0.0) + F.when(alone, -1.0).otherwise(0.0) + F.when(c("bar") & (F.size(ws) <= 3), 0.45).otherwise(0.0)
    score = cl.role_score(c("__t"), c("__p"), name, plain, own, role)
    return F.struct(F.when(name == "", -1.0).otherwise(score + place).alias("score"), name.alias("name"))


def vendor_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, page_no, row_no, tokens): a row's tokens from left to right, for ``vendor_name``."""
    return rows.groupBy(*PAGE, "row_no").agg(F.array_sort(F.collect_list(F.struct("x", "place", F.trim("text").alias("text")))).alias("tokens"))


def vendor_name(tokens, width):
    """The firm that a row begins with: the words before a figure, a label or the right side; null if they are no firm's."""
    real = F.filter(tokens, lambda t: t["text"] != "")
    ends = lambda t: (t["x"] > width * 0.55) | ocr_text(t["text"]).isin("invoice", "date", "due") | t["text"].rlike(r"[#\d]") | cl.noise(ocr_text(t["text"]))
    first = F.array_position(F.transform(real, ends), True).cast("int")
    name = F.array_join(F.transform(F.slice(real, F.lit(1), F.when(first > 0, first - 1).otherwise(F.size(real))), lambda t: t["text"]), " ")
    whole = F.array_join(F.transform(real, lambda t: t["text"]), " ")
    plain = F.split(ocr_text(name), " ")
    return F.when((F.size(plain) >= 2) & F.arrays_overlap(plain, F.array(*map(F.lit, cl.BUSINESS_SUFFIXES))) & ~cl.mixed(whole, ocr_text(whole)), name)


def block_names(rows: DataFrame, blocks: DataFrame, roles: DataFrame) -> DataFrame:
    """(doc_id, page_no, field, value, score): the party of each block whose role is sure enough."""
    c = F.col
    named = roles.where((c("role") != "summary_block") & (c("score") >= MIN_ROLE)).select(*PAGE, "block_no", "role", c("score").alias("role_score"), (c("x") + c("w")).alias("width"))
    own = blocks.where("block_row < 4").select(*PAGE, "row_no", "block_no", "block_row").join(named, [*PAGE, "block_no"])
    segments = own.join(row_segments(rows), [*PAGE, "row_no"])
    scored = first_matching([(c("role") == r, segment_score(r, c("width"))) for r in ROLES[:3]], segment_score("remit_to_block", c("width")))
    best = cl.named(segments).withColumn("s", scored).groupBy(*PAGE, "block_no").agg(F.max_by("s", F.struct("s.score", -c("block_row"), -c("segment_no"))).alias("s"))
    first = own.where("role = 'vendor_block' AND block_row < 2").join(vendor_rows(rows), [*PAGE, "row_no"]).withColumn("v", vendor_name(c("tokens"), c("width")))
    firm = first.where("v IS NOT NULL").groupBy(*PAGE, "block_no").agg(F.min_by("v", "block_row").alias("firm"))
    j = named.join(best, [*PAGE, "block_no"], "left").join(firm, [*PAGE, "block_no"], "left")
    value = F.coalesce("firm", F.when(c("s.score") >= MIN_NAME, c("s.name")))
    field = first_matching([(c("role") == r, f) for r, f in FIELD_OF.items()])
    return j.select(*PAGE, field.alias("field"), value.alias("value"), c("role_score").alias("score")).where("value IS NOT NULL AND value != ''")


def labelled_names(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, field, value, score): the party below a label among the first four rows of its block.

    Below means: no lower than six heights of the label or 18 % of the page, not far to its right, up to the first row that is a
    label, an account or a sum; and on the label's side of the other party's label, where both stand in one row.
    """
    c = F.col
    named = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(a).alias("alias")) for f in ("sellerName", "customerName") for a in FIELD_SPECS[f][3]])
    p = phrases(rows, 3).join(blocks.where("block_row < 4").select(*PAGE, "row_no", "block_no"), [*PAGE, "row_no"])
    near = p.withColumn("spec", F.explode(named)).select(*p.columns, "spec.*").where(F.levenshtein(ocr_text(c("phrase")), ocr_text(c("alias"))) <= F.greatest(F.length("alias"), F.length("phrase")) / 2)
    score = label_score(c("phrase"), c("alias"), c("field"), c("x") / c("page_w"), c("y") / c("page_h"))
    hit = near.withColumn("label_score", score).where(c("label_score") >= MIN_LABEL)
    order = F.struct("label_score", F.when(c("field") == "sellerName", 1).otherwise(0), -c("row_no"), -c("place"), -c("n"))
    label = F.struct("row_no", "x", "y", "w", "h", "page_w", "page_h", "label_score")
    found = hit.groupBy(*PAGE, "block_no", "field").agg(F.max_by(label, order).alias("l")).select(*PAGE, "block_no", "field", "l.*")
    in_row = hit.groupBy(*PAGE, "row_no", c("field").alias("other")).agg(F.max_by(c("x") + c("w") / 2, order).alias("other_at"))
    found = found.join(in_row, [*PAGE, "row_no"], "left")
    margin, at = F.greatest(c("page_w") * 0.02, F.lit(18.0)), c("x") + c("w") / 2
    left = F.max(F.when((c("other") != c("field")) & (c("other_at") < at), (c("other_at") + at) / 2 - margin)).alias("from")
    right = F.min(F.when((c("other") != c("field")) & (c("other_at") > at), (c("other_at") + at) / 2 + margin)).alias("to")
    labels = found.groupBy(*PAGE, "block_no", "field", F.col("row_no").alias("label_row"), c("x").alias("lx"), c("y").alias("ly"), c("w").alias("lw"), c("h").alias("lh"), "page_w", "page_h", "label_score").agg(left, right)

    tokens = rows.join(blocks.select(*PAGE, "row_no", "block_no"), [*PAGE, "row_no"]).drop("page_w", "page_h")
    middle = c("x") + c("w") / 2
    beside = labels.join(tokens, [*PAGE, "block_no"]).where((middle >= F.coalesce("from", F.lit(0.0))) & (middle <= F.coalesce("to", c("page_w"))))
    key = [*PAGE, "block_no", "field", "label_row", "lx", "ly", "lw", "lh", "page_w", "page_h", "label_score"]
    words = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("x", "place", "text"))), lambda t: F.trim(t["text"])), lambda w: w != "")
    line = beside.groupBy(*key, "row_no").agg(F.array_join(words, " ").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(c("x") + c("w")).alias("right"), F.max(c("y") + c("h")).alias("bottom"), F.bool_or(F.trim("text") == "|").alias("bar"))
    low = c("ly") + c("lh")
    plain = ocr_text(c("text"))
    stop = plain.isin(*cl.ADDRESS_STOPS) | cl.contains_any(plain, cl.ACCOUNT_MARKERS) | (cl.summary_cues(plain) & ~cl.mixed(c("text"), plain))
    below = line.where(c("bottom") > low).where(c("y") <= low + F.greatest(c("lh") * 6.0, c("page_h") * 0.18)).where(c("x") <= c("lx") + F.greatest(c("lw") * 1.75, c("page_w") * 0.2))
    w = Window.partitionBy(*key).orderBy("row_no")
    clear = below.withColumn("stops", F.sum(stop.cast("int")).over(w)).where("stops = 0").withColumn("k", F.row_number().over(w)).where("k <= 4")
    top = F.when((c("field") == "sellerName") & (c("y") < c("page_h") * 0.2), 0.1).otherwise(0.0)
    seller, buyer = segment_score("vendor_block", c("page_w")), segment_score("bill_to_block", c("page_w"))
    scored = cl.named(clear).withColumn("s", F.when(c("field") == "sellerName", seller).otherwise(buyer)).withColumn("name_score", c("s.score") + top)
    first = (c("k") == 1) & (c("name_score") >= 0.25)
    best = scored.groupBy(*key).agg(F.max_by(F.struct("s.name", "name_score"), F.struct(first.cast("int"), "name_score", -c("k"))).alias("b"))
    return best.where((c("b.name_score") >= 0.1) & (c("b.name") != "")).select(*PAGE, "field", c("b.name").alias("value"), (c("label_score") + 5.0).alias("score"))


def fallback_names(texts: DataFrame) -> DataFrame:
    """(doc_id, page_no, field, value, score): a seller among the rows at the top left, a customer among those at the lower left."""
    c = F.col
    x, y = c("x") / F.greatest("page_w", F.lit(1)), c("y") / F.greatest("page_h", F.lit(1))
    t = cl.named(texts)
    high = c("__rs") + F.greatest(F.lit(0.0), 0.12 - y * 0.3) + F.when(x < 0.35, 0.05).otherwise(0.0)
    few = F.when(F.size(F.split("__sp", " ")) <= 3, 0.18).otherwise(0.0) + F.when(c("text").contains("|"), 0.12).otherwise(0.0)
    low = c("__ss") + few + F.greatest(F.lit(0.0), 0.16 - y * 0.18)
    both = F.array(
        F.struct(F.lit("sellerName").alias("field"), c("__long").alias("value"), F.when((y <= 0.22) & (x <= 0.55), high).alias("score"), F.lit(0.28).alias("floor")),
        F.struct(F.lit("customerName").alias("field"), c("__short").alias("value"), F.when((y >= 0.58) & (x <= 0.6), low).alias("score"), F.lit(0.3).alias("floor")),
    )
    each = t.select(*PAGE, "row_no", F.explode(both).alias("f")).select(*PAGE, "row_no", "f.*").where("score >= floor AND value != ''")
    best = each.groupBy(*PAGE, "field").agg(F.max_by(F.struct("value", "score"), F.struct("score", -c("row_no"))).alias("b"))
    return best.select(*PAGE, "field", "b.value", "b.score")


def parties(rows: DataFrame) -> DataFrame:
    """(doc_id, page_no, field, value, source): the seller and the customer of each page, by label, else by block, else by place; names that ran into one another are parted."""
    rows = written(rows, "rows")
    texts = written(row_texts(rows), "row-texts")
    blocks = written(row_blocks(texts), "blocks")
    found = labelled_names(rows, blocks).withColumn("source", F.lit("label"))
    found = found.unionByName(block_names(rows, blocks, written(block_roles(blocks), "roles")).withColumn("source", F.lit("block")))
    found = found.unionByName(fallback_names(texts).withColumn("source", F.lit("place")))
    rank = first_matching([(F.col("source") == "label", 2), (F.col("source") == "block", 1)], 0)
    best = written(found.groupBy(*PAGE, "field").agg(F.max_by(F.struct("value", "source"), F.struct(rank, "score", "value")).alias("b")), "names")
    pair = best.groupBy(*PAGE).agg(*[F.max(F.when(F.col("field") == f, F.col("b"))).alias(f) for f in ("sellerName", "customerName")])
    names = F.array(
        F.struct(F.lit("sellerName").alias("field"), cl.without_overlap(F.col("sellerName.value"), F.col("customerName.value")).alias("value"), F.col("sellerName.source").alias("source")),
        F.struct(F.lit("customerName").alias("field"), cl.without_overlap(F.col("customerName.value"), F.col("sellerName.value"), True).alias("value"), F.col("customerName.source").alias("source")),
    )
    return pair.select(*PAGE, F.explode(names).alias("n")).select(*PAGE, "n.*").where("value IS NOT NULL")
