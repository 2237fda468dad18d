"""Matching documents to known layouts: near hashes, fuzzy labels in place, families, and pairs of families to merge."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import rules
from ledgerloom.functions.sets import hamming, jaccard
from ledgerloom.functions.text import anchor, similarity

HAMMING = 12.5
LABEL_SHARE = 0.70
LABEL_REACH = 0.05
LABEL_EDITS = 2
FAMILY_FLOOR = 0.55
APART = 0.53
MERGE_FLOOR = 0.84
MAX_ALIASES = 10_000
"""Aliases of a catalogue that goes to every task."""
PAGE_WEIGHTS = {"header_page": 1.25, "summary_page": 1.25, "line_item_page": 0.55}


def near_fingerprints(pages: DataFrame, known: DataFrame, threshold: float = HAMMING) -> DataFrame:
    """(doc_id, fingerprint_hash, total_distance): layouts all of whose pages are near the document's, page by page.

    ``pages``: doc_id, page_no, page_count, visual_hash. ``known``: fingerprint_hash, page_no, page_count, visual_hash.
    Pages meet by number and count of pages. Known layouts are a catalogue; Spark broadcasts it where its size allows.
    """
    met = pages.join(known.withColumnRenamed("visual_hash", "__h"), ["page_no", "page_count"])
    d = hamming(F.col("visual_hash"), F.col("__h"))
    per = met.groupBy("doc_id", "fingerprint_hash", "page_count").agg(F.sum(d).alias("total_distance"), F.max(d).alias("__worst"), F.count(F.lit(1)).alias("__n"))
    return per.where((F.col("__worst") <= threshold) & (F.col("__n") == F.col("page_count"))).select("doc_id", "fingerprint_hash", "total_distance")


def confirmed_labels(labels: DataFrame, tokens: DataFrame, reach: float = LABEL_REACH, edits: int = LABEL_EDITS) -> DataFrame:
    """(doc_id, fingerprint_hash, labels, matched): labels that some token near their place spells, all but for a few letters.

    ``labels``: doc_id, fingerprint_hash, page_no, label_no, label_text, cx, cy. ``tokens``: doc_id, page_no, text, cx, cy.
    Places are cut into cells as wide as the reach; a label meets the tokens of the nine cells around it. Labels
    without a text or place count as unmatched.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("int")
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = labels.withColumn("__o", F.explode(around)).withColumns({"__x": cell("cx") + F.col("__o.a"), "__y": cell("cy") + F.col("__o.b")})
    t = tokens.select("doc_id", "page_no", F.col("text").alias("__t"), F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), cell("cx").alias("__x"), cell("cy").alias("__y"))
    close = (F.abs(F.col("cx") - F.col("__cx")) <= reach) & (F.abs(F.col("cy") - F.col("__cy")) <= reach) & (F.levenshtein(F.lower("label_text"), F.lower("__t")) <= edits)
    key = ["doc_id", "fingerprint_hash", "page_no", "label_no"]
    found = spread.join(t, ["doc_id", "page_no", "__x", "__y"]).where(close).select(*key).distinct().withColumn("__hit", F.lit(1))
    return labels.join(found, key, "left").groupBy("doc_id", "fingerprint_hash").agg(F.count(F.lit(1)).alias("labels"), F.count("__hit").alias("matched"))


def fuzzy_pairs(names: DataFrame, name: str = "name", edits: int = 3) -> DataFrame:
    """(label, token, edits, similarity) of all pairs of different texts (label the lesser) that are within so many edits.

    A text is cut into edits + 1 segments. Of two texts within the distance, one segment of the shorter is whole in the longer, moved
    by ``edits`` places at most; so texts meet by their length, a segment's number and the segment, and only those are compared.
    Texts no longer than ``edits`` meet by length alone.
    """
    n = names.select(F.col(name).alias("v")).where("v IS NOT NULL").distinct().withColumn("size", F.length("v"))
    parts = edits + 1

    def cut(size: Column) -> list[tuple[Column, Column]]:
        """(first place, length) of each segment of a text of this size."""
        low, more = F.floor(size / parts).cast("int"), (size % parts).cast("int")
        # The last segments are one longer.
        return [(F.lit(1) + low * k + F.greatest(F.lit(0), F.lit(k) - (F.lit(parts) - more)), low + F.when(F.lit(k) >= F.lit(parts) - more, 1).otherwise(0)) for k in range(parts)]

    short = F.array(*[F.struct(F.lit(k).alias("k"), F.substring("v", at, size).alias("s")) for k, (at, size) in enumerate(cut(F.col("size")))])
    held = n.select("v", "size", F.explode(F.when(F.col("size") <= edits, F.array(F.struct(F.lit(-1).alias("k"), F.lit("").alias("s")))).otherwise(short)).alias("x")).select(F.col("v").alias("a"), "size", "x.*")
    sizes = F.explode(F.sequence(F.greatest(F.lit(0), F.col("size") - edits), F.col("size"))).alias("other")
    probing = n.select("v", "size", sizes)
    moved = [F.transform(F.sequence(F.greatest(F.lit(1), at - edits), F.least(F.col("size") - size + 1, at + edits)), _windows(k, size)) for k, (at, size) in enumerate(cut(F.col("other")))]
    asked = probing.select(F.col("v").alias("b"), F.col("other").alias("size"), F.explode(F.when(F.col("other") <= edits, F.array(F.struct(F.lit(-1).alias("k"), F.lit("").alias("s")))).otherwise(F.array_distinct(F.flatten(F.array(*moved))))).alias("x")).select("b", "size", "x.*")
    met = held.join(asked, ["size", "k", "s"]).where("a != b").select(F.least("a", "b").alias("label"), F.greatest("a", "b").alias("token")).distinct()
    d = F.levenshtein("label", "token", edits)
    return met.withColumn("edits", d).where("edits >= 0").select("label", "token", "edits", F.round(similarity(F.col("label"), F.col("token")), 6).alias("similarity"))


def _windows(k: int, size: Column) -> Callable[[Column], Column]:
    return lambda at: F.struct(F.lit(k).alias("k"), F.substring(F.col("v"), at, size).alias("s"))


def best_fingerprint(candidates: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The nearest candidate of each document whose labels are confirmed; without labels only an equal one. Ties go to the smaller hash."""
    j = candidates.join(confirmed, ["doc_id", "fingerprint_hash"], "left").na.fill(0, ["labels", "matched"])
    sure = F.when(F.col("labels") == 0, F.col("total_distance") == 0).otherwise(F.col("matched") / F.col("labels") >= LABEL_SHARE)
    best = j.where(sure).groupBy("doc_id").agg(F.min(F.struct("total_distance", "fingerprint_hash")).alias("b"))
    return best.select("doc_id", "b.fingerprint_hash", "b.total_distance")


def page_regions(signature: Column) -> Column:
    """A page signature's token sets: header, identity, summary, footer, and all of them."""
    clean = lambda a: F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    hits = lambda k: F.try_element_at(signature["keyword_hits"], F.lit(k))
    union = lambda *xs: reduce(F.array_union, xs)
    header, summary = clean(signature["header_tokens"]), union(clean(signature["summary_labels"]), clean(hits("summary")))
    footer = union(clean(signature["footer_tokens"]), clean(hits("footer")))
    identity = union(*[clean(hits(k)) for k in ("invoice_number", "invoice_date", "provider", "customer")])
    rest = clean(F.flatten(F.map_values(F.coalesce(signature["keyword_hits"], F.create_map().cast("map<string,array<string>>")))))
    return F.struct(header.alias("header"), identity.alias("identity"), summary.alias("summary"), footer.alias("footer"), union(header, summary, footer, identity, rest).alias("generic"))


def page_similarity(a: Column, b: Column, role_a: Column, role_b: Column) -> Column:
    """Similarity of two pages' regions, a little more if they play the same role, 1 at most."""
    return F.least(F.lit(1.0), rules.region_similarity(a, b) + F.when(role_a == role_b, 0.08).otherwise(0.0))


def page_alignment(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, alignment): how well the pages of two layouts fit, weighted by role, both ways.

    Either side: id, page_no, role, regions, and a candidate pair's ``pair`` key to meet by.
    """
    weight = lambda r: rules.first_matching([(r == k, w) for k, w in PAGE_WEIGHTS.items()], 1.0)
    l = left.select("pair", F.col("id").alias("left_id"), F.col("page_no").alias("lp"), F.col("role").alias("lr"), F.col("regions").alias("lx"))  # noqa: E741
    r = right.select("pair", F.col("id").alias("right_id"), F.col("page_no").alias("rp"), F.col("role").alias("rr"), F.col("regions").alias("rx"))
    met = l.join(r, "pair").withColumn("s", page_similarity(F.col("lx"), F.col("rx"), F.col("lr"), F.col("rr")))

    def one_way(page: str, role: str, out: str) -> DataFrame:
        best = met.groupBy("pair", "left_id", "right_id", page).agg(F.max("s").alias("s"), F.first(weight(F.col(role))).alias("w"))
        return best.groupBy("pair", "left_id", "right_id").agg((F.sum(F.col("s") * F.col("w")) / F.sum("w")).alias(out))

    both = one_way("lp", "lr", "there").join(one_way("rp", "rr", "back"), ["pair", "left_id", "right_id"])
    return both.select("left_id", "right_id", ((F.col("there") + F.col("back")) / 2).alias("alignment"))


def family_matches(documents: DataFrame, families: DataFrame, tolerance: int = 1, floor: float = FAMILY_FLOOR) -> DataFrame:
    """The best family of each document, with its score and how many qualified.

    ``documents``: doc_id, regions, roles, tokens, page_count, provider_name, alignment (a map family -> alignment, or null).
    ``families``: template_family_id, status, apply_count, reject_count, confidence, regions, roles, tokens, page_count, provider_name, split_pressure.
    A family is met only by a document that shares a token with it in a region. Without one the regions add nothing, and alignment,
    roles, tokens and provider add 0.53 at most, which health does not raise: a floor must be above that.
    Scores are compared at nine digits, so that the order of additions decides nothing; of equal ones the first family in order is best.
    """
    if floor <= APART:
        raise ValueError(f"a floor of {APART} or less needs every family for every document")
    marked = lambda k: lambda t: F.concat(F.lit(f"{k}:"), t)
    in_region = lambda r: F.array_distinct(F.flatten(F.array(*[F.transform(F.coalesce(r[k], F.array().cast("array<string>")), marked(k)) for k in rules.REGION_WEIGHTS])))
    d = documents.select("doc_id", F.struct("regions", "roles", "tokens", "page_count", "provider_name", "alignment").alias("d"))
    f = families.where("status != 'retired'").select("template_family_id", F.struct("status", "apply_count", "reject_count", "confidence", "regions", "roles", "tokens", "page_count", "provider_name", "split_pressure").alias("f"))
    keyed = d.select("doc_id", F.explode(in_region(F.col("d.regions"))).alias("k"))
    fk = f.select("template_family_id", F.explode(in_region(F.col("f.regions"))).alias("k"))
    pairs = keyed.join(fk, "k").select("doc_id", "template_family_id").distinct()
    j = pairs.join(f, "template_family_id").join(d, "doc_id")
    c = F.col
    deltas = rules.role_deltas(c("f.roles"), c("d.roles"))
    roles = jaccard(F.array_distinct("f.roles"), F.array_distinct("d.roles"))
    same = F.coalesce(F.lower("d.provider_name") == F.lower("f.provider_name"), F.lit(False))
    score = rules.family_score(
        rules.region_similarity(c("d.regions"), c("f.regions")), F.coalesce(F.try_element_at(c("d.alignment"), c("template_family_id")), F.lit(0.0)), roles, jaccard(c("f.tokens"), c("d.tokens")), same,
        c("x.strong"), c("x.variable"), F.coalesce(F.abs(c("f.page_count") - c("d.page_count")), F.lit(0)),
        rules.reuse_multiplier(c("f.status"), c("f.apply_count"), c("f.reject_count"), c("f.confidence")), F.coalesce("f.split_pressure", F.lit(0.0)),
    )
    scored = j.withColumn("x", deltas).where(c("x.strong") <= max(tolerance, 1)).withColumn("score", F.round(score, 9)).where(c("score") >= floor)
    best = scored.groupBy("doc_id").agg(F.min_by(F.struct("template_family_id", c("f.status").alias("family_status"), "score"), F.struct(-c("score"), "template_family_id")).alias("b"), F.count(F.lit(1)).alias("candidates"))
    return best.select("doc_id", "b.template_family_id", "b.family_status", F.round("b.score", 3).alias("family_score"), "candidates")


def routed(documents: DataFrame, matches: DataFrame, families: DataFrame, family_threshold: float = 0.75) -> DataFrame:
    """``documents`` (doc_id, strategy, truth_ready) with their match, family, route and strategy."""
    j = documents.join(matches.select("doc_id", "fingerprint_hash", "match_status"), "doc_id", "left").join(families.select("doc_id", "template_family_id", "family_status", "family_score"), "doc_id", "left")
    c = F.col
    r = rules.route(c("match_status"), c("family_status"), c("family_score"), family_threshold, c("strategy") == "native_pdf", c("truth_ready"))
    by_family = c("match_status").isNull() & (F.coalesce("family_score", F.lit(0.0)) >= family_threshold)
    return j.withColumns({"route": r, "strategy": rules.extraction_strategy(c("match_status").isNotNull(), by_family, c("strategy"))})


def similar_pairs(sets: DataFrame, threshold: float, key: str = "id", values: str = "tokens", block: list[str] | None = None) -> DataFrame:
    """(left_id, right_id, similarity) of all pairs whose token sets overlap by the threshold at least, each once.

    Prefix filtering: tokens are ordered from rare to frequent, and two sets that similar must share one among the first
    size - ceil(threshold * size) + 1 of either. Only such pairs meet, in buckets of rare tokens, and are verified.
    """
    block = block or []
    each = sets.select(key, *block, F.array_distinct(values).alias("v")).where(F.size("v") > 0)
    long = each.select(key, F.explode("v").alias("t"))
    ranked = long.join(long.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "t").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("o"))
    take = F.size("o") - F.ceil(F.size("o") * F.lit(threshold) - 1e-9).cast("int") + 1
    prefix = ranked.select(key, F.explode(F.transform(F.slice("o", F.lit(1), take), lambda x: x["t"])).alias("t"))
    side = lambda p: prefix.select("t", F.col(key).alias(p))
    met = side("left_id").join(side("right_id"), "t").where("left_id < right_id").select("left_id", "right_id").distinct()
    a, b = each.toDF("left_id", *[f"l_{x}" for x in block], "lv"), each.toDF("right_id", *[f"r_{x}" for x in block], "rv")
    j = met.join(a, "left_id").join(b, "right_id")
    for x in block:
        j = j.where(F.col(f"l_{x}").eqNullSafe(F.col(f"r_{x}")) | F.col(f"l_{x}").isNull() | F.col(f"r_{x}").isNull())
    s = jaccard(F.col("lv"), F.col("rv"))
    return j.withColumn("similarity", s).where(F.col("similarity") >= threshold).select("left_id", "right_id", "similarity")


BUCKETS, BLOCK = 1 << 23, 1 << 13
"""Buckets of words whose counts order the sets of ``similar_classes``, a byte each, and how many of them a row brings to the driver."""
MAX_SEEN = 1 << 20
"""Ids of sets to verify that go to every task; more of them are joined."""
CELL = 512
"""Sets of a cell in which pairs are verified, about."""


def _levels(hashes: DataFrame) -> np.ndarray:
    """For each bucket of the hashes in ``h`` about eight times the logarithm of its count; any order of words is right, rare words first is fast."""
    bucket = F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    counts = hashes.select(F.explode("h").alias("h")).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    level = (F.floor(F.log2("n") * 6) + 1).cast("int")

    def block(rows: pa.Table) -> pa.Table:
        at = rows.column("b").to_numpy()
        out = np.zeros(BLOCK, dtype=np.uint8)
        out[at % BLOCK] = rows.column("level").to_numpy().clip(max=255)
        return pa.table({"block": pa.array([int(at[0]) // BLOCK], pa.int32()), "levels": pa.array([out.tobytes()], pa.binary())})

    found = counts.select("b", level.alias("level")).groupBy(F.expr(f"b div {BLOCK}")).applyInArrow(block, "block int, levels binary").toArrow()
    levels = np.zeros(BUCKETS, dtype=np.uint8)
    for k, x in zip(found.column("block").to_pylist(), found.column("levels").to_pylist(), strict=True):
        levels[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(x, dtype=np.uint8)
    return levels


def _marks(held, threshold: float) -> Callable[[Column, Column], Column]:
    """Of an array of hashes and one of the same words' other hashes: a digest of both, the number, the first size - ceil(threshold * size) + 1 (the rarest first) and parities.

    Parities are at least as many bits as hashes, a power of two: by how many of them share a place, odd or even.
    """

    def marks(sets: pd.Series, others: pd.Series) -> pd.DataFrame:
        levels, rows = held.value, []
        for v, w in zip(sets, others, strict=True):
            v, w = np.sort(v), np.sort(w)
            ranked = v[np.argsort(levels[v & (BUCKETS - 1)], kind="stable")]
            m = max(512, 1 << (len(v) - 1).bit_length())
            bits = np.packbits((np.bincount(v & (m - 1), minlength=m) & 1).astype(np.uint8)).tobytes()
            rows.append((hashlib.sha256(v.tobytes() + w.tobytes()).digest(), len(v), ranked[: len(v) - int(np.ceil(threshold * len(v) - 1e-9)) + 1], bits))
        return pd.DataFrame(rows, columns=["d", "size", "p", "bits"])

    return F.pandas_udf(marks, "d binary, size int, p array<long>, bits binary")


def _apart(left: pd.Series, right: pd.Series) -> pd.Series:
    """Differing parities of two sets, those of the larger one folded; at most the words that only one has."""

    def one(a: bytes, b: bytes) -> int:
        x, y = sorted((np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)), key=len)
        return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)))).sum())

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="int64")


def _celled(met: DataFrame) -> DataFrame:
    """The pairs with the cell in which both texts meet: a text goes once to each of its cells, not once a pair.

    A pair belongs to the least neighbour of its left side, which near copies share. Groups of more than ``CELL`` members are
    cut into squares of blocks of about so many, others are dealt to cells of about so many.
    """
    lows = met.select(F.col("left_id").alias("id"), F.col("left_id").alias("g")).unionByName(met.select(F.col("right_id").alias("id"), F.col("left_id").alias("g"))).groupBy("id").agg(F.min("g").alias("g"))
    grouped = met.join(lows.withColumnRenamed("id", "left_id"), "left_id")
    members = grouped.select("g", F.col("left_id").alias("id")).unionByName(grouped.select("g", F.col("right_id").alias("id"))).distinct().groupBy("g").agg(F.count(F.lit(1)).alias("members"))
    cells = members.agg(F.sum("members")).first()[0] or 0
    of = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col("members") / CELL))
    own = F.when(F.col("members") > CELL, F.concat_ws(" ", F.lit("group"), "g", of("left_id"), of("right_id"))).otherwise(F.concat_ws(" ", F.lit("cell"), F.pmod(F.xxhash64("g"), F.lit(cells // CELL + 1))))
    return grouped.join(members, "g").select("left_id", "right_id", own.alias("cell"))


def similar_classes(sets: DataFrame, threshold: float, key: str = "id", values: str = "tokens") -> DataFrame:
    """(id, class_id, links) of every row: the least id with the same set, and how many other rows overlap by the threshold.

    Equal sets (by two hashes of 64 bits of every word) are one class, so copies cost a row and not their pairs. Classes
    meet as in ``similar_pairs``, by the rarest words of each, by the count of their bucket of ``BUCKETS``; what meets
    and is not too far apart by the parities of either, a bit a word, is verified on the words themselves.
    Rows without a value have no class and no links. Ids are unique.
    """
    from ledgerloom.sources.scratch import written

    spark = sets.sparkSession
    each = sets.select(F.col(key).alias("id"), F.col(values).alias("v"))
    one, two = (F.array_distinct(F.transform("v", f)) for f in (lambda t: F.xxhash64(t), lambda t: F.xxhash64(t, F.lit(1))))
    hashed = each.select("id", one.alias("h"), two.alias("o")).where(F.size("h") > 0)
    held = spark.sparkContext.broadcast(_levels(hashed.select("h")))
    marked = written(hashed.select("id", _marks(held, threshold)("h", "o").alias("m")).select("id", "m.*"), "prefixes")
    classes = written(marked.groupBy("d").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")), "classes")
    first = marked.join(classes.select(F.col("class_id").alias("id")), "id").select("id", "size", F.posexplode("p").alias("at", "h"))
    side = lambda p: first.select("h", F.col("id").alias(f"{p}_id"), F.col("size").alias(f"{p}_size"), F.col("at").alias(f"{p}_at"))
    rest = lambda p: F.col(f"{p}_size") - F.col(f"{p}_at")
    enough = F.least(rest("left"), rest("right")) >= F.lit(threshold / (1 + threshold)) * (F.col("left_size") + F.col("right_size")) - 1e-6
    met = side("left").join(side("right"), "h").where("left_id < right_id").where(enough).select("left_id", "right_id").distinct()
    bits = marked.select("id", "bits", "size")
    may = F.pandas_udf(_apart, "long")("lb", "rb") <= F.lit((1 - threshold) / (1 + threshold)) * (F.col("ls") + F.col("rs")) + 1e-6
    met = written(met.join(bits.toDF("left_id", "lb", "ls"), "left_id").join(bits.toDF("right_id", "rb", "rs"), "right_id").where(may).select("left_id", "right_id"), "met")
    seen = met.select(F.col("left_id").alias("id")).unionByName(met.select(F.col("right_id").alias("id"))).distinct()
    seen = F.broadcast(seen) if seen.count() <= MAX_SEEN else seen
    texts = each.join(seen, "id").join(classes.select(F.col("class_id").alias("id"), "n"), "id").select("id", "n", F.array_distinct("v").alias("v"))
    pairs = _celled(met)
    need = pairs.select(F.col("cell").alias("at"), F.col("left_id").alias("id")).unionByName(pairs.select(F.col("cell").alias("at"), F.col("right_id").alias("id"))).distinct()
    kind = each.schema["id"].dataType.simpleString()

    def verified(met: pa.Table, docs: pa.Table) -> pa.Table:
        held = {k: (frozenset(v), n) for k, v, n in zip(*(docs.column(c).to_pylist() for c in ("id", "v", "n")), strict=True)}
        more: dict = {}
        for l, r in zip(met.column("left_id").to_pylist(), met.column("right_id").to_pylist(), strict=True):  # noqa: E741
            (x, m), (y, n) = held[l], held[r]
            shared = len(x & y)
            if shared / (len(x) + len(y) - shared) >= threshold:
                more[l], more[r] = more.get(l, 0) + n, more.get(r, 0) + m
        return pa.table({"class_id": pa.array(list(more), docs.schema.field("id").type), "more": pa.array(list(more.values()), pa.int64())})

    linked = pairs.groupBy("cell").cogroup(need.join(texts, "id").groupBy("at")).applyInArrow(verified, f"class_id {kind}, more long")
    more = linked.groupBy("class_id").agg(F.sum("more").alias("more"))
    of = marked.select("id", "d").join(classes, "d").join(more, "class_id", "left").select("id", "class_id", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("links"))
    return of.unionByName(each.where(F.coalesce(F.size("v"), F.lit(0)) <= 0).select("id", F.lit(None).cast(of.schema["class_id"].dataType).alias("class_id"), F.lit(0).cast("long").alias("links")))


def merge_similarity(a: Column, b: Column) -> Column:
    """How alike two families are: regions, roles, fields, and provider, country, kind and page count."""
    same = lambda k, w: F.when(a[k].eqNullSafe(b[k]), w).otherwise(0.0)
    return F.round(rules.region_similarity(a["regions"], b["regions"]) * 0.45 + jaccard(a["roles"], b["roles"]) * 0.20 + jaccard(a["fields"], b["fields"]) * 0.15 + same("provider_name", 0.05) + same("country_code", 0.05) + same("document_family", 0.05) + same("page_count", 0.05), 4)


def merge_candidates(families: DataFrame, floor: float = MERGE_FLOOR) -> DataFrame:
    """(source_id, target_id, similarity): pairs of active families alike enough to merge, the weaker into the stronger.

    All but the regions add 0.55 at most, so their likeness, a mean of Jaccard indices by weight, is (floor - 0.55) / 0.45 at least.
    A region's weight is dealt to a family's tokens there in equal parts; what two families share is then, of either's whole weight, at least that.
    Families meet by their rarest (region, token) from which on enough weight is left, so words that all have make no pairs where others are needed.
    """
    if floor <= 0.55:
        raise ValueError("a floor of 0.55 or less needs every pair of families")
    side = F.struct(*[F.col(c) for c in ("regions", "roles", "fields", "provider_name", "country_code", "document_family", "page_count", "apply_count", "reject_count", "confidence")])
    f = families.where("status != 'retired'").select("template_family_id", side.alias("s"))
    each = f.select("template_family_id", F.explode(F.array(*[F.struct(F.lit(k).alias("region"), F.lit(w).alias("w"), F.array_distinct(F.coalesce(F.col(f"s.regions.{k}"), F.array().cast("array<string>"))).alias("v")) for k, w in rules.REGION_WEIGHTS.items()])).alias("x")).select("template_family_id", "x.*")
    token = F.coalesce(F.concat(F.lit("="), "t"), F.lit(""))  # a null is a token as well
    long = each.select("template_family_id", "region", (F.col("w") / F.size("v")).alias("w"), F.explode("v").alias("t")).withColumn("t", token)
    counted = long.join(long.groupBy("region", "t").agg(F.count(F.lit(1)).alias("n")), ["region", "t"])
    rare = counted.groupBy("template_family_id").agg(F.array_sort(F.collect_list(F.struct("n", "region", "t", "w"))).alias("o"))
    weight = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["w"])
    left = lambda k: weight(F.slice("o", k + 1, F.size("o")))
    enough = F.filter("o", lambda x, k: left(k) >= F.lit((floor - 0.00005 - 0.55) / 0.45) * weight(F.col("o")) - 1e-9)  # likeness is rounded to four places
    tokens = rare.select("template_family_id", F.explode(enough).alias("x")).select("template_family_id", "x.region", "x.t")
    met = tokens.toDF("left_id", "region", "t").join(tokens.toDF("right_id", "region", "t"), ["region", "t"]).where("left_id < right_id").select("left_id", "right_id").distinct()
    j = met.join(f.toDF("left_id", "a"), "left_id").join(f.toDF("right_id", "b"), "right_id")
    for k in ("provider_name", "country_code", "document_family"):
        j = j.where(F.col(f"a.{k}").isNull() | F.col(f"b.{k}").isNull() | (F.col(f"a.{k}") == F.col(f"b.{k}")))
    strength = lambda p: F.col(f"{p}.apply_count") * 1.0 - F.col(f"{p}.reject_count") * 0.5 + F.col(f"{p}.confidence") * 10
    s = merge_similarity(F.col("a"), F.col("b"))
    left = strength("a") >= strength("b")
    return j.withColumn("similarity", s).where(F.col("similarity") >= floor).select(F.when(left, F.col("right_id")).otherwise(F.col("left_id")).alias("source_id"), F.when(left, F.col("left_id")).otherwise(F.col("right_id")).alias("target_id"), "similarity")


def resolved_providers(documents: DataFrame, aliases: DataFrame, floor: float = 0.75, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, provider_name, confidence): the provider whose alias a text holds, or most of whose words it holds.

    ``aliases``: provider_no, provider_name, alias. A catalogue; each text meets every alias, so the text is scanned
    where it is and only matches leave. Of equal confidence the first provider wins. More than ``MAX_ALIASES`` are an error.
    """
    if aliases.limit(MAX_ALIASES + 1).count() > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} aliases")
    a = aliases.select("provider_no", "provider_name", F.lower(F.trim("alias")).alias("a")).where("a != ''")
    a = a.withColumn("w", F.filter(F.split("a", r"\s+"), lambda w: F.length(w) > 2))
    catalogue = a.agg(F.sort_array(F.collect_list(F.struct("provider_no", "provider_name", "a", "w"))).alias("c"))  # one row of configuration
    low = F.lower(F.col(text))
    j = documents.select(doc, low.alias("__low")).crossJoin(F.broadcast(catalogue))
    score = lambda x: F.when(F.col("__low").contains(x["a"]), 1.0).otherwise(F.when(F.size(x["w"]) > 0, F.size(F.filter(x["w"], lambda w: F.col("__low").contains(w))) / F.size(x["w"])).otherwise(0.0))
    scored = F.transform("c", lambda x: F.struct(score(x).alias("s"), (-x["provider_no"]).alias("o"), x["provider_name"].alias("p")))
    best = F.array_max(scored)
    return j.select(doc, best.alias("b")).where(F.col("b.s") >= floor).select(doc, F.col("b.p").alias("provider_name"), F.col("b.s").alias("confidence"))


def anchor_signatures(tokens: DataFrame) -> DataFrame:
    """(doc_id, page_no, page_role, header_tokens, summary_labels, footer_tokens, keyword_hits) of every page.

    ``tokens``: doc_id, page_no, text, y, h, page_h.
    """
    from ledgerloom.functions.sets import region_of, top_values

    # The words that mark what a page says about an invoice, and those that make it a summary.
    keywords = {
        "invoice_number": ("invoice", "inv", "number", "no", "ref"),
        "invoice_date": ("date", "issued"),
        "provider": ("seller", "vendor", "supplier", "clinic", "hospital", "company"),
        "customer": ("customer", "buyer", "bill", "ship", "client", "owner"),
        "summary": ("subtotal", "total", "tax", "vat", "amount", "balance", "due"),
        "footer": ("terms", "payment", "bank", "iban", "swift", "remit"),
    }
    summary_words = ("subtotal", "total", "amount due", "balance due", "vat", "tax")
    # A token's marks are found once: a bit for each list of words that it speaks of, and for the region that it stands in.
    t = tokens.withColumns({"a": anchor(F.col("text")), "r": region_of(F.col("y"), F.col("h"), F.col("page_h"))}).where("a != ''")
    any_word = "|".join(sorted({w for ws in keywords.values() for w in ws}, key=lambda w: (-len(w), w)))
    named = lambda words: reduce(lambda x, y: x | y, [F.col("a").contains(w) for w in words])
    kinds = F.when(F.col("a").rlike(any_word), F.array_compact(F.array(*[F.when(named(w), F.lit(k)) for k, w in keywords.items()])))
    edge = F.when(F.col("r").isin("header", "footer") & ~F.col("a").rlike("^[0-9]+$"), F.array("r"))
    none = F.array().cast("array<string>")
    marked = t.select("doc_id", "page_no", "token_seq", "a", F.concat(F.coalesce(kinds, none), F.coalesce(edge, none)).alias("m"))
    sets = [F.collect_set(F.when(F.array_contains("m", k), F.col("a"))).alias(f"k_{k}") for k in keywords]
    page = marked.groupBy("doc_id", "page_no").agg(
        F.collect_set(F.when(F.array_contains("m", "header"), F.col("a"))).alias("h"), F.collect_set(F.when(F.array_contains("m", "footer"), F.col("a"))).alias("f"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_seq", "a"))), lambda x: x["a"]), " ").alias("joined"), *sets,
    )
    is_summary = reduce(lambda x, y: x | y, [F.col("joined").contains(w) for w in summary_words])
    role = F.when(is_summary, "summary_page").when(F.col("page_no") == 0, "header_page").otherwise("line_item_page")
    hits = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), top_values(F.col(f"k_{k}"), 10).alias("value")) for k in keywords]), lambda e: F.size(e["value"]) > 0))
    return page.select("doc_id", "page_no", role.alias("page_role"), top_values(F.col("h"), 15).alias("header_tokens"), top_values(F.col("k_summary"), 10).alias("summary_labels"), top_values(F.col("f"), 10).alias("footer_tokens"), hits.alias("keyword_hits"))


def nearest_hashes(queries: DataFrame, rows: DataFrame, block: int = 2048) -> DataFrame:
    """(doc_id, fingerprint_hash, total_distance): the hash nearest to each query's among the rows of other ids, of equally near ones the least.

    ``queries`` and ``rows``: doc_id, visual_hash of 16 hexadecimal digits. Queries are cut into blocks that meet the
    distinct hashes of all rows in blocks; a pair of blocks yields the nearest different hash of each query. An equal
    hash counts where another row has it. Rows without a hash are left out.
    """
    high = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    low = lambda h: F.conv(F.substring(h, 9, 8), 16, 10).cast("long")
    number = lambda h: F.shiftleft(high(h), 32).bitwiseOR(low(h))
    # Equal hashes are one query and one row; blocks are dealt by hash, about ``block`` rows each.
    cased = lambda df: df.where("visual_hash IS NOT NULL").select("doc_id", F.lower("visual_hash").alias("h"))
    q, r = cased(queries), cased(rows).groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    hashes = q.select("h").distinct()

    def dealt(df: DataFrame, size: int, name: str) -> DataFrame:
        parts = max(1, -(-df.count() // size))
        return df.groupBy(F.pmod(F.xxhash64("h"), F.lit(parts)).alias(f"{name}_block")).agg(F.collect_list(number(F.col("h"))).alias(name))

    pairs = dealt(hashes, block, "q").crossJoin(dealt(r, 8 * block, "r"))

    def best(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                own, other = (batch.column(c)[k].values.to_numpy().view(np.uint64) for c in (0, 1))
                other = np.sort(other)  # so that the first of equally near ones is the least
                at, far = np.empty(len(own), dtype=np.int64), np.empty(len(own), dtype=np.int32)
                for a in range(0, len(own), 64):
                    bits = np.bitwise_count(own[a : a + 64, None] ^ other[None, :])
                    bits[bits == 0] = 65
                    at[a : a + 64] = bits.argmin(1)
                    far[a : a + 64] = bits.min(1)
                text = lambda x: [f"{int(v):016x}" for v in x]
                yield pa.RecordBatch.from_arrays([pa.array(text(own)), pa.array(text(other[at])), pa.array(far)], ["h", "f", "n"])

    found = pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism * 4, "q_block", "r_block").select("q", "r").mapInArrow(best, "h string, f string, n int")
    nearest = found.where("n <= 64").groupBy("h").agg(F.min(F.struct("n", "f")).alias("b"))
    copy = (F.col("lo") != F.col("doc_id")) | (F.col("hi") != F.col("doc_id"))
    j = q.join(nearest, "h", "left").join(r, "h", "left").withColumn("b", F.when(copy, F.struct(F.lit(0).alias("n"), F.col("h").alias("f"))).otherwise(F.col("b")))
    return j.where("b IS NOT NULL").select("doc_id", F.col("b.f").alias("fingerprint_hash"), F.col("b.n").cast("long").alias("total_distance"))
