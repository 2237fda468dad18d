"""The life of layouts and families: successes and rejections in order, per key, from one state to the next.

The transitions of a key depend on each other, so its events are folded in sequence. The batch operator has Spark sort
events by key and ``seq`` and reads them in Arrow batches: only the state moves on, so a key of any number of events is never held. The
streaming one keeps the state between batches and folds the events of one with ``fold_frame``.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.rules import DEGRADATION, ESTABLISH_CONFIDENCE, ESTABLISH_COUNT, REDISCOVERY
from ledgerloom.functions.sets import top_values
from ledgerloom.operators import reports, store

STATE = "apply_count long, reject_count long, confidence double, gt_apply_count long, gt_reject_count long, gt_confidence double, status string"


@dataclass
class State:
    """Counts, running means and the status of a key."""

    apply_count: int = 0
    reject_count: int = 0
    confidence: float = 0.0
    gt_apply_count: int = 0
    gt_reject_count: int = 0
    gt_confidence: float = 0.0
    status: str = "provisional"

    def applied(self, score: float, checked: bool, family: bool) -> None:
        """A success: the mean moves on, and the status may change."""
        self.confidence = (self.confidence * self.apply_count + score) / (self.apply_count + 1)
        self.apply_count += 1
        if checked:
            self.gt_confidence = (self.gt_confidence * self.gt_apply_count + score) / (self.gt_apply_count + 1)
            self.gt_apply_count += 1
        ripe = self.apply_count >= ESTABLISH_COUNT and self.confidence >= ESTABLISH_CONFIDENCE
        if self.status == "provisional" or (family and self.status == "degraded"):
            if ripe:
                self.status = "established"
            elif not family and self.reject_count > self.apply_count:
                self.status = "degraded"
        elif family and self.status == "established" and self.confidence < DEGRADATION and self.reject_count >= REDISCOVERY:
            self.status = "degraded"

    def rejected(self, checked: bool, family: bool) -> None:
        """A rejection."""
        self.reject_count += 1
        if checked:
            self.gt_reject_count += 1
        if self.status == "provisional" and self.reject_count > self.apply_count:
            self.status = "degraded"
        elif family and self.status == "established" and self.reject_count >= REDISCOVERY and self.confidence < DEGRADATION:
            self.status = "degraded"

    def on(self, event: str, score: float, checked: bool, family: bool) -> None:
        """Any event."""
        if event == "apply":
            self.applied(score, checked, family)
        elif event == "reject":
            self.rejected(checked, family)
        elif event == "retire":
            self.status = "retired"


def fold_frame(events: pd.DataFrame, state: State, family: bool) -> pd.DataFrame:
    """The states after each event of one key, in the order of ``seq``."""
    rows = []
    for e in events.sort_values("seq").itertuples():
        state.on(e.event, float(e.score) if e.score == e.score and e.score is not None else 0.0, bool(e.checked), family)
        rows.append({"key": e.key, "seq": e.seq, **asdict(state)})
    return pd.DataFrame(rows, columns=["key", "seq", *asdict(state)])


def folded(events: DataFrame, family: bool = False) -> DataFrame:
    """(key, seq, state) after every event; ``events``: key, seq, event (apply, reject, retire), score, checked."""

    names = list(asdict(State()))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]

    def fold(batches):
        state = State()
        for batch in batches:
            out: list[list] = [[] for _ in range(2 + len(names))]
            for key, seq, event, score, checked, first in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if first:
                    state = State()
                state.on(event, score if score is not None and score == score else 0.0, bool(checked), family)
                for held, value in zip(out, (key, seq, *(getattr(state, n) for n in names)), strict=True):
                    held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["key", "seq", *names])

    first = F.row_number().over(Window.partitionBy("key").orderBy("seq")) == 1
    sorted_ = events.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), "event", F.col("score").cast("double").alias("score"), "checked").withColumn("first", first)
    return sorted_.mapInArrow(fold, f"key string, seq long, {STATE}")


def latest_states(folded_events: DataFrame) -> DataFrame:
    """The last state of each key."""
    last = folded_events.groupBy("key").agg(F.max_by(F.struct(*[c for c in folded_events.columns if c != "key"]), "seq").alias("s"))
    return last.select("key", "s.*")


def split_signals(fingerprints: DataFrame) -> DataFrame:
    """A row a family: how much its members' signatures (page_roles, field_names, anchor_tokens) differ.

    Signatures are counted first, so the similarity to the most frequent one is taken once for each different signature.
    """
    from ledgerloom.functions.rules import signature_similarity

    sig = F.struct(F.array_sort("page_roles").alias("page_roles"), F.array_sort("field_names").alias("field_names"), F.array_sort("anchor_tokens").alias("anchor_tokens"))
    counts = fingerprints.select("template_family_id", sig.alias("sig")).groupBy("template_family_id", "sig").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("template_family_id").agg(F.min_by("sig", F.struct((-F.col("n")).alias("n"), F.to_json("sig"))).alias("mode"), F.max("n").alias("dominant"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("signatures"))
    j = counts.join(per, "template_family_id").withColumn("s", signature_similarity(F.col("mode"), F.col("sig")))
    avg = j.groupBy("template_family_id").agg((F.sum((F.col("s") * F.col("n")).cast("decimal(24,6)")) / F.sum("n")).cast("double").alias("average"))
    out = per.join(avg, "template_family_id")
    return out.select(
        "template_family_id", F.col("members").alias("member_count"), F.col("signatures").alias("unique_signature_count"), F.col("dominant").alias("dominant_signature_count"),
        F.round(F.col("dominant") / F.col("members"), 4).alias("dominant_signature_ratio"), F.round("average", 4).alias("average_signature_similarity"), F.round(F.greatest(F.lit(0.0), 1.0 - F.col("average")), 4).alias("split_pressure"),
    )


WEIGHTS = {"anchors": 0.40, "fields": 0.35, "roles": 0.15, "table": 0.05, "pages": 0.05}


class _Tokens:
    """The token sets of a family's members, and an index of the leaders' by their rarest tokens.

    Two sets of overlap ``share`` have a token in common among the first size - ceil(share * size) + 1 of either,
    counted from the rarest; so only such leaders can be that near.
    """

    def __init__(self, lists: pa.ListArray, share: float):
        values = lists.flatten().to_numpy(zero_copy_only=False)
        known = np.sort(values)
        first = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]])) if len(known) else np.empty(0, dtype=np.int64)
        n = np.diff(np.append(first, len(known)))
        known = known[first]  # the sorted copy goes
        rank = np.empty(len(n), dtype=np.int32)
        rank[np.argsort(n, kind="stable")] = np.arange(len(n), dtype=np.int32)
        self.flat = np.empty(len(values), dtype=np.int32)
        for at in range(0, len(values), 1 << 20):
            self.flat[at : at + (1 << 20)] = rank[np.searchsorted(known, values[at : at + (1 << 20)])]
        self.ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        for k in range(len(lists)):
            self.flat[self.ends[k] : self.ends[k + 1]].sort()
        size = np.diff(self.ends)
        self.take = np.where(size > 0, size - np.ceil(share * size - 1e-9).astype(np.int64) + 1, 0)
        room = np.zeros(len(n) + 1, dtype=np.int64)
        for k in range(len(lists)):
            room[self.prefix(k) + 1] += 1
        self.start, self.filled = np.cumsum(room), np.zeros(len(n), dtype=np.int64)
        self.leaders, self.mark = np.empty(int(self.start[-1]), dtype=np.int32), np.zeros(len(n), dtype=bool)

    def of(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k] : self.ends[k + 1]]

    def prefix(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k] : self.ends[k] + self.take[k]]

    def near(self, k: int) -> list[np.ndarray]:
        own = self.prefix(k)
        own = own[self.filled[own] > 0]
        return [self.leaders[a : a + n] for a, n in zip(self.start[own], self.filled[own], strict=True)]

    def lead(self, k: int, leader: int) -> None:
        own = self.prefix(k)
        self.leaders[self.start[own] + self.filled[own]] = leader
        self.filled[own] += 1

    def shares(self, k: int, members: np.ndarray) -> list[float]:
        """The overlaps of a member's set with others'."""
        own = self.of(k)
        self.mark[own] = True
        both = [int(np.count_nonzero(self.mark[self.of(m)])) for m in members]
        self.mark[own] = False
        return [n / (len(own) + len(self.of(m)) - n) if n else 0.0 for n, m in zip(both, members, strict=True)]


def split_clusters(fingerprints: DataFrame, threshold: float = 0.72) -> DataFrame:
    """(template_family_id, fingerprint_hash, cluster): members joined to the leader that they are most alike, if enough.

    Leaders come up in the order of confidence, successes and age, so a family's members are seen in sequence. Likeness
    is the overlap of anchor tokens, field names and page roles, and whether both have a table and several pages
    (``table_enabled`` and ``page_count``, where there are such columns; without the latter the roles are counted), to
    three places; of leaders equally alike the first wins. Tokens are compared by 64-bit hashes. A leader that can be
    alike enough overlaps in anchors or in fields, so it is found by their rarest tokens and the others are not compared.
    """
    has = set(fingerprints.columns)
    empty = F.array().cast("array<string>")
    clean = lambda c: F.filter(F.coalesce(F.col(c), empty), lambda t: t.isNotNull() & (t != ""))
    hashed = lambda c: F.array_sort(F.array_distinct(F.transform(clean(c), lambda t: F.xxhash64(t))))
    table = F.coalesce(F.col("table_enabled"), F.lit(False)) if "table_enabled" in has else F.lit(False)
    pages = F.size(F.coalesce(F.col("page_roles"), empty))
    several = (F.coalesce(F.col("page_count"), pages) if "page_count" in has else pages) > 1
    f = fingerprints.select(
        "template_family_id", "fingerprint_hash", "confidence", "apply_count", "created_at", hashed("anchor_tokens").alias("anchors"), hashed("field_names").alias("fields"),
        F.array_sort(F.array_distinct(clean("page_roles"))).alias("roles"), table.alias("table"), several.alias("pages"),
    )
    f = f.withColumn("fields", F.when(F.col("fields") != F.col("anchors"), F.col("fields")))  # equal sets are sent once
    share = (threshold - 0.0005 - 0.25) / 0.75 - 1e-9

    def one(t: pa.Table) -> pa.Table:
        order = pc.sort_indices(t, [("confidence", "descending"), ("apply_count", "descending"), ("created_at", "ascending"), ("fingerprint_hash", "ascending")]).to_numpy()
        lists = lambda c: t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0)
        anchors, own = lists("anchors"), lists("fields")
        same = not own.null_count < len(own)
        if not same:
            own = pc.if_else(own.is_null(), anchors, own)
        a = _Tokens(anchors, share)
        b = a if same else _Tokens(own, share)
        roles, table, pages = [frozenset(r) for r in t.column("roles").to_pylist()], t.column("table").to_pylist(), t.column("pages").to_pylist()
        leaders: list[int] = []
        cluster = np.empty(t.num_rows, dtype=np.int32)
        for k in order:
            if share <= 0:
                found = np.arange(len(leaders))
            else:
                parts = a.near(k) + (b.near(k) if b is not a else [])
                found = np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype=np.int32)
            best, score = None, 0.0
            if len(found):
                others = [leaders[c] for c in found]
                x = a.shares(k, others)
                y = x if b is a else b.shares(k, others)
                for c, m, p, q in zip(found, others, x, y, strict=True):
                    r = len(roles[k] & roles[m]) / len(roles[k] | roles[m]) if roles[k] and roles[m] else 0.0
                    s = round(p * WEIGHTS["anchors"] + q * WEIGHTS["fields"] + r * WEIGHTS["roles"] + (table[k] == table[m]) * WEIGHTS["table"] + (pages[k] == pages[m]) * WEIGHTS["pages"], 3)
                    if s > score:
                        best, score = c, s
            if best is None or score < threshold:
                best = len(leaders)
                leaders.append(k)
                a.lead(k, best)
                if b is not a:
                    b.lead(k, best)
            cluster[k] = best
        return pa.table({"template_family_id": t.column("template_family_id").cast("string"), "fingerprint_hash": t.column("fingerprint_hash").cast("string"), "cluster": cluster})

    return f.groupBy("template_family_id").applyInArrow(one, "template_family_id string, fingerprint_hash string, cluster int")


def rebuilt_family(fingerprints: DataFrame, results: DataFrame) -> DataFrame:
    """A family's record anew from its members and results: rollup, representative, keywords' union and split signals."""
    rollup = reports.family_rollup(fingerprints, results)
    lead = store.representative(fingerprints).select("template_family_id", F.col("fingerprint_hash").alias("representative"), "page_roles", "anchor_tokens")
    return rollup.join(lead, "template_family_id", "left").join(split_signals(fingerprints).drop("member_count"), "template_family_id", "left")


def split_family(fingerprints: DataFrame, moved: DataFrame, new_id: str) -> DataFrame:
    """Fingerprints with those among ``moved`` (fingerprint_hash) in a new family."""
    return store.relinked(fingerprints, moved.select("fingerprint_hash", F.lit(new_id).alias("template_family_id")), "fingerprint_hash")


def merge_family(fingerprints: DataFrame, source: str, target: str) -> DataFrame:
    """Fingerprints with the source family's members in the target family."""
    return fingerprints.withColumn("template_family_id", F.when(F.col("template_family_id") == source, target).otherwise(F.col("template_family_id")))


def split_out(tables: dict[str, DataFrame], family: str, hashes: DataFrame, new_id: str, at: F.Column, reason: str = "manual_split") -> dict[str, DataFrame]:
    """The tables (families, fingerprints, results, examples, versions) with those members of a family in a new one.

    Both families' records are rebuilt from their members and results; examples and results follow their fingerprints, results by their path as well;
    three versions are added. Moving none or all of the members is an error.
    """
    members = tables["fingerprints"].where(F.col("template_family_id") == family)
    moved = members.join(hashes.select("fingerprint_hash").distinct(), "fingerprint_hash", "left_semi").select("fingerprint_hash")
    n, whole = moved.count(), members.count()
    if not 0 < n < whole:
        raise ValueError(f"{n} of {whole} members cannot leave {family}")
    if tables["families"].where(F.col("template_family_id") == new_id).limit(1).count():
        raise ValueError(f"{new_id} is there already")
    own = tables["results"].join(moved, "fingerprint_hash", "left_semi")
    paths = own.where("invoice_path IS NOT NULL").select("invoice_path").distinct()
    none = paths.limit(0)
    moves = moved.withColumn("template_family_id", F.lit(new_id))
    fingerprints = store.relinked(tables["fingerprints"], moves, "fingerprint_hash")
    results = store.relinked_either(tables["results"], moved, none, family, new_id)
    examples = store.relinked_either(tables["examples"], moved, paths, family, new_id)
    born = tables["families"].where(F.col("template_family_id") == family).withColumn("template_family_id", F.lit(new_id))
    families = _renewed(tables["families"].unionByName(born), fingerprints, results, [family, new_id])
    steps = [(family, f"{reason}:before_split_to:{new_id}"), (new_id, f"{reason}:split_from:{family}"), (family, f"{reason}:split_out:{new_id}")]
    return {**tables, "families": families, "fingerprints": fingerprints, "results": results, "examples": examples, "versions": _versioned(tables["versions"], families, steps, at)}


def merged_into(tables: dict[str, DataFrame], source: str, target: str, at: F.Column, reason: str = "manual_merge") -> dict[str, DataFrame]:
    """The same tables with a family's members, examples and results in another; what the target's record lacks comes from the source's, which retires."""
    live = tables["families"].where(F.col("template_family_id").isin(source, target) & (F.col("status") != "retired")).count()
    if source == target or live != 2:
        raise ValueError("both families must be there, differ and not be retired")
    hashes = tables["fingerprints"].where(F.col("template_family_id") == source).select("fingerprint_hash")
    if not hashes.limit(1).count():
        raise ValueError(f"{source} has no members")
    moved = tables["results"].join(hashes, "fingerprint_hash", "left_semi").select("invoice_path")
    paths = moved.unionByName(tables["examples"].where(F.col("template_family_id") == source).select("invoice_path")).where("invoice_path IS NOT NULL").distinct()
    fingerprints = store.relinked(tables["fingerprints"], hashes.withColumn("template_family_id", F.lit(target)), "fingerprint_hash")
    results, examples = (store.relinked_either(tables[t], hashes, paths, source, target) for t in ("results", "examples"))
    names = [c for c in tables["families"].columns if c not in ("template_family_id", "status")]
    old = tables["families"].where(F.col("template_family_id") == source).select(F.lit(target).alias("template_family_id"), *names)
    families = store.patched(old, tables["families"].where(F.col("template_family_id") == target), ["template_family_id"], names)
    kept = tables["families"].join(families.select("template_family_id", *[F.col(c).alias(f"__{c}") for c in names]), "template_family_id", "left")
    filled = kept.select("template_family_id", F.when(F.col("template_family_id") == source, "retired").otherwise(F.col("status")).alias("status"), *[F.coalesce(f"__{c}", c).alias(c) for c in names]).select(*tables["families"].columns)
    renewed = _renewed(filled, fingerprints, results, [target])
    steps = [(target, f"{reason}:before_merge_from:{source}"), (source, f"{reason}:before_merge_into:{target}"), (target, f"{reason}:merge_from:{source}"), (source, f"{reason}:merged_into:{target}")]
    return {**tables, "families": renewed, "fingerprints": fingerprints, "results": results, "examples": examples, "versions": _versioned(tables["versions"], renewed, steps, at)}


def _renewed(families: DataFrame, fingerprints: DataFrame, results: DataFrame, which: list[str]) -> DataFrame:
    """Families with the counts, confidence and status of those named rolled up anew from their members and results."""
    own = lambda df: df.where(F.col("template_family_id").isin(*which))
    rollup = reports.family_rollup(own(fingerprints), own(results).join(own(fingerprints).select("fingerprint_hash").distinct(), "fingerprint_hash", "left_semi"))
    return store.patched(families, rollup, ["template_family_id"], [c for c in ("apply_count", "reject_count", "confidence", "status") if c in families.columns])


def _versioned(versions: DataFrame, families: DataFrame, steps: list[tuple[str, str]], at: F.Column) -> DataFrame:
    """``versions`` (template_family_id, version, reason, at) with the steps added, each family's numbered on."""
    order = families.sparkSession.createDataFrame([(f, k, r) for k, (f, r) in enumerate(steps)], "template_family_id string, k int, reason string")
    last = versions.groupBy("template_family_id").agg(F.max("version").alias("last"))
    number = F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("template_family_id").orderBy("k"))
    return versions.unionByName(order.join(last, "template_family_id", "left").select("template_family_id", number.cast("int").alias("version"), "reason", at.alias("at")))


def profile_suggestions(results: DataFrame, support: int = 2, recent: int = 10) -> DataFrame:
    """(template_family_id, kind, support): changes of a family's profile that enough of its recent results speak for.

    ``results``: template_family_id, id, processed_at, line_source, table_found, date_ambiguous, party_suspicious.
    """
    from ledgerloom.operators.history import recent as last

    r = last(results.where("template_family_id IS NOT NULL"), "template_family_id", [F.desc("processed_at"), F.desc("id")], recent)
    kinds = {"table_detection": (F.col("line_source") == "row_fallback") | ~F.col("table_found"), "date_order": F.col("date_ambiguous"), "party_labels": F.col("party_suspicious")}
    per = r.groupBy("template_family_id").agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    long = per.select("template_family_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("support")) for k in kinds])).alias("x"))
    return long.select("template_family_id", "x.kind", "x.support").where(F.col("support") >= support)


def retirements(families: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(template_family_id, reason): families without members, rejected again and again, or degraded without a success."""
    live = fingerprints.where("status != 'retired'").select("template_family_id").distinct().withColumn("has_members", F.lit(True))
    f = families.where("status != 'retired'").join(live, "template_family_id", "left")
    c = F.col
    reason = F.when(c("has_members").isNull(), "orphaned").when((c("reject_count") >= 5) & (c("reject_count") >= c("apply_count") * 2), "repeated_rejection").when((c("status") == "degraded") & (c("apply_count") == 0), "degraded_without_success")
    return f.withColumn("reason", reason).where("reason IS NOT NULL").select("template_family_id", "reason")


def shared_signals(a: F.Column, b: F.Column, n: int = 6) -> F.Column:
    """The first n tokens that two families share."""
    return top_values(F.array_intersect(a, b), n)


