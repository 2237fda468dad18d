import gzip
import hashlib
import io
import random
from base64 import b32encode

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import ann, mixing, queries, warc
from ledgerloom.llm.shared import filesystem, scratch


def vectors(n, dim, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(rows, k):
    sound = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, v in sound:
        if q % 20 == 0:
            scores = sorted((-sum(float(a) * float(b) for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_neighbours(spark, monkeypatch):
    x = vectors(400, 16)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(400 + k, rows[5][1]) for k in range(30)]  # ties
    rows += [(500, None), (520, []), (540, [0.0] * 16), (560, [None] + [1.0] * 15), (580, [float("nan")] * 16), (600, [float("inf")] * 16), (620, [1.0, 2.0]), (621, [2.0, 1.0]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("bits", F.lit(2))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=20, block_rows=97, block_queries=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = brute([(i, [None if c is None else float(np.float32(c)) for c in v] if v is not None else None) for i, v in rows], 20)
    assert set(got) == {q for q, n in want.items() if n}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got)
    assert hits >= 0.99 * sum(len(want[q]) for q in got)
    for q in (400, 420):
        assert got[q] == want[q]  # thirty equal vectors: the smaller ids
    assert got[620] == [(621, 4.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_error_bounds_hold():
    x, q = vectors(2000, 64, 1), vectors(50, 64, 2)
    middle = x.mean(axis=0)
    estimate, bound = ann.estimates(q.astype(float), *ann.encode(x.astype(float), middle, 3), middle, 3, ann.EPSILON)
    off = np.abs(estimate - q @ x.T)
    assert (off <= bound).mean() > 0.99 and off.mean() < 0.08


def test_neighbours_sql(spark):
    x = vectors(120, 8, 4)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("e0", df.toPandas())
    con.execute("CREATE VIEW embeddings AS SELECT vec_id, embedding::FLOAT[] AS embedding FROM e0")
    want = sorted(con.execute(queries.ORACLE_SQL["op1_ann"]).fetchall())
    assert sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0).collect())) == want


PAGES = [(k, f"https://x.net/{k}", f"<p>{'text ' * (k % 7)}{k // 3}</p>") for k in range(60)]
PAGES += [(100, None, None), (101, "u", ""), (99, "https://é.net/a b\n", ""), (102, "u", None), (7, "twice", PAGES[7][2]), (None, "n", "<p>lone</p>"), (None, "n", PAGES[9][2]), (110, "long", "éß" * 300_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("hash", F.lit("h")).repartition(3)


def expected(min_bytes=0):
    least = {}
    for i, _, h in PAGES:
        own = least.setdefault((h or "").encode(), [None, 0])
        own[1] += 1
        if i is not None and (own[0] is None or i < own[0]):
            own[0] = i
    out = []
    for i, _, h in PAGES:
        p = (h or "").encode()
        again = len(p) >= min_bytes and least[p][1] > 1 and i != least[p][0]
        out.append((i, len(p), b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", least[p][0] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("range_bytes", [1 << 25, 997, 64])
def test_archives(spark, pages, range_bytes):
    files = warc.write_archives(pages, scratch(spark, "w"))
    got = warc.read_archives(spark, files, range_bytes).collect()
    assert sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected()
    urls = {r.record_id: r.url for r in got if r.record_id is not None}
    assert urls[100] is None and urls[99] == "https://é.net/a%20b%0A" and urls[3] == "https://x.net/3"
    assert all(r.payload.decode() == dict((i, h) for i, _, h in PAGES)[r.record_id] for r in got if r.payload and r.record_id is not None and r.record_id != 7)


def test_archives_of_short_payloads_and_none(spark, pages):
    files = warc.write_archives(pages, scratch(spark, "w"), min_bytes=8)
    got = warc.read_archives(spark, files).collect()
    assert sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(8)
    none = warc.write_archives(pages.limit(0), scratch(spark, "w"))
    assert none == [] and warc.read_archives(spark, none).collect() == []


def test_archives_are_plain_gzip(spark, pages):
    file, size = warc.write_archives(pages.coalesce(1), scratch(spark, "w"))[0]
    fs, at = filesystem(file)
    raw = fs.open_input_stream(at, compression=None).read()
    assert len(raw) == size and gzip.decompress(raw).count(b"WARC/1.1\r\n") == len(PAGES)


def test_ranges_see_through_false_starts():
    inner = warc.record("response", 5, None, b"inner")
    blob = random.Random(1).randbytes(5000) + warc.MAGIC + b"\x00" * 9 + inner[:20]
    raw = b"".join(warc.record("response", k, f"u{k}", blob + bytes([k])) for k in range(9))
    whole = [p for p, _ in warc.members(io.BytesIO(raw), 0, len(raw), len(raw))]
    for step in (500, 3000, 7001):
        found = [p for at in range(0, len(raw), step) for p, _ in warc.members(io.BytesIO(raw), at, min(at + step, len(raw)), len(raw))]
        assert found == whole and len(found) == 9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_pfair_deviates_by_less_than_a_block(share):
    slots, m = mixing.period_slots(share), sum(share)
    assert sorted(t for s in slots for t in s) == list(range(m))
    for a, own in zip(share, slots, strict=True):
        assert len(own) == a
        for i, t in enumerate(own):
            assert i * m // a <= t < -(-(i + 1) * m // a)
        for t in range(m + 1):
            assert abs(sum(x < t for x in own) - t * a / m) < 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 6)), min_size=1, max_size=6))
def test_phases_place_every_block_once(sources):
    blocks, share = [b for b, _ in sources], [a for _, a in sources]
    taken = []
    for n, own in zip(blocks, mixing.phases(blocks, share), strict=True):
        for b in range(n):
            p = [x for x in own if x["b"] <= b][-1]
            i = b - p["b"]
            taken.append(p["t"] + i // p["a"] * p["m"] + p["slots"][i % p["a"]])
    assert sorted(taken) == list(range(sum(blocks)))


def test_shares():
    got = mixing.shares({"a": 1000, "b": 10, None: 1}, period=100)
    assert got["a"] > got["b"] >= 1 and got[None] >= 1
    assert mixing.shares({"a": 1, "b": 1}, weights={"a": 3, "b": 1}, period=100) == {"a": 3, "b": 1} or sum(mixing.shares({"a": 1, "b": 1}, weights={"a": 3, "b": 1}, period=100).values()) == 100


def test_mixing(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 4)
    found = mixing.mix(docs.selectExpr("*", "1 AS slot", "2 AS `__k`", "3 AS `a.b`"), block_rows=3, period=20)
    got = found.collect()
    assert found.columns == [*docs.columns, "__k", "a.b", *mixing.ADDED]
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(r[0]), str(r[1])) for r in rows)
    assert len({(r.slot, r.in_block) for r in got}) == len(got)
    assert all(r.released <= r.slot < r.due for r in got)
    by_slot = {r.slot: r.source for r in got}
    assert sorted(by_slot) == list(range(len(by_slot)))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + 1
    share = mixing.shares(sizes, period=20)
    m = sum(share.values())
    first_out = min(max(t for t, s in by_slot.items() if s == name) for name in sizes)
    for t in range(first_out + 1):
        for name, a in share.items():
            assert abs(sum(by_slot[x] == name for x in range(t)) - t * a / m) < 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    order = [r.doc_id for r in mixing.mixed(docs, block_rows=3, period=20).collect()]
    want = [r.doc_id for r in sorted(mixing.mix(docs, block_rows=3, period=20).collect(), key=lambda r: (r.slot, r.in_block))]
    assert order == want and mixing.mixed(docs).schema == docs.schema
    assert mixing.mix(empty).collect() == []


def simulated(sizes, share, block_rows):
    """(source, block) of each slot: at every slot, of the blocks that are released, the one due earliest goes; a source that runs out starts a new phase."""
    left = {s: -(-n // block_rows) for s, n in sizes.items()}
    done, out, begin = dict.fromkeys(sizes, 0), [], 0
    phase = dict.fromkeys(sizes, 0)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    while any(left.values()):
        live = [s for s in order if left[s]]
        m = sum(share[s] for s in live)
        t = len(out) - begin
        ready = [(-(-(phase[s] + 1) * m // share[s]), order.index(s), s) for s in live if phase[s] * m // share[s] <= t]
        _, _, s = min(ready)
        out.append((s, done[s]))
        done[s] += 1
        phase[s] += 1
        left[s] -= 1
        if not left[s]:
            begin, phase = len(out), dict.fromkeys(sizes, 0)
    return out


def test_mixing_by_simulation(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 16)
    rows = [(k, s) for s, n in (("a", 333), ("b", 70), (None, 41), ("c", 5)) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    got = mixing.mix(docs, block_rows=4, period=24).collect()
    sizes = {"a": 333, "b": 70, None: 41, "c": 5}
    want = simulated(sizes, mixing.shares(sizes, period=24), 4)
    found = {}
    for r in got:
        found.setdefault(r.slot, []).append((r.source, r.block, r.in_block))
    assert [found[t][0][:2] for t in range(len(want))] == want
    for t, (s, b) in enumerate(want):
        assert sorted(found[t]) == [(s, b, k) for k in range(min(4, sizes[s] - 4 * b))]


def test_mixing_spreads_a_hot_id(spark, tmp_path):
    """Rows of one id, or none, are many chunks and no two share a place."""
    rows = [(None, "hot", f"t{k % 7}") for k in range(40_000)] + [(7, "cold", "x")] * 3
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    got = mixing.mix(docs, block_rows=64).select("slot", "in_block", "source").collect()
    assert len({(r.slot, r.in_block) for r in got}) == len(got) == 40_003
    again = mixing.mix(docs, block_rows=64)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.mix(docs, block_rows=64).collect()))
    keyed = mixing.in_rows(docs, "x").select(mixing.F.xxhash64(mixing.F.lit(0), "doc_id", "__row").alias("h"))
    chunk = keyed.groupBy(mixing.F.shiftrightunsigned("h", 60)).count().collect()
    assert len(chunk) == 16 and max(r["count"] for r in chunk) < 4000


def test_search_with_repeated_query_rows(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(30, 8))
    rows = [(k, v[k].tolist()) for k in range(30)] + [(0, v[1].tolist()), (5, v[5].tolist()), (5, v[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 10 == 0, k=4).collect()
    for q in (0, 10, 20):
        mine = [x for i, x in rows if i == q]
        scores = sorted(((-float(np.dot(a, x)), i) for a in mine for i, x in rows if i != q))[:4]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [i for _, i, _ in own] == [i for _, i in scores] and np.allclose([s for *_, s in own], [-s for s, _ in scores])
