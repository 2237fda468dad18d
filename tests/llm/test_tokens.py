import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import packing, token_counts, token_files, tokenizer
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.llm.shared import scratch
from ledgerloom.llm.tokenizer import Chunks

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    made = {n: Tokenizer.from_file(tokenizer_path(n)) for n in (WORD, BYTE)}
    return lambda name, text: made[name].encode(text or "", add_special_tokens=False).ids


CHUNKS = {n: Chunks(tokenizer_path(n)) for n in (WORD, BYTE)}
ODD = " \n\t\r\x0b\xa0ab'sXéÉ.,!1²Ⅷ字<|endoftext|>​\x1c\x85́#&_-"


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet=ODD, max_size=60), st.text(max_size=60), st.lists(st.sampled_from(["The", " été", "\nWord", "don't", "a,", "x###", " ", "  ", "<|endoftext|>"]), max_size=20).map("".join)))
def test_chunks_give_the_librarys_ids(text):
    from tokenizers import Tokenizer

    for name, own in CHUNKS.items():
        library = own.tokenizer
        assert isinstance(library, Tokenizer)
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_cache_forgets_without_harm(encode):
    own = Chunks(tokenizer_path(WORD))
    own.size = 3
    text = "one two three four five one two. Three, four one"
    for _ in range(3):
        assert own.ids(text).tolist() == encode(WORD, text)


def test_cache_goes_when_idle(encode, monkeypatch):
    monkeypatch.setattr(tokenizer, "IDLE_SECONDS", 0.05)
    own = Chunks(tokenizer_path(WORD))
    own.ids("some words")
    for _ in range(100):
        if not own:
            break
        time.sleep(0.05)
    assert not own and own.ids("some words").tolist() == encode(WORD, "some words")


def test_counts(spark, docs, rows, empty, encode):
    got = token_counts.count_tokens(docs, tokenizer_path(WORD), limit=100, table_size=8).collect()
    want = sorted((str(d), len((t or "").encode()), len(encode(WORD, t)), len(encode(WORD, t)) > 100) for d, t, *_ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert token_counts.count_tokens(empty, tokenizer_path(WORD)).collect() == []


def test_counts_ignore_other_columns(spark, docs):
    clashing = docs.selectExpr("doc_id", "text", "1 AS n_tokens", "2 AS t", "3 AS n")
    assert token_counts.count_tokens(clashing, tokenizer_path(WORD)).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=50))
def test_values_round_trip(values):
    control, data = token_files.encode_values(np.array(values, dtype=np.uint32))
    assert token_files.decode_values(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**32 - 1)), max_size=12), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_segments_round_trip(parts):
    import io

    ids = [None if k == 2 else k - 1 for k in range(len(parts))]
    raw = token_files.segment(ids, [np.array(p, dtype=np.uint32) for p in parts])
    (found, lengths, values), = token_files.segments(io.BytesIO(raw))
    assert found == ids and lengths.tolist() == [len(p) for p in parts] and values.tolist() == [x for p in parts for x in p]


def test_files(spark, docs, rows, empty, encode, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 500)
    files = token_files.write_token_files(docs, scratch(spark, "t"), tokenizer_path(WORD), end_id=1)
    got = token_files.read_token_files(spark, files, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((d for d, *_ in rows), key=lambda d: (d is not None, d or 0))
    at, texts = 0, {}
    for d, t, *_ in rows:
        texts[d] = encode(WORD, t) + [1]
    for r in got:
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == texts[r.doc_id] and r.n_tokens == len(texts[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(texts[r.doc_id], dtype="<u4").tobytes())
        at += r.n_tokens
    none = token_files.write_token_files(empty, scratch(spark, "t"), tokenizer_path(WORD), end_id=1)
    assert none == [] and token_files.read_token_files(spark, none).collect() == []


def test_files_spread_a_repeated_id(spark, encode):
    same = spark.createDataFrame([(7, f"text {k}") for k in range(200)] + [(9, "last")], "doc_id long, text string").repartition(3)
    files = token_files.write_token_files(same, scratch(spark, "t"), tokenizer_path(WORD), end_id=1)
    assert len(files) > 1
    got = token_files.read_token_files(spark, files).orderBy("start").collect()
    assert [r.doc_id for r in got] == [7] * 200 + [9] and len(got) == 201


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), min_size=1, max_size=12))
def test_plan_uses_every_piece_and_fits(histogram):
    made = packing.plan(histogram, 32)
    used = {}
    for times, taken in made:
        assert sum(n * k for n, k in taken) <= 32
        for n, k in taken:
            used[n] = used.get(n, 0) + times * k
    assert used == histogram
    assert sum(t for t, _ in made) >= -(-sum(n * c for n, c in histogram.items()) // 32)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 30), st.dictionaries(st.integers(1, 15), st.integers(1, 3), max_size=6))
def test_fullest_is_the_fullest(room, left):
    sums = {0}
    for n, c in left.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    taken = packing.fullest(room, left)
    assert sum(n * k for n, k in taken) == max(s for s in sums if s <= room)
    assert all(k <= left[n] for n, k in taken)


def check_packing(got, rows, encode, end_id, capacity):
    want, pieces, bins = {}, {}, {}
    for d, t, *_ in rows:
        want.setdefault(d, []).append(encode(BYTE, t) + [end_id])
    for r in got:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert len(ids) == r.length <= capacity and (r.piece == 0 or r.length == capacity)
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, ids))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, texts in want.items():
        copies = len(texts)
        own = sorted(pieces[d])
        first = [x for k, x in enumerate(own) if k % copies == 0]
        assert len(own) == copies * len(first) and [x for _, _, p in first for x in p] == texts[0]
        assert [s for _, s, _ in first] == [sum(len(p) for _, _, p in first[:k]) for k in range(len(first))]
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing(spark, docs, rows, empty, encode, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 2)
    packed = packing.pack_documents(docs, tokenizer_path(BYTE), end_id=0, capacity=256)
    got = packed.withColumn("crc", packing.ids_crc32(F.col("ids"), packing.id_width(tokenizer_path(BYTE)))).collect()
    assert all(r.crc == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) for r in got)
    bins = check_packing(got, rows, encode, 0, 256)
    total = sum(r.length for r in got)
    assert len(bins) <= 1.01 * -(-total // 256)
    assert packing.pack_documents(empty, tokenizer_path(BYTE)).collect() == []


def test_packing_of_one_length(spark, encode):
    rows = [(k, "the same words in all of them") for k in range(50)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(BYTE), end_id=0, capacity=32).collect()
    size = got[0].length
    assert len(check_packing(got, rows, encode, 0, 32)) == -(-50 // (32 // size))


def test_packing_spreads_a_hot_id(spark, monkeypatch):
    """40,000 rows of one id and of one length are parts of bounded size, and each has its place."""
    hot = spark.range(40_000).selectExpr("cast(null as long) AS doc_id", "0 AS piece", "0L AS start", "3L AS length", "id % 5 AS ids", "'x' AS offset_was")
    placed = packing.pack(hot.repartition(6), 10)
    got = placed.collect()
    assert placed.columns == [*hot.columns, "sequence_id", "offset"] and len({(r.sequence_id, r.offset) for r in got}) == 40_000
    assert max(r.offset for r in got) == 6 and len({r.sequence_id for r in got}) == -(-40_000 // 3)
    keyed = packing.in_rows(hot.repartition(6), "x").withColumn("p", packing.salted(F.lit(40_000), packing.PART_ROWS, "doc_id", "piece", "__row"))
    sizes = [r["count"] for r in keyed.groupBy("p").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 2 * packing.PART_ROWS


def test_files_and_packing_with_clashing_columns(spark, encode):
    rows = [(1, "one two"), (2, "three")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS length", "'b' AS ids", "'c' AS p", "'d' AS t", "'e' AS piece", "'f' AS `__row`")
    assert sorted((r.doc_id, r.length) for r in packing.pack_documents(odd, tokenizer_path(BYTE)).collect()) == [(d, len(encode(BYTE, t)) + 1) for d, t in rows]
    files = token_files.write_token_files(odd, scratch(spark, "t"), tokenizer_path(WORD), end_id=1)
    assert sorted((r.doc_id, r.n_tokens) for r in token_files.read_token_files(spark, files).collect()) == [(d, len(encode(WORD, t)) + 1) for d, t in rows]


def test_long_runs_and_other_scripts(encode):
    own = CHUNKS[BYTE]
    assert own.ranked is not None
    for text in ("a" * 1501, "x " + " " * 1200 + "y", "\n" * 700, "Straße 日本 naïve 🙂 fin", "mot\tfin  <b> l'été ", "a" * 500 + " " + "b" * 500):
        assert own.ids(text).tolist() == encode(BYTE, text)
