import zlib

import numpy as np

import corpus_pipeline
from ledgerloom.llm import langid, mixing, packing, queries, quality, simhash
from tests.llm.test_simhash import groups
from tests.llm.test_tokens import BYTE, CHUNKS, check_packing  # noqa: F401


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "mix_sources", "pack"]
    assert [n for n in queries.QUERIES if not n.startswith("op")] == []
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    net = langid.fit(docs)
    told = {(r.doc_id, r.text): r.p for r in docs.withColumn("p", langid.predicted(docs, net)).collect()}
    judged = {(r.doc_id, r.text): r.quality for r in quality.judged(docs).collect()}
    kept = [(r, judged[r[0], r[1]].clean_text) for r in rows if told[r[0], r[1]].lang_pred != "und" and told[r[0], r[1]].score >= 0.3 and judged[r[0], r[1]].kept]
    named = sorted({(r[0], text) for r, text in kept}, key=lambda x: (x[0] is None, x[0] or 0))
    label = groups([simhash.fingerprint(t) for _, t in named])
    stay = {named[k] for k in set(label)}
    assert 20 < len(stay) < len(named)
    want = {d: CHUNKS[BYTE].ids(t).tolist() + [0] for d, t in stay}
    assert {r.doc_id for r in got} == set(want)
    for d, ids in want.items():
        pieces = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == d)
        assert sum(n for *_, n in pieces) == len(ids) and [s for _, s, _ in pieces] == np.cumsum([0] + [n for *_, n in pieces])[:-1].tolist()
    bins = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(bins) == list(range(len(bins)))
    for spans in bins.values():
        assert [o for o, _ in sorted(spans)] == np.cumsum([0] + [n for _, n in sorted(spans)])[:-1].tolist() and sum(n for _, n in spans) <= 2048


def test_a_row_without_an_id_lives_to_the_end(spark, docs, tmp_path):
    long = docs.where("doc_id = 40").selectExpr("cast(null as long) AS doc_id", "reverse(text) || ' Ende.' AS text", "lang", "source", "n_chars")
    kept = docs.where("doc_id BETWEEN 30 AND 50").selectExpr("doc_id", "text", "lang", "source", "n_chars").unionByName(long.selectExpr("doc_id", "concat_ws(' ', 'A text of its own.', text) AS text", "lang", "source", "n_chars"))
    mixed = corpus_pipeline.mix_sources(spark, kept, "")
    mixed.write.parquet(f"{tmp_path}/m")
    got = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/m"), "").collect()
    assert len({r.doc_id for r in got}) == kept.count() and any(r.doc_id is None for r in got)


def test_stages_keep_the_columns(spark, docs, tmp_path):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 AS score", "'x' AS `block`")
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns


def test_stages_on_nothing(spark, empty, tmp_path):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def test_mixture_takes_effect(spark, docs, tmp_path, monkeypatch):
    docs.where("doc_id < 90").write.parquet(f"{tmp_path}/documents.parquet")
    stages = corpus_pipeline.STAGES
    found = []
    for weights in ({"big": 9.0}, {"big": 1.0}):
        full = {s: weights.get(s, 1.0) for s in ("big", *(f"s{k}" for k in range(5)))}
        mix = lambda s, d, sf, w=full: mixing.mixed(d, block_rows=2, weights=w)
        monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, mix if n == "mix_sources" else f) for n, f in stages])
        found.append({(r.doc_id, r.piece, r.length): (r.sequence_id, r.offset) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()})
    assert found[0].keys() == found[1].keys() and found[0] != found[1]


def test_sequences_follow_the_order(spark, tmp_path):
    rows = [(997 * k % 1000, f"{k} {'word ' * (k % 50 * 3)}") for k in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    pieces = packing.tokenized(packing.in_place(docs), corpus_pipeline.tokenizer_path("byte_bpe_50k.json"), 0, 256, place="place").cache()
    got = packing.pack_in_order(pieces, 256).collect()
    check = {}
    for r in got:
        check.setdefault(r.sequence_id, []).append(r)
    first = [min((r.place, r.piece) for r in check[k]) for k in range(len(check))]
    assert first == sorted(first) and len({r.place for r in got}) == 1000
    for rs in check.values():
        assert sum(r.length for r in rs) <= 256 and [r.offset for r in sorted(rs, key=lambda r: r.offset)] == np.cumsum([0] + [r.length for r in sorted(rs, key=lambda r: r.offset)])[:-1].tolist()
    names = sorted({r[0] for r in docs.select("_metadata.file_path").collect()})
    order = {r[0]: (names.index(r[1]), r[2]) for r in docs.select("doc_id", "_metadata.file_path", "_metadata.row_index").collect()}
    assert sorted(order, key=order.get) == [d for _, d in sorted({(r.place, r.doc_id) for r in got})]
