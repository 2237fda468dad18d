import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash
from ledgerloom.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, distance=3):
    """Of each (id, fingerprint) the least id reachable, by comparing all."""
    label = list(range(len(fps)))
    moved = True
    while moved:
        moved = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= distance and label[j] < label[i]:
                    label[i], moved = label[j], True
    return label


def test_fingerprints(rows, spark):
    for _, text, *_ in rows:
        if text is None or len(text) < 5000:
            assert simhash.fingerprint(text) == plain_fingerprint(text)
    by_spark = spark.sql("SELECT xxhash64('a b c') AS h").first()[0]
    assert simhash.fingerprint("a B c") == by_spark % (1 << 64)


@pytest.mark.parametrize("blocks,bucket", [(5, 2000), (6, 2000), (5, 2), (7, 1)])
def test_links_find_every_close_pair(spark, blocks, bucket):
    r = random.Random(blocks)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = list(dict.fromkeys(b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(9)))
    nodes = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    found = {r.node: r.root for r in components(simhash.links(nodes, 3, blocks, bucket)).collect()}
    mine = {}
    for f in fps:
        mine.setdefault(found.get(simhash.signed(f), simhash.signed(f)), set()).add(f)
    label, want = groups(fps), {}
    for f, k in zip(fps, label, strict=True):
        want.setdefault(k, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_blocks_grow_with_the_data():
    assert simhash.blocks_for(10) == 5 and simhash.blocks_for(1 << 30) == 6 and simhash.blocks_for(1 << 34) == 7
    assert all(len(simhash.masks(b, 3)) == n for b, n in ((5, 10), (6, 20)))


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (200, 300), (300, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(41)) and all(found[k] == 100 for k in range(100, 160)) and found[300] == found[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates(spark, docs, rows, empty):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    distinct = sorted({(d, simhash.fingerprint(t)) for d, t, *_ in rows if d is not None})
    label = groups([f for _, f in distinct])
    for (d, f), k in zip(distinct, label, strict=True):
        assert got[d, simhash.signed(f)] == distinct[k][0]
    assert got[200, 0] == got[201, 0] == got[202, 0] == 200
    assert simhash.near_duplicates(empty).collect() == []


def test_one_of_each_group_stays(spark, docs, empty):
    odd = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 AS fp", "2 AS n", "3 AS `c0`", "4 AS `a.b`", "5 AS b", "6 AS root")
    kept = simhash.first_of_each_group(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    whole = simhash.near_duplicates(docs).collect()
    assert len(ids) == len(set(ids)) == len({(r.component_id, r.root if r.component_id is None else None) for r in whole})
    assert None in ids and 3 in ids and not {100, 105} & set(ids)
    assert simhash.first_of_each_group(empty).collect() == []


def test_filter_lets_pass_what_is_in_it(spark):
    ids = spark.range(0, 5000, 7).selectExpr("id AS doc_id")
    bits = simhash.filter_bits(ids)
    assert np.count_nonzero(bits) > 0
    passed = {r.id for r in spark.range(5000).where(simhash.maybe_in(bits, F.col("id"))).collect()}
    assert set(range(0, 5000, 7)) <= passed and len(passed) < 800
