"""Sharding, archives and top-k search against plain versions; queries against their SQL."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from billweave.llm import sharding, topk, warc
from billweave.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# ---- sharding


def placed(spark, docs, **options):
    return sharding.assign_shards(spark.createDataFrame(docs, "doc_id long, text string, shard string"), **options).collect()


def test_shards(spark):
    docs = [(i, f"té{i % 7}" * (i % 5), "x") for i in range(4000)] + [(5, "twin", "x"), (None, None, None)]
    rows = placed(spark, docs)
    assert len(rows) == len(docs) and {r.law for r in rows} == {"key"}
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert set(by_shard) == set(range(8)) and all(400 < len(v) < 600 for v in by_shard.values())
    assert 330 < sum(r.grown_shard == 8 for r in rows) < 560
    facts = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert facts == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in docs)
    assert {r.doc_id: r.shard for r in placed(spark, docs[:50])} == {r.doc_id: r.shard for r in rows if r.doc_id is not None and r.doc_id < 50}
    assert placed(spark, []) == []


def test_weights_and_confined_movement(spark):
    keys = spark.range(6000)
    tree = sharding.Node("root", tuple(sharding.Node(f"r{r}", tuple(sharding.Node(f"r{r}/s{s}", shard=4 * r + s, own_weight=1.0 + s) for s in range(4))) for r in range(2)))
    lighter = sharding.Node("root", (tree.children[0], sharding.Node("r1", tuple(sharding.Node(c.name, shard=c.shard, own_weight=0.5 if c.shard == 5 else c.own_weight) for c in tree.children[1].children))))
    rows = keys.select(sharding.place(keys.id, tree).alias("a"), sharding.place(keys.id, lighter).alias("b")).collect()
    share = Counter(r.a for r in rows)
    assert all(abs(share[4 * g + s] / 6000 - (1 + s) / 20) < 0.02 for g in range(2) for s in range(4))
    # only the subtree whose weights changed gives keys away or deals them anew
    assert all(r.a == r.b for r in rows if r.a < 4) and any(r.a != r.b for r in rows)


# ---- archives


def test_archive_round_trip(spark):
    r = random.Random(2)
    pages = []
    for i in range(60):
        body = r.choice(["", "short", "x" * 999, "y" * 1000, "WARC/1.1\r\n\r\n" * 100, "é" * 600, None])
        pages.append((i, f"http://h/{i}\r\nX: 1" if i % 2 else None, body, "extra"))
    pages += [(3, "u", pages[3][2], "again"), (None, "u", "y" * 1000, None)]
    rows = warc.archived(spark.createDataFrame(pages, "page_id long, url string, html string, payload string")).collect()
    last = {}
    for i, _, body, _ in pages:
        if len((body or "").encode()) >= 1000 and i is not None:
            last[body] = max(i, last.get(body, i))
    want = []
    for i, _, body, _ in pages:
        original = last.get(body)
        revisit = original is not None and i != original
        want.append((i, len((body or "").encode()), hashlib.sha1((body or "").encode()).hexdigest(), "revisit" if revisit else "response", original if revisit else None, None if revisit else (body or "")))
    got = [(x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to, x.payload) for x in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    ids = {x.page_id: x.record_id for x in rows}
    assert all(x.refers_to_record == ids[x.refers_to] for x in rows if x.record_type == "revisit")
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- search


@pytest.mark.parametrize(("seed", "block"), [(1, 7), (2, 64), (3, 4096)])
def test_top_k_equals_all_products(spark, seed, block):
    r = random.Random(seed)
    axis = [r.gauss(0, 1) for _ in range(6)]
    rows = []
    for i in range(400):
        scale = 2.0 ** r.randrange(-6, 4)
        base = axis if i % 3 == 0 else [0.0] * 6
        rows.append((i, [scale * (b + r.gauss(0, 0.1 if i % 3 == 0 else 1)) for b in base], i))
    rows += [(400, None, 0), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (402, [float("nan")] * 6, 0), (403, [float("inf")] * 6, 0)]
    rows += [(450, [3.0, 4.0], 0), (451, [1.0, 1.0], 0), (500, [], 0), (550, [0.0] * 6, 0), (1, rows[1][1], 9), (None, rows[2][1], 0)]
    # rows of one id with vectors of their own, one of them a query; vectors that are long, but whose products a long holds
    rows += [(7, [9.0, -9.0, 3.0, 0.0, 1.0, 2.0], 0), (50, [-1.0, 2.0, 0.5, 0.0, -3.0, 1.0], 0), (600, [2.0**49, 1.0, -1.0], 0), (601, [1.0, 2.0**40, 3.0], 0), (602, [-1.0, 2.0**20, 2.0**43], 0)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"), k=5, query_every=50, block_rows=block)
    import numpy as np

    vectors = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in vectors if i % 50 == 0}):
        scores = sorted((-sum(x * y for x, y in zip(a, b)), c) for i, a in vectors if i == q for c, b in vectors if c != q and len(a) == len(b))[:5]
        want += [(q, k, c, -s) for k, (s, c) in enumerate(scores, 1)]
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


@pytest.mark.parametrize("rows", [[(0, [1e30, 0.0]), (1, [1.0, 1.0])], [(0, [1e17, 0.0]), (1, [1e17, 2.0])]])
def test_products_beyond_a_long_are_an_error(spark, rows):
    with pytest.raises(Exception, match="leaves the range of a long"):
        topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- registered queries


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_rows_of_one_id_stand_in_many_slot_blocks(spark):
    """One id over many texts is no single run of slots, and copies of one row have a slot each."""
    rows = [(7, f"text {i}") for i in range(300)] + [(i, "x") for i in range(1000, 2200)] + [(None, "same")] * 5000
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=1, slot_blocks=64).collect()
    assert sorted(r.slot for r in got) == list(range(len(rows)))
    assert sorted((r.doc_id or -1, r.text_crc32, r.size) for r in got) == sorted((i or -1, zlib.crc32(t.encode()), len(t) + 1) for i, t in rows)
    of_id = sorted(r.slot for r in got if r.doc_id == 7)
    assert sum(b - a > 1 for a, b in zip(of_id, of_id[1:])) > 30
