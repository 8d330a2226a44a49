"""Perfect hashes on their own, and groups against a dictionary of texts."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from billweave.llm import exact_dedup
from billweave.llm.exact_dedup import PerfectHash

SCHEMA = "doc_id long, text string, digest string, row long, known string, size int"


@pytest.mark.parametrize("n", [1, 2, 3, 100, 5000])
def test_perfect_hash(n):
    r = np.random.default_rng(n)
    words = r.integers(0, 1 << 63, (n, 4)).astype(np.uint64)
    words[: n // 2, :3] = 7  # digests that differ in their last bytes only
    table = PerfectHash.over(words)
    assert sorted(table.slots(words)) == list(range(n))
    again = PerfectHash.of(table.sizes, np.unpackbits(np.packbits(table.bits), count=len(table.bits)).astype(bool))
    assert (again.slots(words) == table.slots(words)).all()
    strangers = table.slots(r.integers(0, 1 << 63, (1000, 4)).astype(np.uint64))
    assert strangers.min() >= -1 and strangers.max() < n
    if n > 1:
        with pytest.raises(ValueError):
            PerfectHash.over(words[[0, 1, 0]])


def test_empty_hash():
    assert PerfectHash.over(np.empty((0, 4), np.uint64)).slots(np.ones((3, 4), np.uint64)).tolist() == [-1] * 3


def corpus():
    r = random.Random(3)
    rows = [(i, f"text {int(r.expovariate(0.02))}") for i in range(800)] + [(1000 + i, "the same") for i in range(400)]
    return rows + [(None, "text 1"), (None, "only without id"), (None, "only without id"), (5000, None), (5001, ""), (None, None), (7, "twice"), (7, "twice"), (8, "Twice"), (9, "é" * 700_000), (10, "é" * 700_000)]


@pytest.mark.parametrize("historical", [None, "true", "false", "cast(null as boolean)", "doc_id < 1100"])
def test_groups(spark, historical):
    rows = corpus()
    r = random.Random(1)
    r.shuffle(rows)
    docs = spark.createDataFrame([(*x, "d", 1, "k", 2) for x in rows], SCHEMA).repartition(5)
    got = exact_dedup.exact_groups(docs, historical=historical and F.expr(historical), digests_a_bucket=37).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted(((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got), key=repr) == want
    # one row a group stays, and it is one with the id that stays
    kept = [g for g in got if g.kept]
    assert len(kept) == len({g.text_sha256 for g in kept}) == len(groups) and all(g.doc_id == g.keep_id for g in kept)
    known = {g.text_sha256 for g in got if g.historical}
    assert all(g.known == (g.text_sha256 in known) for g in got)


def test_empty_table(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_slots_hold_digests_and_locators(spark):
    docs = spark.createDataFrame([(i, f"t{i % 50}", "", 0, "", 0) for i in range(200)], SCHEMA)
    rows = exact_dedup.digest_rows(docs, F.lit(True))
    index = exact_dedup.build_index(exact_dedup.groups_of(rows), 3).collect()
    assert sum(len(b.keep_id) for b in index) == 50 and len(index) == 3
    for b in index:
        for slot, (keep, size) in enumerate(zip(b.keep_id, b.size)):
            assert bytes(b.digests[32 * slot : 32 * slot + 32]) == hashlib.sha256(f"t{keep % 50}".encode()).digest()
            assert keep >= 150 and size == 4
