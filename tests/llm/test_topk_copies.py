"""Copies of query blocks: few, narrow, and never sent through the driver."""

import random

import numpy as np

from billweave.llm import topk


def test_copies_are_merged_and_not_broadcast(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) * 2.0 ** (i % 3 * 8) for _ in range(3)]) for i in range(300)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, query_every=50, block_rows=16, scale=16)
    assert "strategy=merge" in str(found._jdf.queryExecution().optimizedPlan())
    ints = [[int(np.floor(16 * x)) for x in v] for _, v in rows]
    want = []
    for q in range(0, 300, 50):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in enumerate(ints) if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, found.collect())) == want


def test_blocks_are_as_narrow_as_their_integers():
    for most, width in ((127, 1), (-128, 1), (128, 2), (-(2**15) - 1, 4), (2**31, 8), (0, 1)):
        values = np.array([[most, 1, 0], [0, -1, most]], np.int64)
        packed = np.frombuffer(topk._narrow(values).tobytes(), np.uint8)
        assert len(packed) == 6 * width
        assert topk._matrix(packed, 2, 3).tolist() == values.tolist()
    assert topk._matrix(np.empty(0, np.uint8), 4, 0).shape == (4, 0)
