"""Vectors whose components are long, but whose products a long holds."""

from billweave.llm import topk


def test_long_products_are_exact(spark):
    rows = [(600, [2.0**46, 1.0, -1.0]), (601, [1.0, 2.0**40, 3.0]), (602, [-1.0, 2.0**20, 2.0**43])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5, query_every=50, block_rows=64)
    ints = {i: [int(256 * x) for x in v] for i, v in rows}
    score = {i: sum(x * y for x, y in zip(ints[600], ints[i])) for i in (601, 602)}
    assert [tuple(r) for r in got.collect()] == [(600, 1, 601, score[601]), (600, 2, 602, score[602])]
