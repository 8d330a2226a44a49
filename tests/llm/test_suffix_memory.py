"""What a task of the suffix array holds follows from the data it is dealt, not from the session's partitions alone."""

import random

import numpy as np
import pyarrow as pa

from billweave.llm import suffix_array

LENGTH = 70


def _around(groups, per_group, seed=3):
    """Batches of strings around anchors, sorted by group; some rows of a group share a passage."""
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        passage = "".join(r.choice("abcdef") for _ in range(LENGTH + 20))
        for i in range(per_group):
            text = passage if r.random() < 0.5 else "".join(r.choice("abcdef") for _ in range(LENGTH + 20))
            rows.append((g // 3, g % 3, 100 * g + i, 5, 60, 10, 30, r.random() < 0.7, text.encode()))
    names = [c.split()[0] for c in suffix_array._AROUND.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    for at in range(0, len(rows), 17):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 17]), kinds)], names=names)


def test_groups_are_compared_as_they_come(monkeypatch):
    compared, sizes = suffix_array._matched_groups, []

    def seen(parts, length):
        sizes.append(sum(map(suffix_array._count_strings, parts)))
        return compared(parts, length)

    monkeypatch.setattr(suffix_array, "_matched_groups", seen)
    found = lambda most: sorted(tuple(r.values()) for b in suffix_array._matched(_around(40, 9), LENGTH, most) for r in b.to_pylist())
    at_once = found(10**9)
    assert at_once and len(sizes) == 1
    sizes.clear()
    assert found(400) == at_once
    assert len(sizes) > 10 and max(sizes) <= 400 + 17 * 21 + 9 * 21
    sizes.clear()
    assert found(1) == at_once  # a group is never torn


def test_large_inputs_get_more_partitions(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"text {i} " * 50) for i in range(400)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert suffix_array._partitions(docs) == few
    monkeypatch.setattr(suffix_array, "_PARTITION_BYTES", 300)
    assert suffix_array._partitions(docs) > few
    keyed = docs.selectExpr("doc_id as doc", "1 as key", "text")
    plan = suffix_array.repeated_spans(keyed, LENGTH, 20)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert f", {suffix_array._partitions(keyed)}" in plan
    assert np.isfinite(suffix_array._partitions(spark.createDataFrame([], "doc long")))
