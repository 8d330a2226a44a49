"""Repeated byte strings against a count of every string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from billweave.llm import suffix_array
from billweave.llm.text import sliding_argmin


def expected(docs, length):
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(docs, data):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((doc, len(d), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, length):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    passages = [text(r.randrange(length // 2, 3 * length)) for _ in range(5)]
    docs = []
    for i in range(60):
        parts = [text(r.randrange(2 * length))]
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            cut = r.randrange(len(p))
            parts += [p if r.random() < 0.5 else p[cut:] if r.random() < 0.5 else p[:cut] + "X" + p[cut + 1 :], text(r.randrange(length))]
        docs.append((i, "".join(parts)))
    docs += [(100 + i, docs[3][1]) for i in range(20)]  # exact copies
    near = text(6 * length)
    docs += [(200 + i, near[:k] + "#" + str(i) + near[k:]) for i, k in enumerate(r.randrange(len(near)) for _ in range(30))]
    docs += [(300, None), (301, ""), (302, "ab" * length), (303, "z" * (3 * length)), (304, text(length)), (None, docs[5][1]), (None, None), (7, docs[7][1]), (7, "other " + docs[8][1])]
    return docs


def report(spark, docs, **options):
    rows = suffix_array.removal_report(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()
    return sorted([tuple(r) for r in rows], key=repr)


@pytest.mark.parametrize(("seed", "length"), [(1, 64), (2, 80), (3, 100)])
def test_equals_counting(spark, seed, length):
    docs = corpus(seed, length)
    assert report(spark, docs, length=length) == expected(docs, length)


def test_big_groups_are_settled_string_by_string(spark):
    docs = corpus(4, 64)
    assert report(spark, docs, length=64, big_group=2) == expected(docs, 64)


def test_one_string_in_all_ranges(spark):
    """Copies fill several ranges of the sorted suffixes, so that groups cross their edges."""
    text = "".join(random.Random(1).choice("abcdef") for _ in range(300))
    docs = [(i, text) for i in range(200)] + [(1000, text[50:250]), (1001, "q" + text[10:130] + "w" * 50)]
    assert report(spark, docs, length=64) == expected(docs, 64)


def test_empty_table_and_clashing_columns(spark):
    assert report(spark, []) == []
    docs = spark.createDataFrame([(1, "é" * 300, 5, "a"), (2, "x" + "é" * 300, 6, None), (3, None, 7, "c")], "doc_id long, text string, doc int, row string")
    out = suffix_array.without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted([tuple(r) for r in out.collect()], key=repr) == [(1, "", 5, "a"), (2, "x", 6, None), (3, None, 7, "c")]


def test_sliding_argmin():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 30, 500).astype(np.uint64) << np.uint64(30)
    for width in (1, 2, 7, 64, 100):
        want = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
        assert sliding_argmin(values, width).tolist() == want


def test_multikey_order():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 4, 1000) for _ in range(4)]
    order = suffix_array.multikey_order(keys)
    rows = list(zip(*[k[order].tolist() for k in keys]))
    assert rows == sorted(rows)
