"""Contamination against a word-by-word search."""

import hashlib
import random
import re

import numpy as np
import pytest

from billweave.llm.decontaminate import FMIndex, contaminated_spans, contamination_report, decontaminated

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def expected(docs, items, window=13):
    phrases = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(item)
    widths = {len(p) for p in phrases}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for width in widths:
            for i in range(len(w) - width + 1):
                owners = phrases.get(tuple(w[i : i + width]))
                if owners:
                    hit.update(range(i, i + width))
                    found |= owners
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def report(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination_report(d, b, **options).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted([tuple(r) for r in rows], key=repr)


def random_case(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "ä", "Ω", "x1", "The"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 13, 20, 40]))) for i in range(12)] + [(None, text(15)), (3, text(14)), (50, ""), (51, None)]
    docs = []
    for i in range(40):
        parts = [text(r.choice([0, 2, 30]))]
        for _ in range(r.randrange(3)):
            parts += [r.choice(items)[1] or "", text(r.choice([0, 5]))]
        docs.append((i, r.choice([" ", "\n", "-"]).join(parts)))
    return docs + [(100, None), (101, ""), (102, " .,;"), (None, items[3][1]), (7, docs[7][1])], items


@pytest.mark.parametrize("seed", range(4))
def test_equals_search_by_words(spark, seed):
    docs, items = random_case(seed)
    assert report(spark, docs, items) == expected(docs, items)


def test_blocks_of_the_benchmark_merge(spark):
    docs, items = random_case(9)
    assert report(spark, docs, items, block_words=20) == expected(docs, items)


def test_nothing_to_find(spark):
    docs, _ = random_case(1)
    assert report(spark, docs, []) == expected(docs, [])
    assert report(spark, [], [(1, "a b")]) == []
    assert report(spark, docs, [(1, None), (2, "...")]) == expected(docs, [])


def test_a_very_long_text_and_clashing_columns(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    text = "filler " * 200_000 + passage
    docs = spark.createDataFrame([(1, text, 5, "x"), (2, passage, 6, None)], "doc_id long, text string, n_words int, spans string")
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    rows = {r["doc_id"]: r for r in contaminated_spans(docs, items).collect()}
    assert [(s["start"], s["stop"]) for s in rows[1]["_spans"]] == [(200_000, 200_020)] and rows[1]["n_words"] == 5
    left = decontaminated(docs, items)
    assert left.columns == docs.columns and [tuple(r)[2:] for r in left.collect()] == [(5, "x")]


@pytest.mark.parametrize("seed", range(5))
def test_index_counts_and_locates(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 4, rng.integers(1, 300))
    index = FMIndex(text, sample_every=5)
    for width in (1, 2, 5):
        patterns = rng.integers(0, 5, (30, width))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text) - width + 1) if (text[i : i + width] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
