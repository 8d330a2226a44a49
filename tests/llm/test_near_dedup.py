"""Near duplicates against all pairs of full sets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from billweave.llm import near_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            common = len(a & b)
            if common and 100 * common >= 75 * (len(a) + len(b) - common):
                root[find(i)] = find(j)
    name = lambda k: float("inf") if docs[k][0] is None else docs[k][0]
    least = {}
    for i in range(len(docs)):
        least[find(i)] = min(name(i), least.get(find(i), float("inf")))
    out = []
    for i, (doc, _) in enumerate(docs):
        c = least[find(i)]
        c = None if c == float("inf") else c
        out.append((doc, len(sets[i]), c, doc == c))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    docs, n = [], 0
    shared = text(40)
    for _ in range(25):
        base = text(r.randrange(3, 120))
        if r.random() < 0.4:
            base[:0] = shared
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = r.choice(words)
            docs.append((n, " ".join(w)))
            n += 1
            if r.random() < 0.4:  # a chain: the next one starts from this one
                base = w
    r.shuffle(docs)
    return docs + [(900, None), (901, ""), (902, "Two Words"), (903, "two  words"), (904, docs[0][1].upper()), (None, docs[1][1]), (None, "only here " * 9), (5, docs[5][1]), (6, "x y z " * 20)]


def report(spark, docs):
    rows = near_dedup.component_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    return sorted([tuple(r) for r in rows], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    docs = corpus(seed)
    assert report(spark, docs) == expected(docs)


def test_lists_of_several_blocks_and_shares(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "PIVOT_SHARE", 2)
    docs = corpus(11)
    assert report(spark, docs) == expected(docs)


@pytest.mark.parametrize("shingles", [150, 2_000_000])
def test_long_lists_meet_by_their_sets(spark, monkeypatch, shingles):
    monkeypatch.setattr(near_dedup, "LONG_LIST", 1)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    for seed in (1, 11):
        docs = corpus(seed)
        assert report(spark, docs) == expected(docs)


def test_many_copies_just_below_the_threshold(spark):
    """Copies of one text that are less alike than linked ones: no pair of them leaves a task, the few links do."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for n in range(300):
        words = list(base)
        for k in range(2 if n % 60 == 0 else 4):
            words[r.randrange(5, 115)] = f"x{n}-{k}"
        docs.append((n, " ".join(words)))
    assert report(spark, docs) == expected(docs)


def test_second_round_finds_what_first_classes_do_not(spark):
    """Two lists' first class is unlike both members of a similar pair."""
    base = [f"w{i}" for i in range(100)]
    docs = [(1, " ".join([*base[:70], *[f"a{i}" for i in range(30)]]))]
    docs += [(2 + k, " ".join([*base[:95], *[f"b{k}{i}" for i in range(3)]])) for k in range(4)]
    assert report(spark, docs) == expected(docs)


def test_components_of_any_links(spark):
    r = random.Random(3)
    links = [(r.randrange(120), r.randrange(120)) for _ in range(90)]
    root = list(range(120))
    for _ in range(120):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    node = lambda c: F.struct(F.col(c).alias("doc"), F.lit(0).alias("key"))
    df = spark.createDataFrame([x for x in links if x[0] != x[1]], "a long, b long").select(node("a").alias("node"), node("b").alias("target"))
    got = {r["node"]["doc"]: r["component"]["doc"] for r in near_dedup.star_components(df).collect()}
    assert got and all(root[v] == c for v, c in got.items())
    assert {v for v in range(120) if root[v] != v} == set(got)


def test_one_of_each_and_empty(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", 1, "x"), (1, "A b c d e f", 2, None), (1, "A b c d e f", 2, None), (3, None, 3, "z"), (3, None, 3, "z"), (4, "", 4, "")], "doc_id long, text string, doc int, key string")
    out = near_dedup.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 3, 4]
    assert near_dedup.component_report(docs.limit(0)).count() == 0
