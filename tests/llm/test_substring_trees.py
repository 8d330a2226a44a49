"""Word windows of earlier documents against a search of every window."""

import hashlib
import random
import re

import pytest

from billweave.llm import substring_trees

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(docs, window):
    last = 1 << 63
    order = [(last if i is None else i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in order:
        for k in range(len(w) - window + 1):
            f = tuple(w[k : k + window])
            first[f] = min(i, first.get(f, last + 1))
    out = []
    for (doc, _), (i, w) in zip(docs, order):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: [r.choice(["a", "b", "c", "dé", "e f"]) for _ in range(n)]
    passages = [text(r.randrange(5, 60)) for _ in range(6)]
    docs = []
    for i in range(80):
        words = text(r.randrange(30))
        for _ in range(r.randrange(4)):
            p = list(r.choice(passages))
            if r.random() < 0.5:
                p[r.randrange(len(p))] = "X"
            words += p + text(r.randrange(6))
        docs.append((i, r.choice([" ", "\n ", "\t"]).join(words)))
    docs += [(100 + i, docs[3][1]) for i in range(20)]
    near = text(70)
    for i in range(40):
        words = list(near)
        words[r.randrange(70)] = f"n{i}"
        docs.append((200 + i, " ".join(words)))
    return docs + [(300, None), (301, " \n"), (302, "a " * 100), (-5, "a " * 30), (None, docs[3][1]), (None, docs[3][1]), (7, docs[7][1]), (7, "q " + docs[8][1])]


def report(spark, docs, **options):
    rows = substring_trees.removal_report(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()
    return sorted([tuple(r) for r in rows], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_equals_search(spark, seed):
    docs = corpus(seed)
    assert report(spark, docs) == expected(docs, 13)


def test_long_prefixes_and_big_groups(spark, monkeypatch):
    docs = corpus(7)
    every = substring_trees.suffixes(spark.createDataFrame([(i or 0, 0, t or "") for i, t in docs], "doc long, key int, text string")).select("prefix").distinct()
    some = [r["prefix"] for r in every.where("prefix % 2 = 0").collect()]
    monkeypatch.setattr(substring_trees, "frequent_prefixes", lambda *a: some)
    assert report(spark, docs, big_group=2) == expected(docs, 13)


def test_sample_finds_a_frequent_prefix(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, 0, text) for i in range(400)], "doc long, key int, text string")
    assert len(substring_trees.frequent_prefixes(docs, 13, 8, sample_one_in=1)) >= 3


def test_empty_table_other_columns_and_a_very_long_text(spark):
    assert report(spark, []) == []
    long = " ".join(str(i) for i in range(300_000))
    docs = spark.createDataFrame([(1, "0 " + long, 5, "a"), (2, long, 6, None), (3, None, 7, "c")], "doc_id long, text string, doc int, spans string")
    out = substring_trees.without_later_windows(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert rows[2] == (2, "", 6, None) and rows[3] == (3, None, 7, "c") and rows[1][1] == "0 " + long
