"""Toxicity: the automaton against plain edit distance, folds, held-out accuracy, odd rows."""

import random
import zlib

import pyarrow as pa
import pytest

from billweave.llm import toxicity
from billweave.llm.text import text_slices
from billweave.llm.toxicity import Model, Term, Trie, allowed_distance, window_score


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_trie_and_automaton_find_what_edit_distance_finds(seed):
    r = random.Random(seed)
    word = lambda lo, hi: "".join(r.choice("abc") for _ in range(r.randint(lo, hi)))
    terms = [Term(t, r.random() < 0.3, 1.0) for t in {word(3, 10) for _ in range(20)}]
    trie = Trie(terms)
    for _ in range(400):
        w = word(1, 12)
        want = set()
        for number, t in enumerate(terms):
            d = min(distance(t.text, w[:n]) for n in range(len(w) + 1)) if t.stem else distance(t.text, w)
            if d <= allowed_distance(len(t.text), t.stem):
                want.add((number, d))
        assert sorted(trie.matches(w)) == sorted(want)


def test_windows_and_quotes():
    model = Model([Term("x", False, 2.0, 1.0)], quoted=0.5, window=5)
    assert window_score([], model) == 0
    assert window_score([(0, 0, 0, False), (4, 0, 0, False), (9, 0, 0, False)], model) == 4.0
    assert window_score([(0, 0, 1, False), (2, 0, 0, True)], model) == 2.0


def corpus(n=600, seed=5):
    """Every fifth document has one or two bad words, plain or misspelled; a group of copies of one of them."""
    r = random.Random(seed)
    bad, filler = ["scoundrel", "villain", "rascal", "weasel"], ["".join(r.choice("bdfgklmn") + r.choice("aeiou") for _ in range(3)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(filler) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                words[r.randrange(30)] = r.choice(bad)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    for i in range(n, n + 60):
        docs.append((i, docs[0][1]))
        labels.append((i, 1))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_misspellings(spark):
    docs, labels = corpus()
    docs += [(5000, "bado dobu scoundrrel fana velain"), (5001, 'she wrote "scoundrel" once'), (5002, None), (5003, "")]
    rows = {r["doc_id"]: r for r in toxicity.toxicity_report(*frames(spark, docs, labels)).collect()}
    assert len(rows) == len(docs)
    for i, label in labels:
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert rows[i]["predicted"] == label
    assert rows[5000]["predicted"] == 1 and rows[5001]["score"] < rows[5]["score"]
    assert rows[5002]["predicted"] == rows[5003]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in rows.values())


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(200)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a = toxicity.toxicity_report(*frames(spark, docs, labels)).orderBy("doc_id").collect()
    b = toxicity.toxicity_report(*frames(spark, docs, turned)).orderBy("doc_id").collect()
    assert a == b


def test_copies_do_not_make_terms(spark):
    docs, labels = corpus()
    sample = toxicity.training_sample(*frames(spark, docs, labels))
    assert {t.text for t in toxicity.learn_lexicon(sample)} == {"scoundrel", "villain", "rascal", "weasel"}


def test_no_labels_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 2.0), (1, "a", 2.0), (None, None, None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.toxicity_report(docs, labels).collect()] == [0, 0, 0]
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() == 3
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0


def test_quotation_over_a_whole_line():
    """Marks count wherever they stand on the line of a hit, and only there."""
    far = "word " * 200
    texts = [
        f'he said "{far}villain {far}" and left',
        f'"{far}" villain "{far}"',
        f'"{far}\n villain "',
        f'"a" «{far}" villain {far}» b',
        f"„{far}\nno “villain {far}” villain",
        "no marks, villain",
        f'"{far} villain',
    ]
    part = next(text_slices([pa.RecordBatch.from_pydict({"text": texts})], "text"))
    found = toxicity.hits_of(part, toxicity.Matcher([Term("villain", False, 1.0)]))
    assert [[h[3] for h in row if h[2] == 0] for row in found] == [[True], [False], [False], [True], [False], [False], [False]]
