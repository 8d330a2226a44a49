"""Suffix tree scores: unigram figures word by word, distributions that sum to one, states by hand, gain on held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from billweave.llm import suffix_tree_lm as lm
from billweave.session import cut_lineage

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed, n=300):
    """Words alternate between two groups, so the word before tells the group of the next."""
    r = random.Random(seed)
    groups = [[f"{c}{i}" for i in range(30)] for c in "ab"]
    texts = []
    for _ in range(n):
        side = r.randrange(2)
        words = [r.choice(groups[(side + k) % 2]) if r.random() < 0.9 else f"Rare{r.randrange(5000)}" for k in range(r.randrange(40))]
        texts.append(" ".join(words))
    return list(enumerate(texts)) + [(9001, None), (9002, " \t\n"), (9003, "é" * 3 + "\x00x"), (None, "a1 b2"), (5, texts[5])]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.fixture(scope="module")
def scored(spark):
    docs = corpus(1)
    return docs, lm.score_documents(frame(spark, docs)).collect()


def test_unigram_figures(scored):
    docs, rows = scored
    tokens = lambda t: [*WORD.findall((t or "").lower().encode()), None]  # noqa: E731 - only ASCII letters have capitals here
    counts = Counter(w for i, t in docs if not is_held_out(i) for w in tokens(t))
    n, below = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    want = sorted(((i, is_held_out(i), len(tokens(t)), sum(w in counts for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / below) for w in tokens(t))) for i, t in docs), key=repr)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=repr)
    assert [w[:5] for w in want] == [g[:5] for g in got]
    assert np.allclose([w[5] for w in want], [g[5] for g in got])


def test_better_than_unigrams_on_held_out_texts(scored):
    rows = [r for r in scored[1] if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(r.score < 0 for r in scored[1])


def test_tree_by_hand(spark):
    docs = frame(spark, corpus(2)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lm.held_out(F.col("doc_id")).alias("held_out"))
    words = cut_lineage(lm.word_counts(docs))
    alphabet = lm.alphabet_of(words, 6000, 0.002)
    tree = lm.learn_tree(cut_lineage(lm.encoded(docs, alphabet)), alphabet, share=0.002, divergence=5.0)
    assert np.allclose((10 ** tree.log_p.astype(float)).sum(axis=1), 1, atol=1e-4)
    assert len(tree.log_p) > 10
    # the longest context that is in the tree, symbol by symbol
    symbols = np.array([alphabet.begin, 0, 1, 2, 0, 1, alphabet.end, alphabet.begin, 3, alphabet.end])
    place = np.flatnonzero(symbols != alphabet.begin)
    for p, got in zip(place, tree.score(symbols, place, alphabet.begin)):
        node = 0
        for j in range(1, tree.depth + 1):
            if tree.child[node, symbols[p - j]] < 0:
                break
            node = tree.child[node, symbols[p - j]]
            if symbols[p - j] == alphabet.begin:
                break
        assert got == pytest.approx(float(tree.log_p[tree.state[node], symbols[p]]))


def test_shares_of_a_symbol_sum_to_one(spark):
    docs = frame(spark, corpus(3)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lm.held_out(F.col("doc_id")).alias("held_out"))
    words = cut_lineage(lm.word_counts(docs))
    alphabet = lm.alphabet_of(words, 6000, 0.05)
    values = lm.word_values(words, alphabet, 1000).join(words.select("hash", "ending"), "hash").toPandas()
    symbol = alphabet.encode(values["hash"].to_numpy().view(np.uint64), values["ending"].to_numpy())
    for s in np.unique(symbol):
        own = values[symbol == s]
        known, new = own[own["count"] > 0], own[own["count"] == 0]
        unmet = 10 ** new["log_p"].iloc[0] if len(new) else lm.DISCOUNT * len(known) / known["count"].sum()
        assert (10 ** known["log_p"]).sum() + (unmet if s >= len(alphabet.words) else 0) == pytest.approx(1)


def test_empty_and_untrained(spark):
    assert lm.score_documents(frame(spark, [])).count() == 0
    only = [i for i in range(200) if is_held_out(i)][:3]
    rows = lm.score_documents(frame(spark, [(i, "some words") for i in only])).collect()
    assert len(rows) == 3 and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)


def test_contexts_of_words_by_count(spark):
    """A pair of rare words is a context wherever it was met often enough, whatever its share of the corpus."""
    docs = corpus(4, 400) + [(20000 + k, f"{'zig' if k % 2 else 'zag'} odd pair {'left' if k % 2 else 'right'}") for k in range(120)]
    kwargs = {"symbol_share": 0.05, "context_share": 0.05}
    few, many = [{r.doc_id: r.score for r in lm.score_documents(frame(spark, docs), **kwargs, **more).collect() if r.doc_id and r.doc_id >= 20000 and r.held_out} for more in ({"max_depth": 2}, {})]
    # the words before 'pair' are the same; only the third one back tells left from right
    assert len(few) > 5 and all(many[i] > few[i] + 0.1 for i in few)


def test_word_scores_by_hand(spark):
    """Every token's chain of retained contexts, from counts of the texts themselves."""
    docs = corpus(5, 200)
    docs = [(i, t if i is None or i > 9000 else re.sub("é", "e", t)) for i, t in docs]
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.score_documents(frame(spark, docs), symbol_share=0.9, context_share=0.9, max_depth=2, divergence=5.0).collect()}
    token = lambda t: [w.lower() for w in WORD.findall((t or "").encode())]
    texts = [["^", *token(t), "$"] for i, t in docs if not is_held_out(i)]
    words = Counter(w for t in texts for w in t[1:-1])
    total, ends = sum(words.values()) + len(texts), len(texts)
    root = {s: ((c + 1) / (total + 2)) for s, c in (("word", total - ends), ("end", ends))}

    def base(w):
        if w == "$":
            return root["end"]
        return root["word"] * ((words[w] - lm.DISCOUNT) / (total - ends) if words[w] else lm.DISCOUNT * len(words) / (total - ends))

    after = {}
    for t in texts:
        for i in range(1, len(t)):
            for d in (1, 2):
                if i >= d:
                    after.setdefault(tuple(t[i - d : i]), Counter())[t[i]] += 1
    kept = set()

    def p(w, c):
        if not c:
            return base(w)
        inner = p(w, c[1:])
        if c not in kept:
            return inner
        return (after[c][w] + len(after[c]) * inner) / (sum(after[c].values()) + len(after[c]))

    for c in sorted((c for c in after if sum(after[c].values()) >= lm.LEAST_COUNT), key=len):
        n = sum(after[c].values())
        if sum(k * math.log(k / n / p(w, c[1:])) for w, k in after[c].items()) >= 5.0:
            kept.add(c)
    assert {len(c) for c in kept} == {1, 2} or len(kept) > 10
    for i, t in docs:
        t = ["^", *token(t), "$"]
        want = sum(math.log10(p(t[k], tuple(t[max(0, k - 2) : k]))) for k in range(1, len(t)))
        assert got[i, len(t) - 1] == pytest.approx(want, abs=1e-3)


def test_common_contexts_and_pieces_change_nothing(spark, monkeypatch):
    """Contexts counted apart, small buckets and small pieces give the scores of one bucket that holds everything."""
    docs = frame(spark, corpus(6, 250) + [(30000 + k, "one two three four five " * 12 + ("six" if k % 2 else "seven")) for k in range(60)])
    rows = lambda **kwargs: sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm.score_documents(docs, divergence=5.0, **kwargs).collect()))
    want = rows(buckets=1, bucket_places=10**9)
    monkeypatch.setattr(lm, "_PIECE_WORDS", 500)
    monkeypatch.setattr(lm, "_SLICE_WORDS", 2_000)
    for places in (20, 150):
        got = rows(buckets=3, bucket_places=places)
        assert [w[:4] for w in want] == [g[:4] for g in got]
        assert np.allclose([w[4:] for w in want], [g[4:] for g in got], atol=1e-3)


def test_common_words_that_are_no_context_themselves(spark):
    """A common word that is not retained still opens the lower layer if a longer context that ends with it is."""
    texts = [f"{'zig' if k % 2 else 'zag'} mid {'left' if k % 2 else 'right'}" for k in range(300)] + ["mid left", "mid right"] * 20
    docs = frame(spark, list(enumerate(texts)))
    kwargs = {"symbol_share": 0.02, "context_share": 0.9, "divergence": 15.0}
    want, got = [{r.doc_id: r.score for r in lm.score_documents(docs, **kwargs, **more).collect()} for more in ({"bucket_places": 10**9}, {"bucket_places": 10})]
    assert want.keys() == got.keys() and np.allclose([want[k] for k in want], [got[k] for k in want], atol=1e-3)


def test_intermediate_tables_stay_below_the_texts(spark, tmp_path):
    """Pairs of words that stand once or twice each do not become rows of a table."""
    from pathlib import Path

    from billweave.session import shared_folder

    r = random.Random(7)
    words = [f"word{i:05d}" for i in range(3000)]
    texts = [" ".join(r.choices(words, k=400)) for _ in range(400)]
    frame(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "docs"))
    used = lambda: sum(p.stat().st_size for p in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if p.is_file())
    lm.score_documents(spark.read.parquet(str(tmp_path / "docs"))).count()  # classes are made and folders exist
    before = used()
    assert lm.score_documents(spark.read.parquet(str(tmp_path / "docs"))).where("score < 0").count() == 400
    assert used() - before < 1.0 * sum(map(len, texts))
