"""Texts made to collide, and columns called as an operator would call its own."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from billweave.llm import decontaminate, near_dedup, packing, substring_trees, suffix_array, suffix_tree_lm, text, toxicity


def colliding(n):
    """Two words whose polynomials are equal modulo any power of two up to 2**64, whatever the odd multiplier."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_prints_differ(n):
    one, two = (np.frombuffer(w.encode(), np.uint8) for w in colliding(n))
    at = np.array([0]), np.array([n])
    assert text.word_hashes(one, *at)[0] != text.word_hashes(two, *at)[0]
    both = text.Rolling(text.byte_values(np.concatenate((one, two, one))))
    prints = both.of(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert prints[0] == prints[2] != prints[1]


def test_prints_are_polynomials_modulo_a_prime():
    r = np.random.default_rng(1)
    prime = (1 << 61) - 1
    values = r.integers(0, 1 << 64, 40_000, dtype=np.uint64)
    values[:4] = [prime, prime - 1, 0, (1 << 64) - 1]
    sums, total, power = text.Rolling(values).sums, 0, 1
    for k, v in enumerate(values.tolist()):
        assert int(sums[k]) % prime == total
        total, power = (total + v * power) % prime, power * text._BASE % prime


@pytest.mark.parametrize("n", [1024, 2048])
def test_operators_tell_colliding_words_apart(spark, n):
    one, two = colliding(n)
    lead = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"{one} x y"), (2, f"{two} x y"), (3, f"{one}"), (4, f"{two}")], "doc_id long, text string")
    windows = spark.createDataFrame([(1, f"{lead[:30]} {one} {lead}"), (2, f"{lead[:30]} {two} x {lead[5:]}")], "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in substring_trees.removal_report(windows, window=13).collect()}
    words = [t.split() for t in (f"{lead[:30]} {one} {lead}", f"{lead[:30]} {two} x {lead[5:]}")]
    seen = {tuple(words[0][i : i + 13]) for i in range(len(words[0]) - 12)}
    cover = {j for i in range(len(words[1]) - 12) if tuple(words[1][i : i + 13]) in seen for j in range(i, i + 13)}
    assert removed == {1: 0, 2: len(cover)}

    benchmark = spark.createDataFrame([(1, f"a {one} b")], "item_id long, text string")
    asked = spark.createDataFrame([(1, f"x a {one} b y"), (2, f"x a {two} b y")], "doc_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination_report(asked, benchmark).collect()} == {1: 3, 2: 0}

    parts = {r.doc_id: r.component_id for r in near_dedup.component_report(docs).collect()}
    assert parts == {1: 1, 2: 2, 3: 3, 4: 4}

    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    held = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2)
    scored = spark.createDataFrame([*[(i, one) for i in ids], (held, two)], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in suffix_tree_lm.score_documents(scored).collect()} == {**{i: 2 for i in ids}, held: 1}


@pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="no vocabulary files")
def test_packing_encodes_colliding_words_each(spark):
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path(packing.TOKENIZER)
    library = Tokenizer.from_file(path)
    texts = [f"{a} {b}" for n in (1024, 2048) for a, b in (colliding(n), colliding(n)[::-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in packing.pack_documents(docs, path, max_tokens=4096).collect():
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        piece = np.array(ids[r.start : r.start + r.length], "<u4")
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32


_NAMES = ["_score", "_n_hits", "_n_words", "_n_hit", "_spans", "_items", "_repeated", "_doc", "_key", "c0", "c1", "score", "n_hits", "doc", "key", "row", "spans", "repeated", "class", "n_shingles"]


def test_columns_of_any_name_come_back_as_they_were(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(12)]
    rows = [(i, t, *[f"{n}{i}" for n in _NAMES]) for i, t in enumerate([*texts, texts[0], "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in _NAMES))
    benchmark = spark.createDataFrame([(1, "nothing of this stands there")], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    given = {r.doc_id: tuple(r) for r in docs.collect()}
    for kept in (
        decontaminate.decontaminated(docs, benchmark),
        toxicity.without_toxic(docs, labels),
        near_dedup.one_of_each(docs),
        suffix_array.without_repeats(docs, length=4000),
    ):
        assert kept.columns == docs.columns
        back = {r.doc_id: tuple(r) for r in kept.collect()}
        assert len(back) >= 12 and all(given[i][:1] + given[i][2:] == b[:1] + b[2:] for i, b in back.items())
