"""Packing: every token in exactly one piece, within all limits, with the library's own ids."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from billweave.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(packing.TOKENIZER)
TEXTS = [
    "It's we'll '' 's x'S a'b'll DON'T \"'re 12 3.4 ½ ² é É ŒIl'ĳ", "<|endoftext|> a", "ñandú Ωmega", "", None, "áb", "'", "x'", "'s", "ſ ŉ İ", "a\x00b", "a\xa0b",
    "l'été d'œuvre 'tis", "日本語 text", "'re've'm'd", "word" * 300, "a b " * 9000, "!'s", "é" * 50,
]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string")


def check(pieces, ids_of, max_tokens, max_segments, max_loss):
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        documents[p["doc_id"]].append(p)
    for placed in sequences.values():
        placed.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in placed] == np.concatenate(([0], np.cumsum([p["length"] for p in placed])))[:-1].tolist()
        assert sum(p["length"] for p in placed) <= max_tokens and len(placed) <= max_segments and sum(p["loss_tokens"] for p in placed) <= max_loss
    assert set(documents) == {d for d, ids in ids_of.items() if len(ids)}
    for doc, own in documents.items():
        own.sort(key=lambda p: p["start"])
        ids, at = ids_of[doc], 0
        for p in own:
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    return len(sequences)


@pytest.mark.parametrize("limits", [(4096, 256), (64, 3), (16, 256)])
def test_documents(spark, limits):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(TEXTS)}
    rows = packing.pack_documents(documents(spark, TEXTS).coalesce(1), PATH, max_tokens=limits[0], max_segments=limits[1], pool=8).collect()
    n = check(rows, ids, *limits, limits[0])
    if limits[1] == 256:
        assert n <= -(-sum(map(len, ids.values())) // limits[0]) + 1  # one task: little padding


def test_three_limits(spark):
    rng = np.random.default_rng(3)
    ids = {i: list(range(int(n))) for i, n in enumerate(rng.integers(0, 90, 200))}
    loss = {i: int(rng.integers(0, len(v) + 1)) for i, v in ids.items()}
    rows = [(i, v, loss[i]) for i, v in ids.items()] + [(900, None, 3)]
    got = packing.pack_examples(spark.createDataFrame(rows, "doc_id long, ids array<int>, loss long").coalesce(1), loss_tokens="loss", max_tokens=128, max_segments=5, max_loss=40, pool=32).collect()
    check(got, ids, 128, 5, 40)
    total = defaultdict(int)
    for p in got:
        total[p["doc_id"]] += p["loss_tokens"]
    assert all(total[i] == n for i, n in loss.items())


def test_empty_null_and_repeated(spark):
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    rows = packing.pack_documents(twice, PATH).collect()
    assert sorted((p["doc_id"] or 0, p["length"]) for p in rows) == [(0, 1), (1, 3), (1, 3)]
