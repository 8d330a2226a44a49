"""The pipeline on a small corpus, stage by stage against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import expected as contamination
from tests.llm.test_near_dedup import expected as components

public_tokenizers = pytest.importorskip("public_tokenizers")


def without_strings(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for t, d in zip(texts, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(None if t is None else bytes(b for b, g in zip(d, gone) if not g).decode(errors="ignore"))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    filler = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiouä") for _ in range(r.randrange(1, 5))) for _ in range(3000)]
    text = lambda n: [r.choice(filler) for _ in range(n)]
    passage, items = " ".join(text(90)), [(i, " ".join(text(25))) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        words = text(r.randrange(20, 160))
        if i % 5 == 0:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["scoundrel", "rascal", "weasel"])
        if i % 7 == 1:
            words += passage.split(" ")
        if i % 11 == 2:
            words[5:5] = items[i % 5][1].split(" ")
        docs.append((i, " ".join(words), "en", f"src{i % 3}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    for i in range(300, 330):
        words = docs[i - 299][1].split(" ")
        words[r.randrange(len(words))] = "changed"
        docs.append((i, " ".join(words), "en", "src0", 0))
    docs += [(400, None, None, None, None), (401, "", "en", "x", 0), (402, docs[4][1], "en", "x", 0)]
    base = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), docs, items


def test_stages_equal_brute_force(spark, folder, tmp_path):
    base, docs, items = folder
    bad = ("scoundrel", "rascal", "weasel")
    frame, left = spark.read.parquet(f"{base}/documents.parquet"), {d[0]: d for d in docs}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, base).write.parquet(f"{tmp_path}/{number}")
        out = spark.read.parquet(f"{tmp_path}/{number}")
        rows = [tuple(r) for r in out.collect()]
        if name == "toxicity":
            left = {i: d for i, d in left.items() if not any(b in (d[1] or "") for b in bad)}
        elif name == "near_dedup":
            kept = {c[0] for c in components([(d[0], d[1]) for d in left.values()]) if c[3]}
            left = {i: d for i, d in left.items() if i in kept}
        elif name == "suffix_array":
            ids = list(left)
            left = {i: (i, t, *left[i][2:]) for i, t in zip(ids, without_strings([left[i][1] for i in ids]))}
        elif name == "decontamination":
            dirty = {c[0] for c in contamination([(d[0], d[1]) for d in left.values()], items) if c[5]}
            assert dirty
            left = {i: d for i, d in left.items() if i not in dirty}
        if name != "packing":
            assert out.columns == frame.columns
            assert sorted(rows, key=repr) == sorted(left.values(), key=repr), name
            frame = out
    assert check_pieces(out.collect(), left)


def check_pieces(pieces, left):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = defaultdict(list)
    for p in pieces:
        own[p["doc_id"]].append(p)
    assert set(own) == set(left)
    for i, d in left.items():
        ids, at = [*whole.encode(d[1] or "", add_special_tokens=False).ids, 2], 0
        for p in sorted(own[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    return True


def test_run_and_empty_table(spark, folder, tmp_path):
    base, *_ = folder
    assert corpus_pipeline.run(spark, base).count() > 0
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{base}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
