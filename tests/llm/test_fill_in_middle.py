"""Arrangements against slices of Python strings."""

import hashlib
import random

from pyspark.sql import functions as F

from billweave.llm import fill_in_middle as fim

SCHEMA = "doc_id long, text string, pieces int, output string, form string, n int"


def plain(doc_id, text):
    text = text or ""
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, len(text), "plain", None, None, text)
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return (doc_id, len(text), "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, len(text), "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}")


def corpus():
    r = random.Random(5)
    letters = "ab<>PSM é\U0001f600\n日"
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randrange(0, 60)))) for i in range(1500)]
    return rows + [(None, "abc"), (None, None), (3, None), (4, ""), (9, "x"), (9, "x"), (10, "<P"), (11, "a<M>b"), (12, "é" * 1_000_000), (13, "<<<P"), (-1, ">>")]


def test_arrangements_and_their_inverse(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "o", "f", 2) for r in rows], SCHEMA)
    got = fim.hashes(docs).collect()
    want = [(*p, hashlib.sha256(p[5].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t) in rows for p in [plain(i, t)]]
    found = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_texts_go_and_come_back(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "o", "f", 2) for r in rows], SCHEMA)
    made = fim.transformed(docs)
    assert made.columns == [*docs.columns, "fim"] and made.select("pieces", "output", "form", "n").distinct().collect() == [(1, "o", "f", 2)]
    back = made.withColumn("text", fim.restored(F.col("text"), F.col("fim.form")))
    assert sorted(map(repr, back.select("doc_id", "text").collect())) == sorted(map(repr, docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    # a column of that name is replaced, or another name is asked for
    clash = docs.withColumn("fim", F.lit(7))
    assert fim.transformed(clash, into="cuts").select("fim").distinct().collect() == [(7,)]
    assert "pieces" in fim.transformed(clash).schema["fim"].dataType.names
    assert fim.hashes(docs.limit(0)).collect() == []


def test_cuts_split_descriptors(spark):
    one = spark.range(1).select(F.lit("abcdef").alias("t"))
    table = fim.whole(F.col("t"))
    for cuts in ([0, 0], [6, 6], [0, 6], [2, 5], [3, 3], [5, 2]):
        pieces = table
        for at in cuts:
            pieces = fim.cut(pieces, F.lit(at))
        found = one.select(pieces.alias("p"), fim.read(pieces, F.col("t")).alias("r")).first()
        edges = sorted(cuts)
        assert [(p.start, p.length) for p in found.p] == [(0, edges[0]), (edges[0], edges[1] - edges[0]), (edges[1], 6 - edges[1])]
        assert found.r == "abcdef"


def test_shares(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    forms = dict(fim.hashes(docs, plain_share=0, spm_share=50).groupBy("form").count().collect())
    assert "plain" not in forms and abs(forms["spm"] - 1500) < 150
    assert dict(fim.hashes(docs, plain_share=100).groupBy("form").count().collect()) == {"plain": 3000}
