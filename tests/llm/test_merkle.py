"""The manifest against trees built node by node."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from billweave.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, proof int, tree string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    n = None if row[4] is None else row[4] + more
    return sha("".join(said(v) for v in (row[0], row[3], row[2], n, row[1])))


def climb(nodes, fanout):
    """The root, and for each node the siblings (left, right) on its way."""
    proofs, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            start = p - p % fanout
            proofs[k].append(("".join(nodes[start:p]), "".join(nodes[p + 1 : start + fanout])))
            place[k] = p // fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def plain(rows, fanout=2, tampered=lambda row: False):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    inner = {n: climb([t[2] for t in sorted(trees[n], key=lambda t: t[:3])], fanout) for n in names}
    root, outer = climb([inner[n][0] for n in names], fanout)
    found = []
    for n, above in zip(names, outer):
        for (_, _, leaf, row), below in zip(sorted(trees[n], key=lambda t: t[:3]), inner[n][1]):
            folded = leaf_of(row, 1) if tampered(row) else leaf
            for left, right in below + above:
                folded = sha(left + folded + right)
            found.append((row[0], leaf, inner[n][0], root, "".join(a + b for a, b in below + above), folded, folded == root))
    return sorted(found, key=repr)


def made(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)
    found = merkle.manifest(docs, **options)
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_text(F.col("proof")).alias("p"), "folded_root", "verified")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def rows_of(n, langs):
    return [(i * 7919 % 100003, f"té {i % 11} <&>\n" * (i % 4), langs[i * i % len(langs)], None if i % 5 == 0 else f"s{i % 3}", None if i % 13 == 0 else i) for i in range(n)]


EDGES = [(None, None, None, None, None), (None, "a", None, None, 1), (5, "a", "en", "s", 1), (5, "a", "en", "s", 1), (5, "b", "en", "s", 1), (6, "", "", "", 0), (7, "x" * 300_000, "é", "s", 9)]


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_equals_trees_built_node_by_node(spark, fanout):
    rows = rows_of(700, ["en"] * 5 + ["de", "fr", None, "ż", "z"]) + EDGES
    assert made(spark, rows, fanout=fanout) == plain(rows, fanout)


def test_blocks_of_any_size_give_the_same_tree(spark, monkeypatch):
    rows = rows_of(300, ["en", "en", None]) + [(10**6 + i, "t", f"l{i}", "s", i) for i in range(40)]
    monkeypatch.setattr(merkle, "BLOCK", 4)  # several rounds, also over the languages
    monkeypatch.setattr(merkle, "ROWS_A_RANGE", 50)  # several ranges a language
    assert made(spark, rows) == plain(rows)
    for n in (1, 2, 3, 4, 5, 15, 16, 17):
        assert made(spark, rows[:n]) == plain(rows[:n])


def test_claims(spark):
    rows = rows_of(60, ["en", "de"]) + EDGES
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = made(spark, rows, claimed=claimed)
    assert found == plain(rows, tampered=lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
    # a null claim changes nothing
    false = sum(not r[6] for r in found)
    assert 0 < false == sum(1 for r in rows if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)


def test_empty_and_single(spark):
    assert made(spark, []) == []
    one = made(spark, [(1, "t", "en", "s", 1)])
    assert one == plain([(1, "t", "en", "s", 1)]) and one[0][1] == one[0][3] and one[0][4] == ""
    with pytest.raises(ValueError):
        made(spark, [], fanout=1)
