"""Best options by bounds against scoring every pair."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from billweave import fixed
from billweave.functions import best_names, names
from billweave.operators import reconcile

WORDS = ["north", "nort", "pipe", "pipes", "hot", "bolt", "gear", "geer", "large", "europe", "brand", "1", "11", "12", "co2", "é"]


def _tables(asked, offered):
    words = lambda n: list(dict.fromkeys(n.split(" ")))
    vocabulary = {w for n in offered for w in words(n)}
    near = lambda n: [
        {"word": w, "similar": s, "weight": weight} for w in words(n) for s in sorted(vocabulary) if (weight := names._jaro_winkler(w, s)) >= fixed.TOKEN_MATCH_FLOOR
    ]
    kind = pa.list_(pa.struct([("word", pa.string()), ("similar", pa.string()), ("weight", pa.float64())]))
    left = pa.table([pa.array(asked), pa.array(map(words, asked)), pa.array(map(near, asked), kind)], names=["query_norm", "q_words", "near"])
    return left, pa.table([pa.array(offered), pa.array(map(words, offered))], names=["option_norm", "o_words"])


def _brute(name, option, near):
    own, mine, theirs, total = set(option.split(" ")), set(), set(), 0.0
    met = sorted((-p["weight"], *sorted((p["word"], p["similar"])), p["word"], p["similar"]) for p in near if p["similar"] in own)
    for order, _, _, word, similar in met:
        if word not in mine and similar not in theirs:
            total, mine, theirs = total - order, mine | {word}, theirs | {similar}
    if not met:
        return 0.0
    words = 2.0 * total / (len(set(name.split(" "))) + len(own))
    score = 1.0 if name == option else min(1.0, max(0.0, fixed.TOKEN_WEIGHT * words + fixed.CHARACTER_WEIGHT * names._jaro_winkler(name, option)))
    return int(score * 10000 + 0.5) / 10000


def _names(r, n):
    return sorted({" ".join(r.choice(WORDS) for _ in range(r.randint(1, 6))) for _ in range(n)})


def test_best_pairs_equal_all_pairs(monkeypatch):
    r = random.Random(8)
    offered, asked = _names(r, 260), _names(r, 90)
    left, right = _tables(asked, offered)
    exact = []
    blocks = best_names._jaro_winkler_many
    monkeypatch.setattr(best_names, "_jaro_winkler_many", lambda a, b: exact.extend(a) or blocks(a, b))
    got = {}
    for name, option, score in zip(*best_names.best_pairs(left, right, 5)):
        got.setdefault(name, {})[option] = score
    for row in left.to_pylist():
        scores = {o: s for o in offered if (s := _brute(row["query_norm"], o, row["near"])) >= fixed.CANDIDATE_FLOOR}
        least = sorted(scores.values(), reverse=True)[4] if len(scores) > 4 else 0.0
        assert got.get(row["query_norm"], {}) == {o: s for o, s in scores.items() if s >= least}, row["query_norm"]
    assert len(exact) < len(asked) * len(offered) / 3


def test_pairs_that_cannot_be_answers_are_not_made(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "_BLOCK_NAMES", 50, raising=False)
    listed = [f"north pipe europe {i}" for i in range(120)]
    rows = lambda side: spark.createDataFrame([("r", n, n.split(" ")) for n in listed], f"realm_id string, {side}_norm string, {side[0]}_words array<string>")
    q = rows("query")
    near = q.withColumn("near", F.transform("q_words", lambda w: F.struct(w.alias("word"), w.alias("similar"), F.lit(1.0).alias("weight")))).drop("q_words")
    pairs = reconcile.candidate_pairs(q, rows("option"), near).collect()
    assert {(n, n) for n in listed} <= {(p["query_norm"], p["option_norm"]) for p in pairs}
    assert len(pairs) < len(listed) ** 2 / 2


def test_rows_without_a_realm_match_nothing(spark):
    options = spark.createDataFrame([(None, "1", "north pipe", "north pipe"), ("r", "2", "north pipe", "north pipe")], "realm_id string, option_id string, option_name string, match_text string")
    asked = spark.createDataFrame([(None, "north pipe"), ("r", "north pipes")], "realm_id string, query string")
    assert [(x["realm_id"], x["option_id"]) for x in reconcile.rank_candidates(asked, options).collect()] == [("r", "2")]
