"""Similarity properties, lossless blocking, and matching against brute force."""

import random

import pytest

from billweave import fixed
from billweave.functions import names
from billweave.operators import reconcile

VENDORS = [
    ("58", "Apex Plumbing Supply"), ("59", "Brightline Electric Supply"), ("60", "Metro Fuel Oil Corp"), ("61", "Cedar Lane Landscaping Supply"),
    ("62", "Northside Auto Parts"), ("63", "Pinnacle Office Supplies"), ("43", "PG&E"), ("34", "Chin's Gas and Oil"), ("39", "Hicks Hardware"),
]
ACCOUNTS = [
    ("29", "Equipment Rental"), ("62", "Job Expenses:Equipment Rental"), ("72", "Maintenance and Repair"), ("61", "Job Expenses:Maintenance and Repairs"),
    ("63", "Job Expenses:Job Materials"), ("15", "Office Expenses"), ("20", "Supplies"), ("55", "Automobile"), ("56", "Automobile:Fuel"),
]


def reference_rows(spark):
    rows = [("r", "vendor", i, n, True, None) for i, n in VENDORS] + [("r", "account", i, n, True, "Expense") for i, n in ACCOUNTS]
    rows += [("r", "account", "35", "Checking", True, "Bank"), ("r", "vendor", "99", "Old Vendor", False, None)]
    return spark.createDataFrame(rows, "realm_id string, entity_kind string, entity_id string, name string, active boolean, account_type string")


def answers(spark, options, texts):
    asked = spark.createDataFrame([("r", t) for t in texts], "realm_id string, query string")
    return {r["query"]: r for r in reconcile.match_texts(asked, options).collect()}


def test_vendor_tiers(spark):
    options = reconcile.vendor_options(reference_rows(spark))
    exact = {"Apex Plumbing Supply": "58", "Metro Fuel Oil Corp": "60", "NORTHSIDE AUTO PARTS": "62", "PINNACLE OFFICE SUPPLIES": "63", "Brightline Electric Supply": "59"}
    near = {"Brightline Electric": ("59", 0.8658), "Cedar Lane Landscaping": ("61", 0.8997)}
    got = answers(spark, options, [*exact, *near, "Quality Craft Tools LLC", "Old Vendor", "  "])
    for text, vendor in exact.items():
        assert (got[text]["confidence"], got[text]["selected_id"], got[text]["candidates"][0]["score"]) == ("auto", vendor, 1.0)
    for text, (vendor, score) in near.items():
        assert (got[text]["confidence"], got[text]["selected_id"], got[text]["candidates"][0]["score"]) == ("suggested", vendor, score)
    assert "Quality Craft Tools LLC" not in got and "Old Vendor" not in got and "  " not in got


def test_category_ties_are_suggested(spark):
    got = answers(spark, reconcile.category_options(reference_rows(spark)), ["Equipment Rental", "Maintenance and Repair", "Job Materials", "Office Expense", "Checking"])
    assert got["Equipment Rental"]["confidence"] == "suggested"
    assert [c["id"] for c in got["Equipment Rental"]["candidates"][:2]] == ["29", "62"]
    assert got["Maintenance and Repair"]["confidence"] == "suggested"
    assert (got["Job Materials"]["confidence"], got["Job Materials"]["selected_name"]) == ("auto", "Job Expenses:Job Materials")
    assert (got["Office Expense"]["confidence"], got["Office Expense"]["selected_id"]) == ("auto", "15")
    assert "Checking" not in got


def test_match_batch(spark):
    parsed = spark.createDataFrame(
        [("h1", "apex plumbing supply", "Fuel", 2), ("h2", "nobody", None, 2), ("h3", "Hicks Hardware", "Fuel", 1)],
        "file_hash string, vendor string, suggested_category string, schema_version int",
    )
    hashes = spark.createDataFrame([("r", "h1"), ("r", "h1"), ("r", "h2"), ("r", "h3"), ("empty", "h1")], "realm_id string, file_hash string")
    rows = {(r["realm_id"], r["file_hash"]): r for r in reconcile.match_batch(hashes, parsed, reference_rows(spark)).collect()}
    assert len(rows) == 4
    first = rows["r", "h1"]
    assert (first["vendor_selected_id"], first["vendor_confidence"], first["category_selected_id"], first["category_confidence"]) == ("58", "auto", "56", "auto")
    assert rows["r", "h2"]["vendor_confidence"] == "none" and rows["r", "h3"]["vendor_confidence"] == "none"
    assert rows["empty", "h1"]["error"] == "reference-empty" and first["error"] is None


@pytest.fixture(scope="module")
def corpus():
    random.seed(3)
    words = "supply supplies supplier electric electrical auto parts part oil fuel fuels metro north northside office tools tool craft lane land landscaping hardware ring rings 1042 1043 10".split()
    out = {" ".join(random.choice(words) for _ in range(random.randint(1, 4))) for _ in range(160)}
    out |= {"", "   ", "&", "a", "Company", "LLC", "a" * 300, "Café Noir", "CAFE NOIR, Inc.", "x y z", "Bob's Burgers", "***"}
    return sorted(out)


def brute(a, b):
    def normal(s):
        s = (names._fold_one(s) or "").lower().replace("&", " and ")
        w = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in s).split()
        return " ".join([x for x in w if x not in fixed.COMPANY_FORM_WORDS] or w)

    x, y = normal(a), normal(b)
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    left, right, total = set(x.split()), set(y.split()), 0.0
    size = len(left) + len(right)
    while left and right:
        weight, _, p, q = min((-names._jaro_winkler(p, q), sorted((p, q)), p, q) for p in left for q in right)
        if -weight < fixed.TOKEN_MATCH_FLOOR:
            break
        total -= weight
        left.discard(p)
        right.discard(q)
    words = 2 * total / size if size else 0.0
    return min(1.0, max(0.0, 0.55 * words + 0.45 * names._jaro_winkler(x, y)))


def test_ranking_equals_brute_force(spark, corpus):
    options = [(str(i), n) for i, n in enumerate(corpus)] + [("dup", corpus[20])]
    odf = spark.createDataFrame([("r", i, n, n) for i, n in options], "realm_id string, option_id string, option_name string, match_text string")
    asked = spark.createDataFrame([("r", n) for n in corpus] + [("r", corpus[5])], "realm_id string, query string")
    got = {}
    for r in reconcile.rank_candidates(asked, odf).collect():
        got.setdefault(r["query"], []).append((r["candidate_rank"], r["option_id"], r["score"]))
    for q in corpus:
        if not q.strip():
            assert q not in got
            continue
        scored = [(int(brute(q, n) * 10000 + 0.5) / 10000, n, i) for i, n in options]
        best = sorted((s for s in scored if s[0] >= 0.45), key=lambda s: (-s[0], s[1], s[2]))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, s) for k, (s, _, i) in enumerate(best)], q


def test_long_names_match_by_letters(spark):
    a = "a" * 1400 + " " + "b" * 1400
    rows = [("r", "1", a, a), ("r", "2", a[:-1] + "c", a[:-1] + "c"), ("r", "3", "b" * 2801, "b" * 2801)]
    odf = spark.createDataFrame(rows, "realm_id string, option_id string, option_name string, match_text string")
    got = reconcile.rank_candidates(spark.createDataFrame([("r", a)], "realm_id string, query string"), odf).collect()
    assert [(r["option_id"]) for r in sorted(got, key=lambda r: r["candidate_rank"])][:2] == ["1", "2"]
    assert len(got) == len({r["option_id"] for r in got})


def test_similarity_properties(corpus):
    assert names._jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    for a in corpus[::3]:
        assert brute(a, a) == 1.0
        for b in corpus[::3]:
            assert brute(a, b) == brute(b, a) and 0 <= brute(a, b) <= 1


def test_block_scores_equal_plain_scores():
    random.seed(5)
    word = lambda n: "".join(random.choice("abcdé ") for _ in range(random.randint(0, n)))
    a, b = [word(20) for _ in range(3000)], [word(20) for _ in range(3000)]
    assert list(names._jaro_winkler_many(a, b)) == [names._jaro_winkler(x, y) for x, y in zip(a, b)]


def test_blocking_keys_lose_no_pair():
    random.seed(9)
    words = list({"".join(random.choice("abcdeilnorst12") for _ in range(random.randint(1, 11))) for _ in range(700)})
    words += [w + "s" for w in words[:150]] + ["x" * 30, "x" * 29 + "y", "ab" * 25, "ab" * 24]
    keys = {w: set(names.block_keys(w)) for w in words}
    for i, x in enumerate(words):
        for y in words[i:]:
            if names._jaro_winkler(x, y) >= fixed.TOKEN_MATCH_FLOOR:
                assert keys[x] & keys[y], (x, y)
