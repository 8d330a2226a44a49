"""Steps that are made once, and digests that travel as bytes."""

import hashlib

from pyspark.sql import functions as F

from billweave.functions.dates import printed_to_date
from billweave.functions.text import packed, unpacked
from billweave.operators import confidence, reconcile
from billweave.plans import posting, reviewing
from billweave.plans.registry import Tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_packed_texts_come_back_and_stay_apart(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    texts = [digest, digest.upper(), digest + "\n", "", None, "a" * 32, "é" * 16, "\0" * 33, "z" * 64]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed(F.col("t")).alias("p"))
    got = rows.select("t", "p", unpacked(F.col("p")).alias("again")).collect()
    assert all(r.t == r.again for r in got)
    assert len({None if r.p is None else bytes(r.p) for r in got}) == len(texts)
    assert len(next(r.p for r in got if r.t == digest)) == 32


def test_records_are_made_once_for_both_answers(spark):
    reference = spark.createDataFrame(
        [("r", "vendor", "1", "Acme Tools", True, None), ("r", "account", "2", "Costs:Tools", True, "Expense")],
        "realm_id string, entity_kind string, entity_id string, name string, active boolean, account_type string",
    ).filter("rand(77) >= 0")
    parsed = spark.createDataFrame([("h", "acme tools", "tools", 2)], "file_hash string, vendor string, suggested_category string, schema_version int")
    hashes = spark.createDataFrame([("r", "h"), ("r", "i"), ("s", "h")], "realm_id string, file_hash string").filter("rand(78) >= 0")
    got = reconcile.match_batch(hashes, parsed, reference)
    assert "rand(77)" not in plan(got) and "rand(78)" not in plan(got)
    rows = {(r.realm_id, r.file_hash): (r.vendor_selected_id, r.category_selected_id, r.error) for r in got.collect()}
    assert rows == {("r", "h"): ("1", "2", None), ("r", "i"): (None, None, None), ("s", "h"): (None, None, "reference-empty")}


def lines(spark, folder):
    rows = [(1, 1, 1, 1, 9.5, 0.01, "N", "O"), (1, 1, 1, 1, 9.5, 0.03, "N", "O"), (2, 2, 1, 2, 8.5, 0.07, "A", "F"), (3, 2, 1, 3, 8.5, 0.08, "R", "F")]
    types = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string"
    df = spark.createDataFrame(rows, types).withColumn("l_discount", F.lit(0.0)).withColumn("l_shipdate", F.lit("1995-01-01").cast("timestamp"))
    df.write.parquet(f"{folder}/lineitem.parquet")
    return Tables(spark, folder)


def test_answers_stand_once_for_each_entry_of_their_id(spark, tmp_path):
    got = posting.responses(lines(spark, str(tmp_path)))
    assert "Join" not in plan(got)
    assert sorted((r.http_status, r.remote_id or "") for r in got.collect()) == [(200, "n1")] * 2 + [(400, "")] + [(503, "n1")] * 2


def test_rows_that_want_a_person_are_made_once(spark, tmp_path):
    rows = [(i, i // 4, "OFP"[i % 3], 100.0 + i, f"{1 + i % 5}-x") for i in range(40)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    orders.withColumn("o_orderdate", F.lit("1998-02-03").cast("timestamp")).write.parquet(f"{tmp_path}/orders.parquet")
    got = reviewing.attention_rows(Tables(spark, str(tmp_path)))
    assert plan(got).count("o_orderpriority#") <= 8
    assert 0 < got.count() <= 20


def test_flags_are_cut_without_patterns(spark):
    flags = [["money:totalCents"], ["arithmetic:subtotal+tax!=total"], ["plain"], [":"], ["a:b:c", "missing:vendor"], [None], [], None]
    df = spark.createDataFrame([(i, f, {"dueDate": "flagged"}) for i, f in enumerate(flags)], "i int, validation_flags array<string>, field_confidence map<string,string>")
    got = df.select("i", confidence.flagged_fields().alias("f"))
    assert "regexp_replace" not in plan(got)
    money = ["dueDate", "subtotalCents", "taxCents", "totalCents"]
    assert [r.f for r in got.orderBy("i").collect()] == [["dueDate", "totalCents"], money, money, money, sorted([*money, "vendor"]), money, ["dueDate"], ["dueDate"]]


def test_numeric_dates(spark):
    texts = {"1/2/24": "2024-01-02", "13.2.1999": "1999-02-13", "12-31-70": "1970-12-31", "02/30/2024": None, "13/13/2024": None, "1/2-69": "2069-01-02", "1/2/024": None, "99/1/0024": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", printed_to_date(F.col("t")).cast("string").alias("d"))
    assert {r.t: r.d for r in df.collect()} == texts
