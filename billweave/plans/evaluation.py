"""Accuracy queries: orders are the truth, slightly altered copies the parses."""

from pyspark.sql import functions as F

from billweave.operators import evaluate
from billweave.plans.registry import query


def truth(t):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    tax = F.floor(cents * 8 / 100).cast("bigint")
    p = F.left("o_orderpriority", F.lit(1))
    return t.orders.select(
        F.concat(F.lit("bills/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file"),
        F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("reference_number"),
        F.col("o_orderdate").cast("date").alias("txn_date"),
        F.when(p != "5", F.date_add("o_orderdate", 30)).alias("due_date"),
        F.when(p != "4", cents - tax).alias("subtotal_cents"),
        F.when(p != "4", tax).alias("tax_cents"),
        cents.alias("total_cents"),
    )


def parsed(t):
    """Read copies: partly shipped orders have a wrong total, open ones no number, customers below 100 were never read."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    tax = F.floor(cents * 8 / 100).cast("bigint")
    st = F.col("o_orderstatus")
    return t.orders.filter(F.col("o_custkey") >= 100).select(
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("original_filename"),
        F.when(st != "O", F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string"))).alias("invoice_number"),
        F.when(F.col("o_orderdate") < "1999-01-01", F.col("o_orderdate").cast("date")).alias("invoice_date"),
        (cents - tax).alias("subtotal_cents"),
        F.when(st == "F", F.lit(None)).otherwise(tax).alias("tax_cents"),
        F.when(st == "P", cents + 1).otherwise(cents).alias("total_cents"),
    )


_CHECKS = """k AS (SELECT o_orderkey || '.pdf' AS file, o_custkey >= 100 AS found, unnest(['total_cents', 'invoice_number', 'invoice_date', 'subtotal_cents', 'tax_cents']) AS field,
  unnest([o_orderstatus <> 'P', o_orderstatus <> 'O', o_orderdate < TIMESTAMP '1999-01-01', true, o_orderstatus <> 'F']) AS matches, unnest([true, true, true, left(o_orderpriority, 1) <> '4', left(o_orderpriority, 1) <> '4']) AS checked FROM orders)"""


@query("field_checks", f"WITH {_CHECKS} SELECT file, field, found, found AND matches AS matches FROM k WHERE checked")
def field_checks(t):
    return evaluate.field_checks(truth(t), parsed(t))


@query(
    "field_accuracy",
    f"""WITH {_CHECKS} SELECT field, count(*) AS checked, count(*) FILTER (found AND matches) AS correct, count(*) FILTER (NOT found) AS not_parsed,
      count(*) FILTER (found AND matches) / count(*)::DOUBLE AS accuracy FROM k WHERE checked GROUP BY 1""",
)
def field_accuracy(t):
    """Share of right values per field."""
    return evaluate.field_accuracy(truth(t), parsed(t))


def _tiers(t):
    nation, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    truth_rows = t.customer.select(
        F.col("c_custkey").alias("file"),
        F.when(segment == "BUILDING", "exact").when(segment == "MACHINERY", "near-miss").otherwise("unknown").alias("expected"),
        F.when(segment.isin("BUILDING", "MACHINERY"), F.col("c_custkey").cast("string")).alias("expected_id"),
    )
    answers = t.customer.filter(nation < 23).select(
        F.col("c_custkey").alias("file"),
        F.when(nation < 8, "auto").when(nation < 16, "suggested").otherwise("none").alias("vendor_confidence"),
        F.when(nation < 16, F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string")).otherwise("0")).alias("vendor_selected_id"),
    )
    return evaluate.tier_outcomes(truth_rows, answers)


@query(
    "tier_confusion",
    """WITH k AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'exact' WHEN 'MACHINERY' THEN 'near-miss' ELSE 'unknown' END AS expected, CASE WHEN c_nationkey < 8 THEN 'auto' WHEN c_nationkey < 16 THEN 'suggested' ELSE 'none' END AS tier,
      c_acctbal > 0 OR c_custkey = 0 AS same FROM customer)
    SELECT expected, count(*) FILTER (tier = 'auto') AS auto, count(*) FILTER (tier = 'suggested') AS suggested, count(*) FILTER (tier = 'none') AS none,
      count(*) FILTER ((expected = 'exact' AND tier = 'auto' AND same) OR (expected = 'near-miss' AND tier = 'suggested' AND same) OR (expected = 'unknown' AND tier = 'none')) AS correct FROM k GROUP BY 1""",
)
def tier_confusion(t):
    """Expected kind of match against the tier reached."""
    return evaluate.tier_confusion(_tiers(t))


@query(
    "posted_checks",
    """SELECT o_orderkey || '.pdf' AS file, true AS posted, o_orderstatus <> 'P' AS amount_ok, o_orderstatus <> 'O' AS number_ok, o_orderdate < TIMESTAMP '1999-01-01' AS date_ok,
      CASE WHEN o_orderpriority < '3' THEN o_orderpriority < '2' END AS payment_ok, CASE WHEN o_orderpriority < '3' THEN true END AS paid_from_ok,
      CASE WHEN o_orderpriority >= '3' AND o_orderpriority < '5' THEN true END AS due_ok FROM orders WHERE o_custkey >= 100""",
)
def posted_checks(t):
    """Posted entries against the truth, field by field."""
    p = F.left("o_orderpriority", F.lit(1))
    name = F.concat(F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file")
    plan = t.orders.select(
        name, (F.col("o_custkey") < 100).alias("exclude"), F.when(p < "3", "expense").otherwise("bill").alias("entry_type"),
        F.lit("CreditCard").alias("expected_payment_type"), F.lit("41").alias("expected_paid_from_id"),
    )
    posted = parsed(t).select(
        F.col("original_filename").alias("file"), "total_cents", F.col("invoice_number").alias("doc_number"), F.col("invoice_date").alias("txn_date")
    )
    extra = t.orders.select(
        name, F.date_add("o_orderdate", 30).alias("due_date"), F.when(p == "1", "CreditCard").otherwise("Check").alias("payment_type"), F.lit("41").alias("paid_from_id")
    )
    facts = truth(t).withColumn("file", F.substring_index("file", "/", -1))
    return evaluate.posted_checks(plan, facts, posted.join(extra, "file"))


@query(
    "category_resolution",
    """SELECT count(*) AS documents, count(*) FILTER (p_size > 2) AS inferred, count(*) FILTER (p_size > 10) AS resolved, count(*) FILTER (p_size > 45) AS long_phrases FROM part""",
)
def category_resolution(t):
    size = F.col("p_size")
    docs = t.part.select(
        F.when(size > 45, F.concat_ws(" ", "p_name", "p_name", "p_type")).when(size > 2, F.col("p_name")).when(size > 1, " ").alias("phrase"),
        F.when(size > 30, "auto").when(size > 10, "suggested").otherwise("none").alias("tier"),
    )
    return evaluate.category_resolution(docs)


@query(
    "corpus_invariants",
    """WITH l AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS lines FROM lineitem GROUP BY 1)
    SELECT CAST(l_orderkey AS VARCHAR) AS file, l_orderkey % 7 <> 0 AS total_ok, l_orderkey % 5 <> 0 AS lines_ok FROM l""",
)
def corpus_invariants(t):
    """Do the parts of the truth add up? An order is the document, its lines the printed lines."""
    lines = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("file"), "l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount_cents")
    )
    wrong = lambda n: F.when(F.pmod("l_orderkey", F.lit(n)) == 0, 1).otherwise(0)
    subtotal = F.sum("amount_cents") + wrong(5)
    docs = lines.groupBy("file", "l_orderkey").agg(subtotal.alias("subtotal_cents"), F.lit(100).alias("tax_cents"), (subtotal + 100 + wrong(7)).alias("total_cents"))
    return evaluate.corpus_invariants(docs, lines)
