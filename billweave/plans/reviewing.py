"""Review queries. Two orders in a row are two copies of one bill; status and priority decide what is missing."""

from pyspark.sql import functions as F

from billweave.operators import posting, review
from billweave.operators.confidence import is_flagged
from billweave.plans.registry import query
from billweave.session import cut_lineage

BATCH_DATE = "2024-03-01"


def _orders(t):
    return t.orders.select(
        F.floor(F.col("o_orderkey") / 2).alias("k"),
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderdate",
        F.left("o_orderpriority", F.lit(1)).alias("p"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    ).withColumn("file_hash", F.sha2(F.col("k").cast("string"), 256))


def documents(t):
    """One row per bill with everything the parse, match and edit tables are made of."""
    return _orders(t).groupBy("k", "file_hash").agg(
        F.min("o_custkey").alias("cust"), F.max("cents").alias("cents"), F.min("p").alias("p"), F.max("o_orderdate").alias("d"),
        F.min_by("o_orderstatus", "o_orderkey").alias("st"),
    )


def files(t):
    st = F.col("o_orderstatus")
    return _orders(t).select(
        F.col("o_orderkey").alias("position"),
        F.concat(F.lit("bill-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"),
        F.when(st == "P", "loaded").when(st == "F", "duplicate-excluded").otherwise("duplicate-in-batch").alias("status"),
        F.col("file_hash").alias("hash"),
    )


def parses(t):
    p = F.col("p")
    return documents(t).select(
        "file_hash",
        F.when(p == "1", "parse-failed").when(p == "2", "cached").otherwise("parsed").alias("parse_status"),
        F.concat(F.lit("Customer "), F.col("cust").cast("string")).alias("vendor"),
        F.when(p != "3", F.concat(F.lit("INV-"), F.col("k").cast("string"), F.when(p == "2", "-A-VERY-LONG-NUMBER").otherwise(""))).alias("invoice_number"),
        F.date_add("d", 30).alias("due_date"),
        F.when(p == "5", 0).otherwise(F.col("cents")).cast("bigint").alias("total_cents"),
        F.when(p == "5", F.array(F.lit("money:totalCents"))).otherwise(F.array().cast("array<string>")).alias("validation_flags"),
        F.when((p == "4") & (F.col("st") == "F"), F.create_map(F.lit("vendor"), F.lit("flagged")))
        .otherwise(F.create_map(F.lit("vendor"), F.lit("low")))
        .alias("field_confidence"),
    )


def matches(t):
    p = F.col("p")
    return documents(t).filter(p <= "3").select(
        "file_hash",
        F.concat(F.lit("V"), F.col("cust").cast("string")).alias("vendor_selected_id"),
        F.when(p == "1", "auto").when(p == "2", "suggested").otherwise("none").alias("vendor_confidence"),
        F.lit("C1").alias("category_selected_id"),
        F.when(F.col("st") == "P", "none").otherwise("auto").alias("category_confidence"),
    )


def edits(t):
    p, st = F.col("p"), F.col("st")
    none = F.lit(None).cast("string")
    return documents(t).filter(F.col("d") >= "1998-01-01").select(
        "file_hash",
        F.when(st == "F", "expense").alias("entry_type"),
        F.when((p != "1") | (st != "F"), F.concat(F.lit("E"), F.col("cust").cast("string"))).alias("vendor_id"),
        p.isin("1", "3", "5").alias("vendor_touched"),
        F.lit("C7").alias("category_account_id"),
        (st != "O").alias("category_touched"),
        F.when(F.col("cust") < 700, "35").alias("paid_from_account_id"),
        F.when(p == "5", "$1,234.5").when((p == "4") & (st == "P"), "abc").alias("amount_text"),
        F.when((p == "3") & (st == "P"), "2024/01/05").alias("txn_date"),
        F.when((p == "2") & (st == "P"), "soon").alias("due_date"),
        none.alias("ref_number"),
        F.when(st == "O", True).alias("included"),
    )


_DOCS = """docs AS (SELECT o_orderkey // 2 AS k, sha256(CAST(o_orderkey // 2 AS VARCHAR)) AS file_hash, min(o_orderkey) AS position, min(o_custkey) AS cust,
  max(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, min(left(o_orderpriority, 1)) AS p, max(o_orderdate) AS d, min_by(o_orderstatus, o_orderkey) AS st FROM orders GROUP BY 1),
seeds AS (SELECT *, 'bill-' || position || '.pdf' AS filename, CASE st WHEN 'P' THEN 'loaded' WHEN 'F' THEN 'duplicate-excluded' ELSE 'duplicate-in-batch' END AS scan_status,
  CASE p WHEN '1' THEN 'parse-failed' WHEN '2' THEN 'cached' ELSE 'parsed' END AS parse_status,
  CASE WHEN p = '1' THEN '' WHEN p = '5' THEN '0.00' ELSE (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS amount_text,
  CASE WHEN p = '1' THEN '' ELSE strftime(d + INTERVAL 30 DAY, '%Y-%m-%d') END AS due_date,
  CASE WHEN p IN ('1', '3') THEN '' ELSE 'INV-' || k || CASE WHEN p = '2' THEN '-A-VERY-LONG-NUMBER' ELSE '' END END AS ref_number, p <> '1' AND st <> 'O' AS included FROM docs),
matched AS (SELECT *, CASE WHEN p <= '2' THEN 'V' || cust END AS vendor_id, CASE p WHEN '1' THEN 'auto' WHEN '2' THEN 'suggested' WHEN '3' THEN 'none' END AS vendor_tier,
  CASE WHEN p <= '3' AND st <> 'P' THEN 'C1' END AS category_account_id, CASE WHEN p <= '3' THEN CASE WHEN st = 'P' THEN 'none' ELSE 'auto' END END AS category_tier FROM seeds),
resolved AS (SELECT file_hash, position, filename, scan_status, parse_status, p, st,
  CASE WHEN e AND st = 'F' THEN 'expense' ELSE 'bill' END AS entry_type,
  CASE WHEN e AND p IN ('1', '3', '5') THEN CASE WHEN p <> '1' OR st <> 'F' THEN 'E' || cust END ELSE vendor_id END AS vendor_id,
  CASE WHEN NOT (e AND p IN ('1', '3', '5')) THEN vendor_tier END AS vendor_tier,
  CASE WHEN e AND st <> 'O' THEN 'C7' ELSE category_account_id END AS category_account_id, CASE WHEN NOT (e AND st <> 'O') THEN category_tier END AS category_tier,
  CASE WHEN e AND st = 'F' AND cust < 700 THEN '35' END AS paid_from_account_id,
  CASE WHEN e AND p = '5' THEN '$1,234.5' WHEN e AND p = '4' AND st = 'P' THEN 'abc' ELSE amount_text END AS amount_text,
  CASE WHEN e AND p = '5' THEN 123450 WHEN p = '5' THEN 0 WHEN p = '1' OR (e AND p = '4' AND st = 'P') THEN NULL ELSE cents END AS amount_cents,
  CASE WHEN e AND p = '3' AND st = 'P' THEN '2024/01/05' ELSE '2024-03-01' END AS txn_date,
  CASE WHEN e AND st = 'F' THEN '' WHEN e AND p = '2' AND st = 'P' THEN 'soon' ELSE due_date END AS due_date, ref_number, CASE WHEN e AND st = 'O' THEN true ELSE included END AS included
  FROM (SELECT *, d >= TIMESTAMP '1998-01-01' AS e FROM matched)),
gaps AS (SELECT *, CASE WHEN vendor_id IS NULL THEN 'pick a vendor' WHEN category_account_id IS NULL THEN 'pick a category' WHEN amount_cents IS NULL THEN 'enter an amount like 1336.00'
  WHEN amount_cents < 1 THEN 'enter an amount greater than zero' WHEN txn_date <> '2024-03-01' THEN 'pick an entry date' WHEN entry_type = 'expense' AND paid_from_account_id IS NULL THEN 'pick the account that paid it'
  WHEN entry_type = 'bill' AND due_date = 'soon' THEN 'fix the due date' WHEN length(ref_number) > 21 THEN 'shorten the reference number to 21 characters or fewer' END AS gap FROM resolved)"""


def seeds(t):
    return review.seed_rows(files(t), parses(t), F.lit(BATCH_DATE))


def rows(t):
    return review.resolve_rows(review.apply_matches(seeds(t), matches(t)), edits(t))


@query(
    "seed_rows",
    f"WITH {_DOCS} SELECT file_hash, position, filename, scan_status, parse_status, amount_text, '2024-03-01' AS txn_date, due_date, ref_number, included FROM seeds",
)
def seed_rows(t):
    """One row per first-listed bill, filled from its parse."""
    return seeds(t).select(
        "file_hash", "position", "filename", "scan_status", "parse_status", "amount_text", "txn_date", "due_date", "ref_number", "included"
    )


@query(
    "apply_matches",
    f"WITH {_DOCS} SELECT file_hash, vendor_id, vendor_tier, category_account_id, category_tier FROM matched",
)
def apply_matches(t):
    return review.apply_matches(seeds(t), matches(t)).select("file_hash", "vendor_id", "vendor_tier", "category_account_id", "category_tier")


_ROW = [
    "file_hash", "position", "entry_type", "vendor_id", "vendor_tier", "category_account_id", "category_tier", "paid_from_account_id",
    "amount_text", "amount_cents", "txn_date", "due_date", "ref_number", "included",
]


@query("resolve_edits", f"WITH {_DOCS} SELECT {', '.join(_ROW)} FROM resolved")
def resolve_edits(t):
    """Seed, match and edit laid over each other."""
    return rows(t).select(*_ROW)


@query(
    "row_gap",
    f"WITH {_DOCS} SELECT file_hash, gap, amount_text <> '' AND coalesce(amount_cents, 0) < 1 AS amount_invalid FROM gaps",
)
def row_gap(t):
    """First missing thing per row, and amounts to mark."""
    return rows(t).select("file_hash", review.row_gap().alias("gap"), review.amount_is_invalid().alias("amount_invalid"))


@query(
    "send_gate",
    f"""WITH {_DOCS}, g AS (SELECT st, count(*) FILTER (included) AS chosen, count(gap) FILTER (included) AS open, min_by(filename, position) FILTER (included AND gap IS NOT NULL) AS f,
      min_by(gap, position) FILTER (included AND gap IS NOT NULL) AS first_gap FROM gaps GROUP BY 1)
    SELECT st AS part, chosen > 0 AND open = 0 AS can_send, CASE WHEN chosen = 0 THEN 'nothing-chosen' WHEN open > 0 THEN 'incomplete' END AS reason, f AS first_file, first_gap,
      greatest(open - 1, 0) AS more_rows FROM g""",
)
def send_gate(t):
    """May the rows of each order status go out as a batch?"""
    parts = documents(t).select("file_hash", F.col("st").alias("part"))
    return review.send_gate(rows(t).join(parts, "file_hash"), ["part"])


@query(
    "batch_totals",
    f"""WITH {_DOCS} SELECT p AS part, count(*) AS rows, count(*) FILTER (entry_type = 'bill') AS bills, count(*) FILTER (entry_type = 'expense') AS expenses,
      CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS total_cents FROM resolved WHERE included GROUP BY 1""",
)
def batch_totals(t):
    parts = documents(t).select("file_hash", F.col("p").alias("part"))
    return review.batch_totals(rows(t).join(parts, "file_hash"), ["part"])


_SENT = """sent AS (SELECT * FROM gaps WHERE included AND amount_cents >= 1 AND vendor_id IS NOT NULL AND category_account_id IS NOT NULL)"""


@query(
    "posting_rows",
    f"""WITH {_DOCS}, {_SENT} SELECT position, file_hash, entry_type, vendor_id, category_account_id, paid_from_account_id, txn_date,
      CASE WHEN entry_type = 'bill' AND due_date <> '' THEN due_date END AS due_date, nullif(ref_number, '') AS ref_number, amount_cents FROM sent""",
)
def posting_rows(t):
    return review.posting_rows(rows(t)).drop("memo")


@query(
    "quality_rules",
    f"""WITH {_DOCS}, {_SENT} SELECT file_hash, array_to_string(list_filter([CASE WHEN txn_date <> '2024-03-01' THEN 'txn_date' END, CASE WHEN entry_type = 'bill' AND due_date = 'soon' THEN 'due_date' END,
      CASE WHEN length(ref_number) > 21 THEN 'ref_number' END], lambda x: x IS NOT NULL), '|') AS failures FROM sent""",
)
def quality_rules(t):
    """Posting rules each outgoing row breaks."""
    return review.posting_rows(rows(t)).select("file_hash", F.array_join(review.quality_failures(), "|").alias("failures"))


@query(
    "batch_size",
    f"WITH {_DOCS}, {_SENT} SELECT entry_type, count(*) AS rows, count(*) BETWEEN 1 AND 500 AS size_ok FROM sent GROUP BY 1",
)
def batch_size(t):
    return review.batch_size_ok(review.posting_rows(rows(t)), ["entry_type"])


@query(
    "batch_violations",
    """WITH r AS (SELECT l_orderkey AS send_id, l_linenumber * 100000 + l_partkey AS position, l_suppkey AS h, CASE WHEN l_returnflag = 'R' THEN 'expense' ELSE 'bill' END AS kind,
      CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'N' THEN '35' END AS paid FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY send_id, h ORDER BY position) > 1 AS again FROM r),
    v AS (SELECT send_id, position, CASE WHEN again THEN 'duplicate-rows' WHEN kind = 'expense' AND paid IS NULL THEN 'expense-needs-account' WHEN kind = 'bill' AND paid IS NOT NULL THEN 'bill-has-paid-from' END AS violation FROM k)
    SELECT send_id, min_by(violation, position) AS violation, CAST(min(position) AS BIGINT) AS position FROM v WHERE violation IS NOT NULL GROUP BY 1""",
)
def batch_violations(t):
    """First broken rule per send; an order is a send, its lines are the rows."""
    flag = F.col("l_returnflag")
    sends = t.lineitem.select(
        F.col("l_orderkey").alias("send_id"),
        (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("position"),
        F.col("l_suppkey").cast("string").alias("file_hash"),
        F.when(flag == "R", "expense").otherwise("bill").alias("entry_type"),
        F.when((F.col("l_linestatus") == "O") & (flag != "N"), "35").alias("paid_from_account_id"),
    )
    return posting.batch_violations(sends, ["send_id"])


@query(
    "duplicate_probes",
    f"""WITH {_DOCS} SELECT file_hash AS row_key, vendor_id, amount_cents, txn_date FROM gaps WHERE vendor_id IS NOT NULL AND amount_cents >= 1 AND txn_date = '2024-03-01'""",
)
def duplicate_probes(t):
    return review.duplicate_probes(rows(t)).withColumn("txn_date", F.col("txn_date").cast("string"))


def sent_before(rows):
    """Entries of earlier batches: bills that name a vendor and an amount were entered up to five days before, some undone or not confirmed."""
    k = F.floor(F.col("position") / 2)
    day = F.date_sub(F.lit(BATCH_DATE).cast("date"), F.pmod(k, F.lit(6)).cast("int"))
    prior = rows.filter((F.coalesce("vendor_id", F.lit("")) != "") & F.col("amount_cents").isNotNull())
    text = lambda name: F.lit(None).cast("string").alias(name)
    return prior.select(
        F.concat(F.lit("e-"), "file_hash").alias("id"), F.sha2(F.concat(F.lit("e-"), k.cast("string")), 256).alias("file_hash"),
        F.lit("b").alias("batch_id"), "vendor_id", "amount_cents", day.alias("txn_date"),
        F.when(F.pmod(k, F.lit(5)) == 0, "failed").otherwise("confirmed").alias("state"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.lit(BATCH_DATE).cast("date")).alias("undone_at"),
        text("filename"), text("entry_type"), text("remote_id"), text("vendor_name"),
    )


def sent_ledger(t):
    """Every third bill entered before is in the ledger, a day later."""
    k = F.floor(F.col("position") / 2)
    posted = F.date_add(F.date_sub(F.lit(BATCH_DATE).cast("date"), F.pmod(k, F.lit(6)).cast("int")), 1)
    return seeds(t).filter(F.pmod(k, F.lit(3)) == 0).select(F.sha2(F.concat(F.lit("e-"), k.cast("string")), 256).alias("hash"), posted.alias("posted_at"))


_BEFORE = """sent AS (SELECT 'e-' || file_hash AS id, vendor_id, amount_cents, DATE '2024-03-01' - CAST((position // 2) % 6 AS INTEGER) AS day, (position // 2) % 3 = 0 AS posted FROM gaps
  WHERE vendor_id IS NOT NULL AND amount_cents IS NOT NULL AND (position // 2) % 5 <> 0 AND (position // 2) % 7 <> 0),
warned AS (SELECT g.file_hash, s.day, s.posted, count(*) OVER (PARTITION BY g.file_hash) AS warnings, row_number() OVER (PARTITION BY g.file_hash ORDER BY s.day, s.id) AS n
  FROM gaps g JOIN sent s ON s.vendor_id = g.vendor_id AND s.amount_cents = g.amount_cents AND s.day >= DATE '2024-03-01' - 3 WHERE g.amount_cents >= 1 AND g.txn_date = '2024-03-01'),
firsts AS (SELECT file_hash, warnings, strftime(CASE WHEN posted THEN day + 1 ELSE day END, '%Y-%m-%d') AS first_day FROM warned WHERE n = 1)"""


def _counts(t):
    """Earlier entries per complete row, looked up among those sent before."""
    return _counts_of(t, cut_lineage(rows(t)))


def _counts_of(t, resolved):
    return posting.duplicate_counts(review.duplicate_probes(resolved), sent_before(resolved), sent_ledger(t))


@query(
    "duplicate_notice",
    f"""WITH {_DOCS}, {_BEFORE} SELECT file_hash AS row_key, CASE WHEN warnings > 1 THEN 'Looks like this was already sent ' || warnings || ' times, first on ' || first_day || '.'
      ELSE 'Looks like this was already sent on ' || first_day || '.' END AS notice FROM firsts""",
)
def duplicate_notice(t):
    """What a row says about the entries of its vendor, amount and days that were sent before."""
    return _counts(t).select("row_key", review.notice_line(F.col("warnings"), F.col("first_day")).alias("notice"))


@query(
    "attention_rows",
    f"""WITH {_DOCS}, {_BEFORE} SELECT file_hash FROM gaps WHERE parse_status = 'parse-failed' OR p = '5' OR (p = '4' AND st = 'F') OR (included AND gap IS NOT NULL)
      OR file_hash IN (SELECT file_hash FROM firsts)""",
)
def attention_rows(t):
    """Rows that want a person: unread, flagged, incomplete or likely duplicates."""
    resolved = cut_lineage(rows(t))  # rows, their questions and what was sent before are all made of them
    return review.attention_rows(resolved, _counts_of(t, resolved), is_flagged()).select("file_hash")


@query(
    "untick_confirmed",
    f"WITH {_DOCS} SELECT file_hash, included AND p <> '4' AS included FROM resolved",
)
def untick_confirmed(t):
    entries = documents(t).select("file_hash", F.when(F.col("p") == "4", "confirmed").otherwise("sent").alias("state"))
    return review.untick_confirmed(rows(t), entries).select("file_hash", "included")
