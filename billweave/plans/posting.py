"""Posting queries: an order is a batch, its lines are the entries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from billweave.functions import dates
from billweave.functions.text import packed, unpacked
from billweave.operators import posting, sending
from billweave.operators.joins import first_per_key
from billweave.plans.registry import query
from billweave.session import cut_lineage


def entries(t):
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    state = F.when(flag.isin("A", "N"), "confirmed").when(line == "O", "failed").otherwise("pending")
    entry_id = F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 9, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], cents.cast("string"))
    undone = (state == "confirmed") & (F.col("l_discount") > 0.085)
    return t.lineitem.select(
        entry_id.alias("id"),
        F.col("l_orderkey").cast("string").alias("batch_id"),
        F.col("l_linenumber").alias("position"),
        F.sha2(entry_id, 256).alias("file_hash"),
        F.when(flag != "N", F.concat(F.lit("bill-"), F.col("l_partkey").cast("string"), F.lit(".pdf"))).alias("filename"),
        F.when(line == "F", "expense").otherwise("bill").alias("entry_type"),
        F.sha2(F.concat(F.lit("r"), entry_id), 256).alias("request_id"),
        state.alias("state"),
        F.when(state == "confirmed", F.col("l_partkey").cast("string")).alias("remote_id"),
        F.when(state == "confirmed", F.col("l_linenumber").cast("string")).alias("sync_token"),
        F.when(state == "failed", "rejected").alias("error"),
        F.col("l_suppkey").cast("string").alias("vendor_id"),
        F.when(flag == "A", F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))).when(flag == "N", "  ").alias("vendor_name"),
        F.col("l_partkey").cast("string").alias("category_account_id"),
        F.lit(None).cast("string").alias("category_account_name"),
        F.when((line == "F") & (flag != "N"), "35").alias("paid_from_account_id"),
        F.lit("Checking").alias("paid_from_account_name"),
        F.col("l_shipdate").cast("date").alias("txn_date"),
        F.lit(None).cast("date").alias("due_date"),
        F.when(flag != "R", F.concat(F.lit("PO-"), F.col("l_orderkey").cast("string"))).alias("ref_number"),
        F.when(line == "O", " ").alias("memo"),
        cents.alias("amount_cents"),
        F.when(undone, F.date_add("l_shipdate", 40)).alias("undone_at"),
        F.when(state == "confirmed", F.date_add("l_shipdate", 1)).alias("confirmed_at"),
    )


def batches(t):
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderdate").cast("date").cast("string").alias("created_at"),
        F.col("o_orderpriority").alias("realm_id"),
    )


_ENTRIES = """e AS (SELECT *, lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '-' ||
  lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS id, CAST(l_orderkey AS VARCHAR) AS batch_id,
  CASE WHEN l_returnflag IN ('A', 'N') THEN 'confirmed' WHEN l_linestatus = 'O' THEN 'failed' ELSE 'pending' END AS state,
  CASE WHEN l_linestatus = 'F' THEN 'expense' ELSE 'bill' END AS entry_type, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_cents, CAST(l_shipdate AS DATE) AS txn_date,
  l_returnflag IN ('A', 'N') AND l_discount > 0.085 AS undone FROM lineitem),
c AS (SELECT batch_id, count(*) AS total, count(*) FILTER (state = 'confirmed') AS confirmed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (undone) AS undone,
  CAST(coalesce(sum(amount_cents) FILTER (state = 'confirmed' AND NOT undone), 0) AS BIGINT) AS amount_cents FROM e GROUP BY 1),
b AS (SELECT CAST(o_orderkey AS VARCHAR) AS batch_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at, coalesce(total, 0) AS total, coalesce(confirmed, 0) AS confirmed, coalesce(failed, 0) AS failed,
  coalesce(undone, 0) AS undone, coalesce(amount_cents, 0) AS amount_cents FROM orders LEFT JOIN c ON c.batch_id = CAST(o_orderkey AS VARCHAR)),
bs AS (SELECT *, CASE WHEN undone > 0 AND undone = confirmed THEN 'undone' WHEN undone > 0 THEN 'partially-undone' WHEN total > 0 AND confirmed = total THEN 'complete' ELSE 'open' END AS state FROM b)"""


@query("batch_list", f"WITH {_ENTRIES} SELECT batch_id, created_at, total, confirmed, failed, undone, state FROM bs")
def batch_list(t):
    """Every batch with its counts and state, newest first."""
    return posting.batch_list(batches(t), entries(t)).select("batch_id", "created_at", "total", "confirmed", "failed", "undone", "state")


@query(
    "batch_state",
    f"WITH {_ENTRIES} SELECT state, count(*) AS batches, CAST(sum(amount_cents) AS BIGINT) AS amount_cents FROM bs GROUP BY 1",
)
def batch_state(t):
    """Batches and live money per state."""
    return posting.batch_counts(batches(t), entries(t)).groupBy("state").agg(
        F.count("*").alias("batches"), F.sum("amount_cents").alias("amount_cents")
    )


@query(
    "batch_words",
    f"""WITH {_ENTRIES} SELECT batch_id, CASE WHEN state = 'undone' THEN 'Removed' WHEN state = 'partially-undone' THEN 'Partly removed' WHEN failed > 0 THEN 'Needs another try'
      WHEN state = 'complete' THEN 'Sent' ELSE 'Not finished' END AS label, (confirmed - undone) || ' of ' || total || ' entered' || CASE WHEN failed > 0 THEN ', ' || failed || ' did not go in' ELSE '' END ||
      CASE WHEN undone > 0 THEN ', ' || undone || ' later removed' ELSE '' END AS line FROM bs""",
)
def batch_words(t):
    return posting.batch_counts(batches(t), entries(t)).select("batch_id", posting.batch_label().alias("label"), posting.batch_line().alias("line"))


@query(
    "batch_report",
    f"""WITH {_ENTRIES} SELECT batch_id, l_linenumber AS position, id, CASE WHEN l_returnflag <> 'N' THEN 'bill-' || l_partkey || '.pdf' ELSE left(sha256(id), 12) || '...' END AS filename,
      CASE WHEN l_returnflag = 'A' THEN 'Supplier ' || l_suppkey ELSE CAST(l_suppkey AS VARCHAR) END AS vendor_name, CAST(l_partkey AS VARCHAR) AS category_name,
      CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'N' THEN 'Checking' END AS paid_from_name, amount_cents,
      CASE WHEN undone THEN 'Removed' WHEN state = 'confirmed' THEN 'Entered' WHEN state = 'failed' THEN 'Did not go in' ELSE 'Waiting' END AS status FROM e""",
)
def batch_report(t):
    """Printable lines with name, file and status fallbacks."""
    return posting.report_lines(entries(t)).select("batch_id", "position", "id", "filename", "vendor_name", "category_name", "paid_from_name", "amount_cents", "status")


@query("batch_detail", f"WITH {_ENTRIES} SELECT batch_id, l_linenumber AS position, id, state FROM e")
def batch_detail(t):
    """Entries in send order."""
    return posting.batch_detail(entries(t)).select("batch_id", "position", "id", "state")


@query(
    "resumable_batch",
    f"WITH {_ENTRIES} SELECT batch_id AS id, created_at FROM b WHERE batch_id IN (SELECT batch_id FROM e WHERE state <> 'confirmed') ORDER BY created_at DESC, batch_id DESC LIMIT 1",
)
def resumable_batch(t):
    return posting.resumable_batch(batches(t), entries(t)).select("id", "created_at")


@query(
    "undoable_batch",
    f"WITH {_ENTRIES} SELECT batch_id AS id, created_at FROM b WHERE batch_id IN (SELECT batch_id FROM e WHERE state = 'confirmed' AND NOT undone) ORDER BY created_at DESC, batch_id DESC LIMIT 1",
)
def undoable_batch(t):
    return posting.undoable_batch(batches(t), entries(t)).select("id", "created_at")


# --- duplicates ----------------------------------------------------------------
def coarse_entries(t):
    """Entries with amounts in steps of 20,000.00, so that equal amounts occur."""
    return entries(t).withColumn("amount_cents", (F.floor(F.col("amount_cents") / 2000000) + 1) * 2000000)


def probes(t):
    return coarse_entries(t).select(F.col("id").alias("row_key"), "vendor_id", "amount_cents", "txn_date")


def ledger(t):
    """Posted bills; posted one day after the transaction date."""
    posted = entries(t).filter((F.col("state") == "confirmed") & (F.col("entry_type") == "bill"))
    first = posted.groupBy(packed(F.col("file_hash")).alias("hash")).agg(
        F.min(F.date_add("txn_date", 1)).alias("posted_at"),
        F.min("filename").alias("original_filename"),
        F.lit("Bill").alias("entity_kind"),
        F.min("remote_id").alias("remote_id"),
    )
    return first.withColumn("hash", unpacked(F.col("hash")))


_COARSE = f"""{_ENTRIES}, q AS (SELECT id, l_suppkey, (amount_cents // 2000000 + 1) * 2000000 AS cents, txn_date, state, undone, entry_type FROM e),
w AS (SELECT a.id AS row_key, p.id AS entry_id, CAST(p.l_suppkey AS VARCHAR) AS vendor_id, p.cents AS amount_cents, strftime(p.txn_date, '%Y-%m-%d') AS txn_date,
  CAST(p.txn_date - a.txn_date AS INTEGER) AS days_apart, CASE WHEN p.entry_type = 'bill' THEN strftime(p.txn_date + 1, '%Y-%m-%d') END AS posted_at, p.txn_date AS d
  FROM q a JOIN q p ON a.l_suppkey = p.l_suppkey AND a.cents = p.cents AND p.txn_date BETWEEN a.txn_date - 3 AND a.txn_date + 3 WHERE p.state = 'confirmed' AND NOT p.undone)"""


@query("dup_warnings", f"WITH {_COARSE} SELECT row_key, entry_id, vendor_id, amount_cents, txn_date, days_apart, posted_at FROM w")
def dup_warnings(t):
    """Confirmed entries of the same vendor and amount within three days of every entry."""
    # what was shuffled to find them is gone before they meet the ledger; of a document's fields the answer has none
    matched = posting.likely_duplicates(probes(t), coarse_entries(t)).select("row_key", "entry_id", "_hash", "vendor_id", "amount_cents", "txn_date", "days_apart")
    found = posting.dated_duplicates(cut_lineage(matched), ledger(t))
    return found.select(
        "row_key", "entry_id", "vendor_id", "amount_cents", F.col("txn_date").cast("string").alias("txn_date"), "days_apart",
        F.col("posted_at").cast("string").alias("posted_at"),
    )


@query(
    "duplicate_counts",
    f"""WITH {_COARSE}, r AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY d, entry_id) AS n, count(*) OVER (PARTITION BY row_key) AS warnings FROM w)
    SELECT row_key, warnings, coalesce(posted_at, txn_date) AS first_day FROM r WHERE n = 1""",
)
def duplicate_counts(t):
    """Number of warnings and the first day per entry, without listing the warnings."""
    return posting.duplicate_counts(probes(t), coarse_entries(t), ledger(t))


@query(
    "day_arithmetic",
    """SELECT o_orderkey, strftime(o_orderdate - INTERVAL 3 DAY, '%Y-%m-%d') AS day_before, CAST(DATE '2000-03-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS days FROM orders""",
)
def day_arithmetic(t):


    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey", dates.iso(dates.shift_days(day, -3)).alias("day_before"), dates.days_between(day, F.lit("2000-03-01").cast("date")).alias("days")
    )


# --- many sends ----------------------------------------------------------------
#: orders before this day are batches that exist, later ones are sends; a supplier's bill is the document
_FIRST_SEND = "1993-01-01"


#: what places a document in a batch; the rest is what its entry says
_PLACED = ["ordered_at", "realm_id", "id", "position", "state", "entry_type", "paid_from_account_id"]
_SAID = ["vendor_id", "category_account_id", "txn_date", "amount_cents"]


def documents_of_orders(t, wanted=(*_PLACED, *_SAID)):
    """One row per order and document, the first line that has it; of orders that are sends or batches. Computed once."""
    orders = t.orders.select(F.col("o_orderkey").alias("order_no"), F.col("o_orderdate").cast("date").cast("string").alias("ordered_at"), F.col("o_orderpriority").alias("realm_id"))
    lines = entries(t).withColumn("order_no", F.col("batch_id").cast("bigint"))
    # grouped by what the longer texts are made of; with the order's number in the key, lines stay where the join has dealt them
    firsts = first_per_key(lines.join(orders, "order_no"), ["order_no", "vendor_id"], ["position", "id"], [c for c in wanted if c != "vendor_id"])
    texts = {"batch_id": F.col("order_no").cast("string"), "file_hash": F.sha2(F.concat(F.lit("doc-"), F.col("vendor_id")), 256)}
    return cut_lineage(firsts.withColumns(texts).select("order_no", *texts, *wanted))


def _entry_like(rows):
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in zip(_SAID, ("string", "string", "date", "bigint")) if c not in rows.columns})
    names = ["filename", "vendor_name", "category_account_name", "paid_from_account_name", "ref_number", "memo"]
    return rows.withColumns({**{c: F.lit(None).cast("string") for c in names}, "due_date": F.lit(None).cast("date")})


def earlier_batches(t, documents):
    """(batches, entries) from before the sends."""
    orders = batches(t).filter(F.col("created_at") < _FIRST_SEND)
    rows = _entry_like(documents.filter(F.col("ordered_at") < _FIRST_SEND))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("batch_id").orderBy("position", "file_hash")) - 1)  # an order has a few lines
    added = {
        "request_id": F.sha2(F.concat(F.lit("r"), "id"), 256),
        "error": F.when(F.col("state") == "failed", "rejected"),
        "created_at": F.col("ordered_at"),
        "updated_at": F.col("ordered_at"),
    }
    return orders, rows.withColumns(added).drop("order_no", "ordered_at")


def sends(documents):
    """Later orders as sends, those that break no rule."""
    rows = _entry_like(documents.filter(F.col("ordered_at") >= _FIRST_SEND)).withColumnsRenamed({"order_no": "send_no", "ordered_at": "sent_at"})
    # read for every step below: computed once, and what was shuffled for it is gone by then
    return cut_lineage(sending.accepted(rows.withColumn("send_id", F.col("send_no").cast("string")).drop("batch_id", "state", "id")))


# the walk of a realm's sends: ``last`` is the last send before (or the open batch, -1) that has one of its documents
_SENDS = f"""WITH RECURSIVE {_ENTRIES.replace("WITH ", "")},
l AS (SELECT e.*, sha256('doc-' || l_suppkey) AS doc, o.o_orderpriority AS realm_id, strftime(o_orderdate, '%Y-%m-%d') AS on_day, CASE WHEN entry_type = 'expense' AND l_returnflag <> 'N' THEN '35' END AS paid
  FROM e JOIN orders o ON o.o_orderkey = e.l_orderkey),
d AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey, doc ORDER BY l_linenumber, id) = 1),
old AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, doc) - 1 AS place FROM d WHERE on_day < '{_FIRST_SEND}'),
sent AS (SELECT *, l_orderkey AS send_no FROM d WHERE on_day >= '{_FIRST_SEND}' AND l_orderkey NOT IN (SELECT l_orderkey FROM d WHERE entry_type = 'expense' AND paid IS NULL)),
cur AS (SELECT realm_id, batch_id AS open_id, on_day AS open_at FROM old WHERE state <> 'confirmed' QUALIFY row_number() OVER (PARTITION BY realm_id ORDER BY on_day DESC, batch_id DESC) = 1),
u AS (SELECT DISTINCT realm_id, doc, send_no FROM sent UNION ALL SELECT DISTINCT old.realm_id, doc, -1 FROM old JOIN cur ON cur.open_id = old.batch_id),
p AS (SELECT realm_id, doc, send_no, lag(send_no) OVER (PARTITION BY realm_id, doc ORDER BY send_no) AS before FROM u),
n AS (SELECT realm_id, send_no, coalesce(max(before), -2) AS last, row_number() OVER (PARTITION BY realm_id ORDER BY send_no) AS i FROM p WHERE send_no >= 0 GROUP BY realm_id, send_no),
w(realm_id, i, send_no, since, joined) AS (
  SELECT realm_id, 0::BIGINT, -1::BIGINT, -1::BIGINT, true FROM (SELECT DISTINCT realm_id FROM n)
  UNION ALL SELECT n.realm_id, n.i, n.send_no, CASE WHEN last >= since THEN since ELSE n.send_no END, last >= since FROM w JOIN n ON n.realm_id = w.realm_id AND n.i = w.i + 1),
b2 AS (SELECT w.realm_id, w.send_no, since, joined AS resumed, CASE WHEN since = -1 THEN open_id ELSE sha256('batch|' || w.realm_id || '|' || since) END AS batch_id,
    CASE WHEN since = -1 THEN open_at ELSE strftime(o_orderdate, '%Y-%m-%d') END AS created_at
  FROM w LEFT JOIN cur USING (realm_id) LEFT JOIN orders ON o_orderkey = since WHERE w.send_no >= 0)"""


@query("open_batch", f"{_SENDS} SELECT realm_id, send_no, batch_id, created_at, resumed FROM b2")
def open_batch(t):
    """The batch of every send: the realm's open one if it has a document of the send, else a new one."""
    documents = documents_of_orders(t, _PLACED)
    before, held = earlier_batches(t, documents)
    return sending.open_batches(sends(documents), before, held).select("realm_id", "send_no", "batch_id", "created_at", "resumed")


@query(
    "prepare_entries",
    f"""{_SENDS}, r AS (SELECT b2.batch_id AS bid, sent.* EXCLUDE (batch_id) FROM sent JOIN b2 ON b2.send_no = sent.send_no),
    f AS (SELECT bid, doc, arg_max(struct_pack(entry_type, l_suppkey, l_partkey, paid, txn_date, amount_cents, on_day), send_no) AS v, min(send_no) AS first, arg_min(on_day, send_no) AS created, arg_min(l_linenumber, send_no) AS line FROM r GROUP BY 1, 2),
    a AS (SELECT f.*, coalesce(taken, 0) + row_number() OVER (PARTITION BY bid ORDER BY first, line, doc) - 1 AS place FROM f LEFT JOIN (SELECT batch_id, count(*) AS taken FROM old GROUP BY 1) k ON k.batch_id = bid
      WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.batch_id = bid AND old.doc = f.doc))
    SELECT old.batch_id, old.doc AS file_hash, CAST(place AS BIGINT) AS position, sha256('r' || id) AS request_id, CASE WHEN m THEN 'pending' ELSE state END AS state,
      CASE WHEN state = 'failed' AND NOT m THEN 'rejected' END AS error, CASE WHEN m THEN v.entry_type ELSE entry_type END AS entry_type, CAST(CASE WHEN m THEN v.l_partkey ELSE l_partkey END AS VARCHAR) AS category_account_id,
      CASE WHEN m THEN v.paid ELSE paid END AS paid_from_account_id, strftime(CASE WHEN m THEN v.txn_date ELSE txn_date END, '%Y-%m-%d') AS txn_date, CASE WHEN m THEN v.amount_cents ELSE amount_cents END AS amount_cents,
      on_day AS created_at, CASE WHEN m THEN v.on_day ELSE on_day END AS updated_at
      FROM (SELECT old.*, f.v, f.bid IS NOT NULL AND state <> 'confirmed' AS m FROM old LEFT JOIN f ON f.bid = old.batch_id AND f.doc = old.doc) old
    UNION ALL SELECT bid, doc, CAST(place AS BIGINT), sha256('request|' || bid || '|' || doc), 'pending', NULL, v.entry_type, CAST(v.l_partkey AS VARCHAR), v.paid, strftime(v.txn_date, '%Y-%m-%d'), v.amount_cents, created, v.on_day FROM a""",
)
def prepare_entries(t):
    """All entries after the sends: refreshed, left alone where confirmed, appended with places that go on."""
    documents = documents_of_orders(t)
    before, held = earlier_batches(t, documents)
    rows = sends(documents)
    opened = cut_lineage(sending.open_batches(rows, before, held))
    found = sending.prepare_entries(rows, opened, held)
    return found.select(
        "batch_id", "file_hash", F.col("position").cast("bigint").alias("position"), "request_id", "state", "error", "entry_type", "category_account_id", "paid_from_account_id",
        F.col("txn_date").cast("string").alias("txn_date"), "amount_cents", "created_at", "updated_at",
    )


@query(
    "name_rows",
    f"""WITH {_ENTRIES} SELECT id, s_name AS vendor_name, p_name AS category_account_name, CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'N' THEN q.name END AS paid_from_account_name,
      CASE WHEN d.doc_id IS NOT NULL THEN 'bill-' || d.doc_id || '.pdf' END AS filename
    FROM e LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN documents d ON d.doc_id = l_orderkey
      LEFT JOIN (SELECT p_name AS name FROM part WHERE p_partkey = 35) q ON true""",
)
def name_rows(t):
    """Names of vendor, category and paid-from account by id, inactive ones too, and the file names of parsed documents."""
    rows = entries(t).withColumns({"realm_id": F.lit("r"), "file_hash": F.concat(F.lit("doc-"), "batch_id")})
    rows = rows.drop("vendor_name", "category_account_name", "paid_from_account_name", "filename")
    listed = lambda table, kind, key, name, active: table.select(
        F.lit("r").alias("realm_id"), F.lit(kind).alias("entity_kind"), F.col(key).cast("string").alias("entity_id"), F.col(name).alias("name"),
        active.alias("active"), F.lit("Expense").alias("account_type"))
    known = listed(t.supplier, "vendor", "s_suppkey", "s_name", F.col("s_acctbal") > 0).unionByName(listed(t.part, "account", "p_partkey", "p_name", F.col("p_size") > 10))
    key = F.col("doc_id").cast("string")
    parsed = t.documents.select(F.concat(F.lit("doc-"), key).alias("file_hash"), F.concat(F.lit("bill-"), key, F.lit(".pdf")).alias("original_filename"))
    return posting.name_rows(rows, known, parsed).select("id", "vendor_name", "category_account_name", "paid_from_account_name", "filename")


# --- sending -------------------------------------------------------------------
@query(
    "payload_json",
    f"""WITH {_ENTRIES}, p AS (SELECT *, amount_cents // 100 || '.' || lpad(CAST(amount_cents % 100 AS VARCHAR), 2, '0') AS amount, CASE WHEN l_returnflag <> 'R' THEN ',"DocNumber":"PO-' || l_orderkey || '"' ELSE '' END AS doc FROM e)
    SELECT id, CASE WHEN entry_type = 'bill' THEN '{{"VendorRef":{{"value":"' || l_suppkey || '"}},"TxnDate":"' || strftime(txn_date, '%Y-%m-%d') || '","Line":[{{"Amount":"' || amount ||
      '","DetailType":"AccountBasedExpenseLineDetail","AccountBasedExpenseLineDetail":{{"AccountRef":{{"value":"' || l_partkey || '"}}}}}}]' || doc || '}}'
      WHEN l_returnflag <> 'N' THEN '{{"PaymentType":"' || CASE WHEN l_returnflag = 'A' THEN 'CreditCard' ELSE 'Check' END || '","AccountRef":{{"value":"35"}},"EntityRef":{{"value":"' || l_suppkey || '","type":"Vendor"}},"TxnDate":"' ||
      strftime(txn_date, '%Y-%m-%d') || '","Line":[{{"Amount":"' || amount || '","DetailType":"AccountBasedExpenseLineDetail","AccountBasedExpenseLineDetail":{{"AccountRef":{{"value":"' || l_partkey || '"}}}}}}]' || doc || '}}' END AS body FROM p""",
)
def payload_json(t):
    """Bodies of bills and purchases; null where none can be built."""
    rows = entries(t).withColumn("txn_date", F.col("txn_date").cast("string")).withColumn("due_date", F.lit(None).cast("string"))
    account_type = F.when(F.col("vendor_name").startswith("Supplier"), "Credit_Card").otherwise("Bank")
    return rows.select("id", posting.payload_json(account_type).alias("body"))


@query(
    "payment_type",
    """SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'CreditCard' WHEN c_nationkey < 10 THEN 'CreditCard' ELSE 'Check' END AS payment_type FROM customer""",
)
def payment_type(t):
    n = F.col("c_nationkey")
    account = F.when(n < 5, "Credit Card").when(n < 10, "CREDIT-card").when(n < 15, "Bank")
    return t.customer.select("c_custkey", posting.payment_type(account).alias("payment_type"))


def responses(t):
    status = F.when(F.col("l_tax") < 0.02, 200).when(F.col("l_tax") < 0.03, None).when(F.col("l_tax") < 0.04, 503).when(F.col("l_tax") < 0.06, 401).otherwise(400)
    # every answer stands once for each entry of its id; the request's id follows from that, and is made after the count
    tax = t.lineitem.select(
        F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 9, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")).alias("id"),
        status.alias("http_status"), F.col("l_tax"), F.col("l_linenumber"),
    ).withColumn("_entries", F.count("*").over(Window.partitionBy("id"))).filter(F.col("l_tax") < 0.075)
    line = F.col("l_linenumber")
    asked = tax.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_entries").cast("int"))))
    asked = asked.withColumn("request_id", F.sha2(F.concat(F.lit("r"), F.col("id")), 256))
    return asked.select("request_id", "http_status", F.when(line != 2, "n1").alias("remote_id"), F.when(line != 3, "0").alias("sync_token"))


@query(
    "send_outcomes",
    f"""WITH {_ENTRIES}, o AS (SELECT id, CASE WHEN state = 'confirmed' THEN 'skipped' WHEN entry_type = 'expense' AND l_returnflag = 'N' THEN 'expense-needs-account'
      WHEN l_tax >= 0.075 THEN 'sent' WHEN l_tax < 0.02 AND l_linenumber IN (2, 3) THEN 'rejected' WHEN l_tax < 0.02 THEN 'confirmed' WHEN l_tax < 0.04 THEN 'unavailable' WHEN l_tax < 0.06 THEN 'not-connected' ELSE 'rejected' END AS outcome, l_partkey, state FROM e)
    SELECT sha256(id) AS file_hash, outcome, CASE WHEN outcome IN ('skipped', 'confirmed') THEN 'confirmed' WHEN outcome = 'sent' THEN 'sent' ELSE 'failed' END AS new_state,
      CASE WHEN outcome = 'confirmed' THEN 'n1' WHEN state = 'confirmed' THEN CAST(l_partkey AS VARCHAR) END AS remote_id FROM o""",
)
def send_outcomes(t):
    """What sending does to every entry; some answers have no status, some successes no id or no token."""
    return posting.send_outcomes(entries(t), ledger(t), responses(t)).select("file_hash", "outcome", "new_state", "remote_id")


@query(
    "already_entered",
    f"""WITH {_ENTRIES} SELECT sha256(id) AS file_hash, CASE WHEN state = 'confirmed' THEN 'skipped' WHEN entry_type = 'expense' THEN 'already-entered' ELSE 'sent' END AS outcome FROM e""",
)
def already_entered(t):
    """A document already in the ledger is not sent again; here all expenses are."""
    posted = entries(t).filter(F.col("entry_type") == "expense").select(F.col("file_hash").alias("hash")).distinct()
    return posting.send_outcomes(entries(t), posted, responses(t).filter(F.col("http_status") == 0)).select("file_hash", "outcome")


@query(
    "undo_decision",
    f"""WITH {_ENTRIES}, u AS (SELECT * FROM b WHERE batch_id IN (SELECT batch_id FROM e WHERE state = 'confirmed' AND NOT undone)),
    d AS (SELECT e.batch_id, sha256(id) AS file_hash, CAST(l_partkey AS VARCHAR) AS remote_id, CASE WHEN p_size < 5 THEN 'unavailable' WHEN p_size BETWEEN 20 AND 24 THEN 'not-read' WHEN p_size < 10 THEN 'entity-missing' WHEN l_linenumber <> 3 THEN 'changed' WHEN p_size > 40 THEN 'undo-failed' END AS reason
      FROM e JOIN u ON u.batch_id = e.batch_id JOIN part ON p_partkey = l_partkey WHERE e.state = 'confirmed' AND NOT e.undone)
    SELECT *, reason IS NULL OR reason = 'entity-missing' AS undone FROM d""",
)
def undo_decision(t):
    """Undo of every batch that can be undone, against what the remote system holds now."""
    size = F.col("p_size")
    live = t.part.filter(~size.between(20, 24)).select(  # some were never read
        F.explode(F.array(F.lit("Bill"), F.lit("Purchase"))).alias("entity_kind"),
        F.col("p_partkey").cast("string").alias("remote_id"),
        (~size.between(5, 9)).alias("entity_exists"),
        F.lit("3").alias("sync_token"),
        F.when(size < 5, "unavailable").alias("read_error"),
        F.when(size > 40, "undo-failed").alias("delete_error"),
    )
    return posting.undo_decisions(batches(t), entries(t), live)


# --- events --------------------------------------------------------------------
def events(t):
    """Posting events of every entry in event order: pending, sent, an outcome, perhaps a late failure and an undo."""
    e = entries(t)
    steps = F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("pending").alias("kind"), F.lit(True).alias("on")),
        F.struct(F.lit(2).alias("seq"), F.lit("sent").alias("kind"), (F.col("state") != "pending").alias("on")),
        F.struct(F.lit(3).alias("seq"), F.lit("failed").alias("kind"), (F.col("state") == "failed").alias("on")),
        F.struct(F.lit(4).alias("seq"), F.lit("confirmed").alias("kind"), (F.col("state") == "confirmed").alias("on")),
        F.struct(F.lit(5).alias("seq"), F.lit("failed").alias("kind"), (F.col("entry_type") == "bill").alias("on")),
        F.struct(F.lit(6).alias("seq"), F.lit("undo-refused").alias("kind"), (F.col("position") > 4).alias("on")),
        F.struct(F.lit(7).alias("seq"), F.lit("undone").alias("kind"), F.col("undone_at").isNotNull().alias("on")),
    )
    rows = e.select("batch_id", "file_hash", "txn_date", "remote_id", "sync_token", F.explode(steps).alias("_s")).filter("_s.on")
    return rows.select(
        "batch_id", "file_hash", F.col("_s.seq").cast("bigint").alias("seq"), F.date_add("txn_date", F.col("_s.seq")).alias("event_ts"),
        F.col("_s.kind").alias("kind"), "remote_id", "sync_token",
        F.when(F.col("_s.kind").isin("failed", "undo-refused"), F.concat(F.lit("code "), F.col("_s.seq").cast("string"))).alias("error"),
    )


_FOLD = f"""WITH {_ENTRIES} SELECT batch_id, sha256(id) AS file_hash, CASE WHEN state = 'confirmed' THEN 'confirmed' WHEN state = 'failed' OR entry_type = 'bill' THEN 'failed' ELSE 'pending' END AS state,
  CASE WHEN state <> 'pending' THEN strftime(txn_date + 2, '%Y-%m-%d') END AS sent_at, CASE WHEN state = 'confirmed' THEN strftime(txn_date + 4, '%Y-%m-%d') END AS confirmed_at,
  CASE WHEN state = 'confirmed' THEN NULL WHEN entry_type = 'bill' THEN 'code 5' WHEN state = 'failed' THEN 'code 3' END AS error,
  CASE WHEN undone THEN strftime(txn_date + 7, '%Y-%m-%d') END AS undone_at, CASE WHEN state = 'confirmed' AND l_linenumber > 4 AND NOT undone THEN 'code 6' END AS undo_reason FROM e"""


@query("posting_fold", _FOLD)
def posting_fold(t):
    """Event log to current entries; late events after a confirmation change nothing."""
    folded = posting.fold_events(events(t))
    day = lambda c: F.col(c).cast("string").alias(c)
    return folded.select("batch_id", "file_hash", "state", day("sent_at"), day("confirmed_at"), "error", day("undone_at"), "undo_reason")


@query(
    "ledger_write",
    f"""WITH {_ENTRIES}, x AS (SELECT *, sha256(id) AS hash, CAST(l_shipdate AS DATE) + 1 AS on_day, undone AND l_linenumber <= 2 AS again FROM e WHERE state = 'confirmed')
    SELECT hash, 'Purchase' AS entity_kind, strftime(on_day, '%Y-%m-%d') AS posted_at FROM x WHERE entry_type = 'expense' AND NOT undone
    UNION ALL SELECT hash, 'Purchase', strftime(on_day + 60, '%Y-%m-%d') FROM x WHERE entry_type = 'expense' AND again
    UNION ALL SELECT hash, 'Bill', strftime(on_day, '%Y-%m-%d') FROM x WHERE entry_type = 'bill' AND NOT undone""",
)
def ledger_write(t):
    """Ledger of bills extended by confirmed expenses; undone documents are removed unless they were entered again."""
    expenses = entries(t).filter(F.col("entry_type") == "expense")
    again = expenses.filter(F.col("undone_at").isNotNull() & (F.col("position") <= 2)).withColumns(
        {"batch_id": F.concat(F.lit("again-"), F.col("batch_id")), "confirmed_at": F.date_add("confirmed_at", 60), "undone_at": F.lit(None).cast("date")}
    )
    undone = entries(t).filter(F.col("undone_at").isNotNull())
    return posting.ledger_after(ledger(t), expenses.unionByName(again), undone).select("hash", "entity_kind", F.col("posted_at").cast("string").alias("posted_at"))
