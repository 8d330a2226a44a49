"""Posting: batches, entries folded from events, payloads, duplicates, reports and undo."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from billweave import fixed
from billweave.functions.dates import days_between, iso
from billweave.functions.money import cents_to_decimal_string
from billweave.functions.text import SPACE, is_blank, packed, unpacked
from billweave.operators.joins import first_per_key, lookup, upsert
from billweave.operators.reference import resolve

UNFINISHED = ("pending", "sent", "failed")
LEDGER_COLUMNS = ["hash", "posted_at", "original_filename", "entity_kind", "remote_id"]


# --- opening a batch -----------------------------------------------------------
def batch_violations(rows: DataFrame, by: list[str]) -> DataFrame:
    """First broken rule per send; a send with any is refused whole.

    Rules: no document twice, an expense names the account that paid, a bill does
    not, at most 500 rows. The first violation in row order is reported; at one row a repeated
    document is seen before the account rules.
    """
    copies = rows.groupBy(*by, "file_hash").agg(
        F.min("position").alias("_1st"), F.count("*").alias("_copies")
    ).filter(F.col("_copies") > 1)
    # the second listing of a document is where the repetition shows
    second = (
        rows.join(copies, [*by, "file_hash"])
        .filter(F.col("position") > F.col("_1st"))
        .groupBy(*by)
        .agg(F.min("position").alias("position"))
        .select(*by, "position", F.lit(0).alias("_rank"), F.lit("duplicate-rows").alias("violation"))
    )
    paid = F.coalesce(F.col("paid_from_account_id"), F.lit(""))
    account = (
        F.when((F.col("entry_type") == "expense") & (paid == ""), "expense-needs-account")
        .when((F.col("entry_type") == "bill") & F.col("paid_from_account_id").isNotNull(), "bill-has-paid-from")
    )
    wrong = rows.withColumn("violation", account).filter(F.col("violation").isNotNull()).select(
        *by, "position", F.lit(1).alias("_rank"), "violation"
    )
    too_long = rows.groupBy(*by).count().filter(F.col("count") > fixed.BATCH_MAX_ROWS).select(
        *by, F.lit(-1).alias("position"), F.lit(-1).alias("_rank"), F.lit("too-many-rows").alias("violation")
    )
    found = second.unionByName(wrong).unionByName(too_long)
    return first_per_key(found, by, ["position", "_rank"], ["violation", "position"])


def _newest_with(batches: DataFrame, entries: DataFrame) -> DataFrame:
    return (
        batches.join(entries.select(F.col("batch_id").alias("id")).distinct(), "id", "left_semi")
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(1)
    )


def resumable_batch(batches: DataFrame, entries: DataFrame) -> DataFrame:
    """Newest batch with an entry that is pending, sent or failed (at most one row)."""
    return _newest_with(batches, entries.filter(F.col("state").isin(*UNFINISHED)))


def undoable_batch(batches: DataFrame, entries: DataFrame) -> DataFrame:
    """Newest batch with a confirmed entry that is not undone (at most one row)."""
    return _newest_with(batches, entries.filter((F.col("state") == "confirmed") & F.col("undone_at").isNull()))


def request_id(batch_id: Column, file_hash: Column) -> Column:
    """Idempotency key. Derived, so a retried task or a rerun writes the same one."""
    return F.sha2(F.concat_ws("|", F.lit("request"), batch_id, file_hash), 256)


ENTRY_FIELDS = [
    "filename",
    "entry_type",
    "vendor_id",
    "vendor_name",
    "category_account_id",
    "category_account_name",
    "paid_from_account_id",
    "paid_from_account_name",
    "txn_date",
    "due_date",
    "ref_number",
    "memo",
    "amount_cents",
]


def name_rows(rows: DataFrame, reference: DataFrame, parsed: DataFrame) -> DataFrame:
    """Adds vendor, category and paid-from names (inactive records included) and the file name."""
    named = resolve(rows, reference, "vendor", "vendor_id", "vendor_name")
    named = resolve(named, reference, "account", "category_account_id", "category_account_name")
    named = resolve(named, reference, "account", "paid_from_account_id", "paid_from_account_name")
    files = parsed.select("file_hash", F.col("original_filename").alias("filename"))
    return lookup(named, files, "file_hash")


# --- sending and the fold of events --------------------------------------------
def response_class(status: Column, remote_id: Column, sync_token: Column) -> Column:
    """No status is a transport failure; a success has to name the record it made and its token."""
    named = (F.coalesce(remote_id, F.lit("")) != "") & (F.coalesce(sync_token, F.lit("")) != "")
    return (
        F.when(status.isNull(), "unavailable")
        .when(status.isin(401, 403), "not-connected")
        .when((status >= 500) | (status == 429), "unavailable")
        .when((status < 200) | (status >= 300) | ~named, "rejected")
        .otherwise("ok")
    )


def payload_error() -> Column:
    """Why no payload can be built, null when one can."""
    return (
        F.when(F.col("amount_cents") < 0, "amount-negative")
        .when(~F.col("entry_type").isin("bill", "expense"), "wrong-builder")
        .when(
            (F.col("entry_type") == "expense") & (F.coalesce(F.col("paid_from_account_id"), F.lit("")) == ""),
            "expense-needs-account",
        )
    )


def send_outcomes(entries: DataFrame, ledger: DataFrame, responses: DataFrame) -> DataFrame:
    """What sending does to each targeted entry.

    ``responses``: request_id, http_status, remote_id, sync_token; no row means the
    answer never arrived and the entry stays ``sent``. Confirmed entries are
    skipped; a document already in the ledger and a payload that cannot be built
    fail without a call.
    """
    # each entry is shuffled by document and by request: with packed digests, and of its other fields what the outcome needs
    posted = ledger.select(packed(F.col("hash")).alias("_hash"), F.lit(True).alias("_posted"))
    answers = responses.select(
        packed(F.col("request_id")).alias("_request"),
        response_class(F.col("http_status"), F.col("remote_id"), F.col("sync_token")).alias("_class"),
        F.col("remote_id").alias("_remote_id"),
        F.col("sync_token").alias("_sync_token"),
    )
    asked = entries.select(
        "batch_id",
        packed(F.col("file_hash")).alias("_hash"),
        packed(F.col("request_id")).alias("_request"),
        F.when(F.col("state") == "confirmed", "skipped").alias("_skipped"),
        payload_error().alias("_unbuilt"),
        "remote_id",
        "sync_token",
    )
    known = asked.join(posted, "_hash", "left").select(
        *[c for c in asked.columns if c not in ("_skipped", "_unbuilt")],
        F.coalesce("_skipped", F.when(F.col("_posted"), "already-entered"), "_unbuilt").alias("_before"),
    )
    joined = known.join(answers, "_request", "left").select(
        "*", unpacked(F.col("_hash")).alias("file_hash"), unpacked(F.col("_request")).alias("request_id")
    )
    outcome = (
        F.when(F.col("_before").isNotNull(), F.col("_before"))
        .when(F.col("_class").isNull(), "sent")
        .when(F.col("_class") == "ok", "confirmed")
        .otherwise(F.col("_class"))
    )
    new_state = (
        F.when(outcome.isin("skipped", "confirmed"), "confirmed").when(outcome == "sent", "sent").otherwise("failed")
    )
    return joined.select(
        "batch_id",
        "file_hash",
        "request_id",
        outcome.alias("outcome"),
        new_state.alias("new_state"),
        F.when(outcome == "confirmed", F.col("_remote_id")).otherwise(F.col("remote_id")).alias("remote_id"),
        F.when(outcome == "confirmed", F.col("_sync_token")).otherwise(F.col("sync_token")).alias("sync_token"),
    )


STATE_KINDS = ("pending", "sent", "confirmed", "failed")


def fold_events(events: DataFrame) -> DataFrame:
    """Events (batch_id, file_hash, seq, event_ts, kind, remote_id, sync_token, error) -> current entries.

    Kinds: pending, sent, confirmed, failed, undone, undo-refused. Nothing leaves
    ``confirmed``: later state events are ignored, and undo events only count after
    it. Replayed events change nothing. Both steps are map-side combined aggregates.
    """
    key = ["batch_id", "file_hash"]
    sealed = events.filter(F.col("kind") == "confirmed").groupBy(*key).agg(F.min("seq").alias("_sealed"))
    live = events.join(sealed, key, "left").filter(
        F.when(F.col("kind").isin(*STATE_KINDS), F.col("_sealed").isNull() | (F.col("seq") <= F.col("_sealed"))).otherwise(
            F.col("seq") > F.col("_sealed")
        )
    )
    kind, seq, ts = F.col("kind"), F.col("seq"), F.col("event_ts")

    def last(value, *kinds):
        return F.max_by(value, F.when(kind.isin(*kinds), seq))

    clearing = F.struct(F.when(kind == "failed", F.col("error")).alias("error"))
    refusal = F.struct(F.when(kind == "undo-refused", F.col("error")).alias("error"))
    return live.groupBy(*key).agg(
        last(kind, *STATE_KINDS).alias("state"),
        last(ts, "sent").alias("sent_at"),
        last(ts, "confirmed").alias("confirmed_at"),
        last(F.col("remote_id"), "confirmed").alias("remote_id"),
        last(F.col("sync_token"), "confirmed").alias("sync_token"),
        last(clearing, *STATE_KINDS)["error"].alias("error"),
        last(ts, "undone").alias("undone_at"),
        last(refusal, "undone", "undo-refused")["error"].alias("undo_reason"),
        F.max_by(ts, seq).alias("updated_at"),
    )


def ledger_after(ledger: DataFrame, entries: DataFrame, undone: DataFrame) -> DataFrame:
    """Ledger once confirmations are written (a newer one replaces) and undone documents are removed.

    ``entries`` and ``undone`` have ``undone_at``: an undone entry puts no row, and its undo
    removes a document only if no confirmation came after it, so a document that was undone and entered again stays.
    """
    confirmed = entries.filter((F.col("state") == "confirmed") & F.col("undone_at").isNull()).select(
        F.col("file_hash").alias("hash"),
        F.col("confirmed_at").alias("posted_at"),
        F.coalesce("filename", "file_hash").alias("original_filename"),
        entity_kind(F.col("entry_type")).alias("entity_kind"),
        "remote_id",
    )
    newest = confirmed.groupBy("hash").agg(F.max_by(F.struct(*LEDGER_COLUMNS[1:]), F.struct("posted_at", "remote_id")).alias("_r"))
    fresh = newest.select("hash", *[F.col(f"_r.{c}").alias(c) for c in LEDGER_COLUMNS[1:]])
    gone = undone.groupBy(F.col("file_hash").alias("hash")).agg(F.max("undone_at").alias("_undone_at"))
    written = upsert(ledger.select(*LEDGER_COLUMNS), fresh, ["hash"]).join(gone, "hash", "left")
    return written.filter(F.col("_undone_at").isNull() | (F.col("posted_at") > F.col("_undone_at"))).select(*LEDGER_COLUMNS)


# --- payloads ------------------------------------------------------------------
def entity_kind(entry_type: Column) -> Column:
    return F.when(entry_type == "bill", "Bill").otherwise("Purchase")


def payment_type(account_type: Column) -> Column:
    plain = F.lower(F.regexp_replace(account_type, rf"{SPACE}|[_-]", ""))
    return F.when(plain == "creditcard", "CreditCard").otherwise("Check")


def payload_json(account_type: Column) -> Column:
    """JSON body of a bill or a purchase, null when none can be built; absent parts are left out."""
    memo = F.when(~is_blank(F.col("memo")), F.col("memo"))
    number = F.when(F.col("ref_number") != "", F.col("ref_number"))

    def ref(name):
        return F.struct(F.col(name).alias("value"))

    line = F.struct(
        cents_to_decimal_string(F.col("amount_cents")).alias("Amount"),
        F.lit("AccountBasedExpenseLineDetail").alias("DetailType"),
        F.struct(ref("category_account_id").alias("AccountRef")).alias("AccountBasedExpenseLineDetail"),
        memo.alias("Description"),
    )
    bill = F.struct(
        ref("vendor_id").alias("VendorRef"),
        F.col("txn_date").alias("TxnDate"),
        F.array(line).alias("Line"),
        F.col("due_date").alias("DueDate"),
        number.alias("DocNumber"),
        memo.alias("PrivateNote"),
    )
    purchase = F.struct(
        payment_type(account_type).alias("PaymentType"),
        ref("paid_from_account_id").alias("AccountRef"),
        F.struct(F.col("vendor_id").alias("value"), F.lit("Vendor").alias("type")).alias("EntityRef"),
        F.col("txn_date").alias("TxnDate"),
        F.array(line).alias("Line"),
        number.alias("DocNumber"),
        memo.alias("PrivateNote"),
    )
    body = F.when(F.col("entry_type") == "bill", F.to_json(bill)).otherwise(F.to_json(purchase))
    return F.when(payload_error().isNull(), body)


# --- batches and reports -------------------------------------------------------
def _counts() -> list[Column]:
    confirmed = F.col("state") == "confirmed"
    return [
        F.count("state").alias("total"),
        F.count_if(confirmed).alias("confirmed"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(confirmed & F.col("undone_at").isNotNull()).alias("undone"),
    ]


def batch_state(total: Column, confirmed: Column, undone: Column) -> Column:
    return (
        F.when((undone > 0) & (undone == confirmed), "undone")
        .when(undone > 0, "partially-undone")
        .when((total > 0) & (confirmed == total), "complete")
        .otherwise("open")
    )


def batch_counts(batches: DataFrame, entries: DataFrame) -> DataFrame:
    """Every batch with its entry counts and state; entries are counted before the join."""
    counted = entries.groupBy("batch_id").agg(
        *_counts(),
        F.coalesce(
            F.sum(F.when((F.col("state") == "confirmed") & F.col("undone_at").isNull(), F.col("amount_cents"))), F.lit(0)
        ).alias("amount_cents"),
    )
    joined = batches.select(F.col("id").alias("batch_id"), "created_at", "realm_id").join(counted, "batch_id", "left")
    joined = joined.fillna(0, ["total", "confirmed", "failed", "undone", "amount_cents"])
    return joined.withColumn("state", batch_state(F.col("total"), F.col("confirmed"), F.col("undone")))


def batch_list(batches: DataFrame, entries: DataFrame) -> DataFrame:
    return batch_counts(batches, entries).orderBy(F.desc("created_at"), F.desc("batch_id"))


def batch_detail(entries: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Entries in send order; of one batch, or of all with the batch as leading sort key."""
    rows = entries if batch_id is None else entries.filter(F.col("batch_id") == batch_id)
    return rows.orderBy("batch_id", "position", "id")


def report_lines(entries: DataFrame) -> DataFrame:
    """Printable lines: names fall back to ids, a missing file name to the short hash."""

    def shown(name, id_column):
        return F.when(~is_blank(F.col(name)), F.col(name)).otherwise(F.col(id_column))

    return entries.select(
        "batch_id",
        "position",
        "id",
        "file_hash",
        F.coalesce("filename", F.concat(F.left("file_hash", F.lit(12)), F.lit("..."))).alias("filename"),
        shown("vendor_name", "vendor_id").alias("vendor_name"),
        shown("category_account_name", "category_account_id").alias("category_name"),
        F.when(F.col("paid_from_account_id").isNotNull(), shown("paid_from_account_name", "paid_from_account_id")).alias(
            "paid_from_name"
        ),
        "entry_type",
        "txn_date",
        "ref_number",
        "amount_cents",
        "state",
        "remote_id",
        "error",
        "undone_at",
        entry_label(F.col("state"), F.col("undone_at")).alias("status"),
    )


def entry_label(state: Column, undone_at: Column) -> Column:
    return (
        F.when((state == "confirmed") & undone_at.isNotNull(), fixed.ENTRY_REMOVED)
        .when(state == "confirmed", fixed.ENTRY_CONFIRMED)
        .when(state == "failed", fixed.ENTRY_FAILED)
        .when(state == "sent", fixed.ENTRY_SENT)
        .otherwise(fixed.ENTRY_PENDING)
    )


def batch_label() -> Column:
    return (
        F.when(F.col("state") == "undone", fixed.BATCH_UNDONE)
        .when(F.col("state") == "partially-undone", fixed.BATCH_PARTIALLY_UNDONE)
        .when(F.col("failed") > 0, fixed.BATCH_WITH_FAILURES)
        .when(F.col("state") == "complete", fixed.BATCH_COMPLETE)
        .otherwise(fixed.BATCH_OPEN)
    )


def batch_line() -> Column:
    return F.concat_ws(
        ", ",
        F.format_string(fixed.BATCH_LINE_ENTERED, F.col("confirmed") - F.col("undone"), F.col("total")),
        F.when(F.col("failed") > 0, F.format_string(fixed.BATCH_LINE_FAILED, F.col("failed"))),
        F.when(F.col("undone") > 0, F.format_string(fixed.BATCH_LINE_REMOVED, F.col("undone"))),
    )


# --- likely duplicates ---------------------------------------------------------
def prior_entries(entries: DataFrame) -> DataFrame:
    return entries.filter((F.col("state") == "confirmed") & F.col("undone_at").isNull())


def day_bucket(day: Column, window_days: int) -> Column:
    return F.floor(F.unix_date(day) / (2 * window_days + 1))


def near_buckets(probes: DataFrame, window_days: int) -> DataFrame:
    """One row per probe and bucket its window touches: at most two, as a bucket is as wide as the window."""
    first = day_bucket(F.date_sub("txn_date", window_days), window_days)
    last = day_bucket(F.date_add("txn_date", window_days), window_days)
    return probes.withColumn("_bucket", F.explode(F.array_distinct(F.array(first, last))))


def likely_duplicates(probes: DataFrame, entries: DataFrame, window_days: int = fixed.DUPLICATE_WINDOW_DAYS) -> DataFrame:
    """Earlier confirmed entries of the same vendor and amount within a few days of each probe, without the ledger's dates.

    ``probes``: row_key, vendor_id, amount_cents, txn_date DATE. Vendor, amount and
    a bucket of days are equality keys, so a probe only ever meets entries of two
    window widths around it, never a vendor's whole history. The document is ``_hash``, its packed digest.
    """
    prior = prior_entries(entries).select(
        "vendor_id",
        "amount_cents",
        day_bucket(F.col("txn_date"), window_days).alias("_bucket"),
        F.col("txn_date").alias("_day"),
        "batch_id",
        packed(F.col("file_hash")).alias("_hash"),  # shuffled as bytes, twice
        F.col("id").alias("entry_id"),
        "filename",
        "entry_type",
        "remote_id",
        "vendor_name",
    )
    asked = near_buckets(probes.select("row_key", "vendor_id", "amount_cents", "txn_date"), window_days)
    apart = days_between(F.col("txn_date"), F.col("_day"))
    return (
        asked.join(prior, ["vendor_id", "amount_cents", "_bucket"])
        .withColumn("days_apart", apart)
        .filter(F.col("days_apart").between(-window_days, window_days))
        .drop("txn_date", "_bucket")
        .withColumnRenamed("_day", "txn_date")
    )


def dated_duplicates(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """``likely_duplicates`` with the day their document was posted; only matched entries meet the ledger."""
    dated = lookup(found, ledger.select(packed(F.col("hash")).alias("_hash"), "posted_at"), "_hash")
    kept = [c for c in dated.columns if c not in ("_hash", "posted_at")]
    return dated.select(unpacked(F.col("_hash")).alias("file_hash"), *kept, "posted_at")


def duplicate_warnings(
    probes: DataFrame, entries: DataFrame, ledger: DataFrame, window_days: int = fixed.DUPLICATE_WINDOW_DAYS
) -> DataFrame:
    """Earlier confirmed entries of the same vendor and amount within a few days of each probe, with the ledger's dates."""
    return dated_duplicates(likely_duplicates(probes, entries, window_days), ledger)


def duplicate_counts(
    probes: DataFrame, entries: DataFrame, ledger: DataFrame, window_days: int = fixed.DUPLICATE_WINDOW_DAYS
) -> DataFrame:
    """row_key, warnings, first_day of rows that have any warning, without listing them.

    Entries are counted per vendor, amount and day and probes are reduced to their
    distinct questions first, so equal entries never multiply with equal probes.
    """
    daily = (
        prior_entries(entries)
        .groupBy("vendor_id", "amount_cents", F.col("txn_date").alias("_day"))
        .agg(F.count("*").alias("_n"), F.min_by(packed(F.col("file_hash")), "id").alias("_first"))
        .withColumn("_bucket", day_bucket(F.col("_day"), window_days))
    )
    questions = probes.select("vendor_id", "amount_cents", "txn_date").distinct()
    answers = (
        near_buckets(questions, window_days)
        .join(daily, ["vendor_id", "amount_cents", "_bucket"])
        .filter(days_between(F.col("txn_date"), F.col("_day")).between(-window_days, window_days))
        .groupBy("vendor_id", "amount_cents", "txn_date")
        .agg(F.sum("_n").alias("warnings"), F.min("_day").alias("_day"), F.min_by("_first", "_day").alias("_hash"))
    )
    # the ledger is asked for the first entry of an answer only
    dated = lookup(answers, ledger.select(packed(F.col("hash")).alias("_hash"), "posted_at"), "_hash")
    shown = F.coalesce(F.date_format("posted_at", "yyyy-MM-dd"), iso(F.col("_day"))).alias("first_day")
    return probes.join(dated, ["vendor_id", "amount_cents", "txn_date"]).select("row_key", "warnings", shown)


# --- undo ----------------------------------------------------------------------
def undo_decisions(batch: DataFrame, entries: DataFrame, live: DataFrame) -> DataFrame:
    """What undoing a batch does to each of its entries.

    ``live``: entity_kind, remote_id, entity_exists, sync_token, read_error, delete_error
    as read from the remote system. Undone documents leave the ledger. An entry that was
    not read is not undone: only a successful read that finds nothing means it is gone.
    """
    mine = entries.join(batch.select(F.col("id").alias("batch_id")), "batch_id", "left_semi").filter(
        (F.col("state") == "confirmed") & F.col("undone_at").isNull() & F.col("remote_id").isNotNull()
    )
    now = live.select("entity_kind", "remote_id", "entity_exists", F.col("sync_token").alias("_token"), "read_error", "delete_error")
    joined = mine.withColumn("entity_kind", entity_kind(F.col("entry_type"))).join(now, ["entity_kind", "remote_id"], "left")
    changed = ~F.col("_token").eqNullSafe(F.col("sync_token"))
    missing = ~F.col("entity_exists")
    unread = F.col("read_error").isNotNull() | F.col("entity_exists").isNull()
    reason = (
        F.when(F.col("read_error").isNotNull(), F.col("read_error"))
        .when(unread, "not-read")
        .when(missing, "entity-missing")
        .when(changed, "changed")
        .when(F.col("delete_error").isNotNull(), F.col("delete_error"))
    )
    undone = ~unread & (missing | (~changed & F.col("delete_error").isNull()))
    return joined.select("batch_id", "file_hash", "remote_id", undone.alias("undone"), reason.alias("reason"))
