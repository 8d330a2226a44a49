"""From page signals and model replies to validated bills."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from billweave import fixed
from billweave.functions.dates import printed_to_date
from billweave.functions.money import printed_to_cents
from billweave.functions.replies import error_detail, reply_errors, reply_field, with_reply_value
from billweave.functions.text import SPACE, is_blank, trim_all, trim_start

NATIVE = "native"
IMAGE_ONLY = "image-only"

#: page numbers a block of a file covers: what one task sorts by itself
PAGES_A_BLOCK = 256


# --- routing -------------------------------------------------------------------
def page_signals(operations: DataFrame) -> DataFrame:
    """Page-operation rows -> the four routing signals per page.

    Needs file_hash, page_no, page_area, image_area, is_glyph_show,
    is_invisible, font, text; columns that do not apply to an operation are null.
    """
    chars = F.length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, ""))
    area, shows = F.max("page_area"), F.count_if("is_glyph_show")
    return operations.groupBy("file_hash", "page_no").agg(
        F.when(area > 0, F.coalesce(F.sum("image_area"), F.lit(0.0)) / area).otherwise(0.0).alias("bitmap_coverage"),
        F.when(shows > 0, F.count_if(F.col("is_glyph_show") & F.col("is_invisible")) / shows)
        .otherwise(0.0)
        .alias("invisible_glyph_ratio"),
        F.sum(chars).cast("int").alias("non_ws_chars"),
        F.count_distinct("font").cast("int").alias("embedded_fonts"),
    )


def _finite(value: Column) -> Column:
    number = value.cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), 0.0).otherwise(number)


def page_route() -> Column:
    return (
        F.when(_finite(F.col("bitmap_coverage")) >= fixed.BITMAP_COVERAGE_FLOOR, IMAGE_ONLY)
        .when(_finite(F.col("invisible_glyph_ratio")) > fixed.INVISIBLE_GLYPH_CEILING, IMAGE_ONLY)
        .when(
            (_finite(F.col("non_ws_chars")) >= fixed.MIN_NATIVE_CHARS) & (_finite(F.col("embedded_fonts")) >= 1), NATIVE
        )
        .otherwise(IMAGE_ONLY)
    )


def document_route(files: DataFrame, signals: DataFrame) -> DataFrame:
    """files (file_hash, filename) + page signals -> route and page_count per file."""
    pages = signals.groupBy("file_hash").agg(
        F.count("*").cast("int").alias("_pages"), F.avg((page_route() == NATIVE).cast("double")).alias("_native")
    )
    pdf = F.endswith(F.lower("filename"), F.lit(".pdf"))
    native = pdf & (F.coalesce(F.col("_native"), F.lit(0.0)) >= fixed.NATIVE_PAGE_SHARE)
    return (
        files.join(pages, "file_hash", "left")
        .withColumn("route", F.when(F.coalesce(native, F.lit(False)), NATIVE).otherwise(IMAGE_ONLY))
        .withColumn("page_count", F.when(pdf, F.coalesce("_pages", F.lit(0))).otherwise(1))
        .drop("_pages", "_native")
    )


def selected_pages(page_count: Column) -> Column:
    """The same rule as an array of zero-based page numbers."""
    count = F.when(page_count > 0, F.floor(page_count)).otherwise(1)
    long = F.concat(F.sequence(F.lit(0), F.lit(fixed.HEAD_PAGES - 1)), F.sequence(count.cast("int") - fixed.TAIL_PAGES, count.cast("int") - 1))
    return F.when(count <= fixed.MAX_PAGES, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(long)


def pages_are_truncated(page_count: Column) -> Column:
    return F.coalesce(page_count > fixed.MAX_PAGES, F.lit(False))


def reference_text(page_text: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Pages (file_hash, page_no, text) -> clipped reference text per file: reference_text, full_length, text_truncated.

    Pages are joined by a blank line, trimmed, and clipped at 50,000 characters. With ``routes``
    (file_hash, route) only native files have a text.

    Every page gets its place in the joined text by sums in two steps: of the pages inside a block
    of page numbers, then of the blocks of a file. So the pages of a file of any size are dealt over
    tasks, only blocks that reach into the clip are read for their text, and what a file collects
    is the clip itself. Empty files have no row; pages without a file or a number are left out, a
    null text is an empty page, and pages of one number follow each other by a hash of their texts.
    """
    limit = fixed.REFERENCE_TEXT_CHARS
    pages = page_text.filter(F.col("file_hash").isNotNull() & F.col("page_no").isNotNull()).select(
        "file_hash", "page_no", F.floor(F.col("page_no") / PAGES_A_BLOCK).alias("_block"), F.coalesce("text", F.lit("")).alias("_t")
    )
    pages = pages.withColumn("_tie", F.xxhash64("_t"))
    bare = F.length(trim_all(F.col("_t")))
    earlier = Window.partitionBy("file_hash", "_block").orderBy("page_no", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    in_block = F.coalesce(F.sum("_width").over(earlier), F.lit(0))

    sizes = pages.select(
        "file_hash", "page_no", "_block", "_tie", (F.length("_t") + 2).alias("_width"),
        F.when(bare > 0, F.length("_t") - F.length(trim_start(F.col("_t")))).alias("_lead"), bare.alias("_bare"),
    ).withColumn("_first", in_block + F.col("_lead"))
    blocks = sizes.groupBy("file_hash", "_block").agg(
        F.sum("_width").alias("_span"), F.min("_first").alias("_first"), F.max(F.col("_first") + F.col("_bare")).alias("_last")
    )
    if routes is not None:  # asked for short rows, so that no file's texts are shuffled by file
        blocks = blocks.join(routes.filter(F.col("route") == NATIVE).select("file_hash"), "file_hash", "left_semi")
    by_block = Window.partitionBy("file_hash").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file_hash")
    placed = blocks.withColumn("_at", F.coalesce(F.sum("_span").over(by_block), F.lit(0))).select(
        "file_hash", "_block", "_span", "_at",
        F.min(F.col("_at") + F.col("_first")).over(whole).alias("_start"),
        F.max(F.col("_at") + F.col("_last")).over(whole).alias("_end"),
    ).withColumn("_stop", F.least("_end", F.col("_start") + limit))
    reached = placed.filter((F.col("_at") < F.col("_stop")) & (F.col("_at") + F.col("_span") > F.col("_start"))).drop("_span")

    skip = F.greatest(F.col("_start") - F.col("_at"), F.lit(0))
    take = F.least(F.col("_stop") - F.col("_at"), F.col("_width")) - skip
    pieces = (
        pages.withColumn("_width", F.length("_t") + 2)
        .join(reached, ["file_hash", "_block"])
        .withColumn("_at", F.col("_at") + in_block)
        .withColumn("_skip", skip)
        .withColumn("_take", take)
        .filter(F.col("_take") > 0)
        .withColumn("_piece", F.substring(F.concat("_t", F.lit("\n\n")), (F.col("_skip") + 1).cast("int"), F.col("_take").cast("int")))
    )
    length = F.col("_end") - F.col("_start")
    return (
        pieces.groupBy("file_hash", length.alias("full_length"))
        .agg(F.sort_array(F.collect_list(F.struct("_at", "_piece"))).alias("_p"))
        .select("file_hash", F.array_join("_p._piece", "").alias("reference_text"), "full_length", (F.col("full_length") > limit).alias("text_truncated"))
    )


# --- replies -------------------------------------------------------------------
def decode_reply(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Adds reply_value (VARIANT), reply_detail (null when valid) and reply_valid."""
    return (
        with_reply_value(replies, column, "reply_value")
        .withColumn("_errors", reply_errors(F.col("reply_value")))
        .withColumn("reply_detail", error_detail(F.col("_errors")))
        .withColumn("reply_valid", F.size("_errors") == 0)
        .drop("_errors")
    )


def bill_columns() -> list[Column]:
    """The nine raw bill fields of a decoded, valid reply."""
    return [
        F.when(F.col("reply_valid"), reply_field(F.col("reply_value"), key)).alias(f"raw_{key}")
        for key in fixed.REPLY_KEYS
    ]


def _call_slots(calls: DataFrame) -> DataFrame:
    """One column per (rung, attempt): at most three attempts on three rungs can matter."""
    call = F.struct(
        F.lit(True).alias("made"),
        (F.col("error").isNotNull()).alias("failed"),
        F.col("http_status").alias("status"),
        F.col("error"),
        (F.col("error").isNull() & F.col("reply_valid")).alias("valid"),
        F.col("reply_detail").alias("detail"),
        F.col("reply"),
    )
    slots = [
        F.max(F.when((F.col("rung") == rung) & (F.col("attempt") == n), call)).alias(f"_{i}_{n}")
        for i, rung in enumerate(fixed.REPLY_RUNGS)
        for n in (1, 2, 3)
    ]
    return calls.groupBy("file_hash", "pass").agg(*slots)


def extraction_outcome(calls: DataFrame) -> DataFrame:
    """What the recorded calls of one document amount to.

    ``calls``: file_hash, pass, rung, attempt, http_status, error, reply. Rungs
    run from strict to plain. On each, an invalid reply is repaired once and then
    given up; a call error moves to the next rung only when it says the rung is
    not supported; one rejected temperature is answered by one resend.
    """
    slots = _call_slots(decode_reply(calls))

    def rejects_temperature(call):
        server_fault = F.coalesce(call["status"] >= 500, F.lit(False))
        return call["failed"] & ~server_fault & F.rlike(F.coalesce(call["error"], F.lit("")), F.lit("(?i)temperature"))

    def may_descend(call):
        unsupported = call["status"].isin(*fixed.UNSUPPORTED_STATUSES)
        connection = F.rlike(F.coalesce(call["error"], F.lit("")), F.lit(fixed.CONNECTION_ERROR_PATTERN))
        return F.when(call["status"].isNotNull(), unsupported).otherwise(~connection)

    def result(call, reason, rung, repaired, reply):
        failed = reason is not None
        return F.struct(
            F.lit(not failed).alias("ok"),
            F.lit(reason).cast("string").alias("reason"),
            F.lit(rung).alias("rung"),
            F.lit(repaired).alias("repaired"),
            (call["status"] if reason == "call-failed" else F.lit(None).cast("int")).cast("int").alias("status"),
            reply.alias("reply"),
        )

    resent = F.lit(False)
    plans = []
    for i, rung in enumerate(fixed.REPLY_RUNGS):
        one, two, three = (F.col(f"_{i}_{n}") for n in (1, 2, 3))
        resend = F.coalesce(rejects_temperature(one) & ~resent, F.lit(False))
        plans.append((i, rung, F.when(resend, two).otherwise(one), F.when(resend, three).otherwise(two)))
        resent = resent | resend
    outcome = F.lit(None)
    for i, rung, first, repair in reversed(plans):
        last = i == len(plans) - 1
        none = F.lit(None).cast("string")
        stop = result(first, "call-failed", rung, False, none)
        here = F.when(first["made"].isNull(), F.lit(None))
        here = here.when(first["failed"] & may_descend(first), outcome if not last else stop)
        here = (
            here.when(first["failed"], stop)
            .when(first["valid"], result(first, None, rung, False, first["reply"]))
            .when(repair["made"].isNull(), F.lit(None))
            .when(repair["failed"], result(repair, "call-failed", rung, True, first["reply"]))
            .when(repair["valid"], result(repair, None, rung, True, repair["reply"]))
            .otherwise(result(repair, "schema-invalid", rung, True, repair["reply"]))
        )
        outcome = here
    return slots.select("file_hash", "pass", outcome.alias("_o")).select(
        "file_hash",
        "pass",
        F.coalesce("_o.ok", F.lit(False)).alias("ok"),
        F.coalesce("_o.reason", F.when(F.col("_o").isNull(), "no-reply")).alias("reason"),
        "_o.rung",
        F.coalesce("_o.repaired", F.lit(False)).alias("repaired"),
        "_o.status",
        "_o.reply",
    )


def failure_code(reason: Column, status: Column, errno: Column) -> Column:
    """One code per kind of failure; the first two end the batch, the wording is a lookup table of the caller."""
    return (
        F.when(status.isin(401, 403), "auth-rejected")
        .when(status == 429, "rate-limited")
        .when(reason.isin("client-unavailable", "call-failed", "schema-invalid", "unsafe-filename", "pixel-budget", "no-model", "stale-bytes"), reason)
        .when(errno.isin("ENOENT", "EACCES", "EPERM", "EBUSY"), "missing-bytes")
        .otherwise("unreadable")
    )


def is_terminal(code: Column) -> Column:
    return F.coalesce(code.isin("auth-rejected", "rate-limited"), F.lit(False))


def parse_statuses(files: DataFrame) -> DataFrame:
    """Batch outcome per file with the terminal cut-off.

    ``files``: batch_id, position, file_hash, cached BOOLEAN, failure (code or
    null). After a terminal failure every later uncached file fails with the same
    code, so the first one decides; it is found by an aggregate, not a window over
    the batch.
    """
    stops = (
        files.filter(~F.col("cached") & is_terminal(F.col("failure")))
        .groupBy("batch_id")
        .agg(F.min_by(F.struct("position", "failure"), "position").alias("_stop"))
    )
    cut = F.col("position") > F.col("_stop.position")
    failure = F.when(F.col("cached"), F.lit(None)).when(cut, F.col("_stop.failure")).otherwise(F.col("failure"))
    return (
        files.join(stops, "batch_id", "left")
        .withColumn("failure", failure)
        .withColumn(
            "parse_status",
            F.when(F.col("cached"), "cached").when(F.col("failure").isNotNull(), "parse-failed").otherwise("parsed"),
        )
        .drop("_stop")
    )


def parse_summary(statuses: DataFrame) -> DataFrame:
    status = F.col("parse_status")
    return statuses.groupBy("batch_id").agg(
        F.count("*").alias("total"),
        F.count_if(status == "parsed").alias("parsed"),
        F.count_if(status == "parse-failed").alias("failed"),
        F.count_if(status == "cached").alias("cached"),
    )


# --- validation ----------------------------------------------------------------
def absence_to_null(raw: Column) -> Column:
    """Blank text and words that mean "nothing" become null, anything else is trimmed."""
    text = trim_all(raw)
    bare = F.regexp_replace(F.lower(text), r"""^[(\[{"']+|[)\]}"'.]+\z""", "")
    return F.when((text != "") & ~bare.isin(*fixed.ABSENCE_WORDS), text)


def arithmetic_ok(subtotal: Column, tax: Column, total: Column) -> Column:
    """Null when one of the three is absent."""
    return F.abs(subtotal + tax - total) <= fixed.ROUNDING_TOLERANCE_CENTS


def validate_bills(bills: DataFrame) -> DataFrame:
    """raw_* text columns -> typed fields plus the ordered list of failed checks."""
    raw = {k: F.col(f"raw_{k}") for k in fixed.REPLY_KEYS}
    typed = bills.withColumns(
        {
            "vendor": trim_all(F.coalesce(raw["vendor"], F.lit(""))),
            "invoice_number": absence_to_null(raw["invoice_number"]),
            "invoice_date": printed_to_date(raw["invoice_date"]),
            "due_date": printed_to_date(raw["due_date"]),
            "subtotal_cents": printed_to_cents(raw["subtotal"]),
            "tax_cents": printed_to_cents(raw["tax"]),
            "_total": printed_to_cents(raw["total"]),
            "currency": absence_to_null(raw["currency"]),
            "suggested_category": absence_to_null(raw["suggested_category"]),
        }
    )
    unread = lambda key, value: ~is_blank(raw[key]) & value.isNull()
    checks = [
        F.when(F.col("vendor") == "", "missing:vendor"),
        F.when(unread("invoice_date", F.col("invoice_date")), "date:invoiceDate"),
        F.when(unread("due_date", F.col("due_date")), "date:dueDate"),
        F.when(unread("subtotal", F.col("subtotal_cents")), "money:subtotalCents"),
        F.when(unread("tax", F.col("tax_cents")), "money:taxCents"),
        F.when(F.col("_total").isNull(), "money:totalCents"),
        F.when(
            ~arithmetic_ok(F.col("subtotal_cents"), F.col("tax_cents"), F.col("_total")), fixed.ARITHMETIC_FLAG
        ),
    ]
    return (
        typed.withColumn("validation_flags", F.array_compact(F.array(*checks)))
        .withColumn("total_cents", F.coalesce("_total", F.lit(0)))
        .drop("_total")
    )

