"""Accuracy against ground truth."""

from pyspark.sql import DataFrame, functions as F

from billweave.functions.text import SPACE, trim_all
from billweave.operators.joins import left_join_sparse
from billweave.operators.reconcile import category_options


_CHECKS = {
    "total_cents": ("total_cents", "total_cents", False),
    "invoice_number": ("invoice_number", "reference_number", False),
    "invoice_date": ("invoice_date", "txn_date", False),
    "subtotal_cents": ("subtotal_cents", "subtotal_cents", True),
    "tax_cents": ("tax_cents", "tax_cents", True),
}


def field_checks(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row per document and checked field: file, field, found, matches.

    Subtotal and tax are only checked where the truth has them; a document that was
    not parsed is reported with found = false.
    """
    t = truth.select(
        F.substring_index("file", "/", -1).alias("file"),
        *[F.col(right).alias(f"t_{field}") for field, (_, right, _) in _CHECKS.items()],
    )
    p = parsed.select(
        F.col("original_filename").alias("file"),
        F.lit(True).alias("_found"),
        *[F.col(left).alias(f"p_{field}") for field, (left, _, _) in _CHECKS.items()],
    )
    joined = t.join(p, "file", "left")
    cells = [
        F.struct(
            F.lit(field).alias("field"),
            F.col(f"p_{field}").eqNullSafe(F.col(f"t_{field}")).alias("matches"),
            (F.col(f"t_{field}").isNotNull() if optional else F.lit(True)).alias("checked"),
        )
        for field, (_, _, optional) in _CHECKS.items()
    ]
    found = F.coalesce(F.col("_found"), F.lit(False))
    return (
        joined.select("file", found.alias("found"), F.explode(F.array(*cells)).alias("_c"))
        .filter("_c.checked")
        .select("file", "found", F.col("_c.field").alias("field"), (F.col("found") & F.col("_c.matches")).alias("matches"))
    )


def field_accuracy(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    return field_checks(truth, parsed).groupBy("field").agg(
        F.count("*").alias("checked"),
        F.count_if("matches").alias("correct"),
        F.count_if(~F.col("found")).alias("not_parsed"),
        (F.count_if("matches") / F.count("*")).alias("accuracy"),
    )


def tier_outcomes(truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Expected kind against the tier reached; right when the tier fits and the record is the expected one."""
    expected_tier = (
        F.when(F.col("expected") == "exact", "auto").when(F.col("expected") == "near-miss", "suggested").otherwise("none")
    )
    joined = truth.select("file", "expected", "expected_id").join(
        matches.select("file", F.col("vendor_confidence").alias("tier"), "vendor_selected_id"), "file", "left"
    )
    right = (F.coalesce("tier", F.lit("none")) == expected_tier) & F.when(
        expected_tier == "none", F.col("vendor_selected_id").isNull()
    ).otherwise(F.coalesce(F.col("vendor_selected_id") == F.col("expected_id"), F.lit(False)))
    return joined.select("file", "expected", F.coalesce("tier", F.lit("none")).alias("tier"), right.alias("correct"))


def tier_confusion(outcomes: DataFrame) -> DataFrame:
    tiers = ["auto", "suggested", "none"]
    counted = outcomes.groupBy("expected").pivot("tier", tiers).agg(F.count(F.lit(1))).fillna(0, tiers)
    right = outcomes.groupBy("expected").agg(F.count_if("correct").alias("correct"))
    return counted.join(right, "expected")


def posted_checks(plan: DataFrame, truth: DataFrame, posted: DataFrame) -> DataFrame:
    """Planned documents against what the remote system holds, one boolean per compared field."""
    t = truth.select(
        "file",
        *[F.col(c).alias(f"t_{c}") for c in ("total_cents", "reference_number", "txn_date", "due_date")],
    )
    p = posted.select(
        "file",
        F.lit(True).alias("_there"),
        *[F.col(c).alias(f"p_{c}") for c in ("total_cents", "doc_number", "txn_date", "due_date", "payment_type", "paid_from_id")],
    )
    joined = plan.filter(~F.col("exclude")).join(t, "file", "left").join(p, "file", "left")
    expense = F.col("entry_type") == "expense"
    return joined.select(
        "file",
        F.coalesce("_there", F.lit(False)).alias("posted"),
        F.col("p_total_cents").eqNullSafe(F.col("t_total_cents")).alias("amount_ok"),
        F.col("p_doc_number").eqNullSafe(F.col("t_reference_number")).alias("number_ok"),
        F.col("p_txn_date").eqNullSafe(F.col("t_txn_date")).alias("date_ok"),
        F.when(expense, F.col("p_payment_type").eqNullSafe(F.col("expected_payment_type"))).alias("payment_ok"),
        F.when(expense, F.col("p_paid_from_id").eqNullSafe(F.col("expected_paid_from_id"))).alias("paid_from_ok"),
        F.when(~expense & F.col("t_due_date").isNotNull(), F.col("p_due_date").eqNullSafe(F.col("t_due_date"))).alias("due_ok"),
    )


def category_resolution(documents: DataFrame) -> DataFrame:
    """Share of documents whose category phrase resolves at suggested or better, and phrases of more than four words."""
    phrase = trim_all(F.col("phrase"))
    return documents.agg(
        F.count("*").alias("documents"),
        F.count_if(F.coalesce(phrase, F.lit("")) != "").alias("inferred"),
        F.count_if(F.col("tier").isin("auto", "suggested")).alias("resolved"),
        F.count_if(F.size(F.split(phrase, f"{SPACE}+")) > 4).alias("long_phrases"),
    )


def category_outcomes(documents: DataFrame, answers: DataFrame, reference: DataFrame) -> DataFrame:
    """One row over all documents: how many category phrases the matcher resolves, and to what.

    ``documents``: realm_id, file_hash, phrase. ``answers``: what ``reconcile.match_batch`` says of them.
    documents, inferred, long_phrases (more than four words), resolved (suggested or better),
    resolved_share (null without documents), without_record (resolved to no record) and
    not_expense (resolved to anything but an active expense account, as a payment account is; wanted are none).
    """
    key = ["realm_id", "file_hash"]
    given = documents.select(*key, trim_all(F.coalesce("phrase", F.lit(""))).alias("_phrase"))
    picked = answers.select(*key, "category_selected_id", "category_confidence")
    expense = category_options(reference).select("realm_id", F.col("option_id").alias("category_selected_id")).distinct()
    known = left_join_sparse(given.join(picked, key, "left"), expense.withColumn("_expense", F.lit(True)), "category_selected_id", ["realm_id"])
    resolved = F.coalesce(F.col("category_confidence").isin("auto", "suggested"), F.lit(False))
    return known.agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("_phrase") != "").alias("inferred"),
        F.count_if(F.size(F.split("_phrase", f"{SPACE}+")) > 4).alias("long_phrases"),
        F.count_if(resolved).alias("resolved"),
        F.try_divide(F.count_if(resolved), F.count("*")).alias("resolved_share"),
        F.count_if(resolved & F.col("category_selected_id").isNull()).alias("without_record"),
        F.count_if(F.col("category_selected_id").isNotNull() & F.col("_expense").isNull()).alias("not_expense"),
    )


def corpus_invariants(truth: DataFrame, lines: DataFrame) -> DataFrame:
    """Truth rows must add up: subtotal + tax = total, and line amounts = subtotal.

    ``lines``: one row (file, amount_cents) per printed line.
    """
    sums = lines.groupBy("file").agg(F.sum("amount_cents").alias("_lines"))
    return truth.join(sums, "file", "left").select(
        "file",
        (F.col("subtotal_cents") + F.col("tax_cents") == F.col("total_cents")).alias("total_ok"),
        F.coalesce(F.col("_lines") == F.col("subtotal_cents"), F.lit(False)).alias("lines_ok"),
    )
