"""How far each field of a validated bill can be trusted."""

from pyspark.sql import Column, DataFrame, functions as F

from billweave import fixed
from billweave.functions.grounding import Printed, grounds_date, grounds_money, grounds_name, grounds_token, printed_in
from billweave.functions.text import collapse

_TEXT_FIELDS = ("invoiceNumber",)


def agreement_flags(second: str = "second") -> Column:
    """Fields on which a second reading (struct column) differs; none without a second reading."""
    checks = []
    for field in fixed.AGREEMENT_FIELDS:
        name = fixed.FIELD_COLUMNS[field]
        a, b = F.col(name), F.col(f"{second}.{name}")
        if field in _TEXT_FIELDS:
            a, b = collapse(a), collapse(b)
        checks.append(F.when(~a.eqNullSafe(b), fixed.AGREEMENT_PREFIX + field))
    return F.when(F.col(second).isNotNull(), F.array_compact(F.array(*checks))).otherwise(F.array().cast("array<string>"))


def add_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Append agreement flags of image-only files; native files have their own text to check against."""
    names = [fixed.FIELD_COLUMNS[f] for f in fixed.AGREEMENT_FIELDS]
    again = second.select("file_hash", F.struct(*names).alias("second"))
    joined = first.join(again, "file_hash", "left")
    compared = F.when(F.col("route") == "image-only", agreement_flags()).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("validation_flags", F.concat("validation_flags", compared)).drop("second")


def _is_grounded(field: str, text: Column, value: Column, printed: Printed) -> Column:
    if field in fixed.MONEY_FIELDS:
        return grounds_money(text, value, printed)
    if field in ("invoiceDate", "dueDate"):
        return grounds_date(text, value, printed)
    if field == "vendor":
        return grounds_name(text, value)
    if field == "suggestedCategory":
        return F.lit(False)  # an inference, never evidence
    return grounds_token(text, value)


def _condemns(field: str):
    """Test of one flag: any check of exactly this field, except a mere disagreement."""

    def test(flag: Column) -> Column:
        names_field = F.endswith(flag, F.lit(f":{field}")) & (F.instr(flag, ":") == F.length(flag) - len(field))
        return names_field & ~F.startswith(flag, F.lit(fixed.AGREEMENT_PREFIX))

    return test


def field_confidence(source_text: Column, self_report: Column | None = None, printed: Printed | None = None) -> Column:
    """MAP field -> flagged / low / high for the typed bill columns of a row.

    A failed check outranks everything and shows even without a value; then a
    disagreement; then the source text; then the model's own report, else low. ``printed``: columns with
    what ``printed_in`` found in the text, so that it is read once for all fields.
    """
    printed = printed or printed_in(source_text)
    flags = F.coalesce(F.col("validation_flags"), F.array().cast("array<string>"))
    bad_sum = F.array_contains(flags, fixed.ARITHMETIC_FLAG)
    entries = []
    for field, name in fixed.FIELD_COLUMNS.items():
        value = F.col(name)
        condemned = F.exists(flags, _condemns(field))
        if field in fixed.MONEY_FIELDS:
            condemned = condemned | bad_sum
        reported = F.lit("low") if self_report is None else F.coalesce(F.try_element_at(self_report, F.lit(field)), F.lit("low"))
        level = (
            F.when(condemned, "flagged")
            .when(value.isNull(), F.lit(None))
            .when(F.array_contains(flags, fixed.AGREEMENT_PREFIX + field), "low")
            .when(_is_grounded(field, source_text, value, printed), "high")
            .otherwise(reported)
        )
        entries.append(F.struct(F.lit(field).alias("key"), level.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def score_bills(bills: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds field_confidence; ``texts``: file_hash, reference_text (absent on image-only files)."""
    joined = bills.join(texts.select("file_hash", "reference_text"), "file_hash", "left").withColumn(
        "_text", collapse(F.coalesce("reference_text", F.lit("")))
    )
    found = printed_in(F.col("_text"))
    joined = joined.withColumns({"_charges": found.charges, "_credits": found.credits, "_dates": found.dates})
    printed = Printed(F.col("_charges"), F.col("_credits"), F.col("_dates"))
    level = field_confidence(F.col("_text"), printed=printed)
    return joined.withColumn("field_confidence", level).drop("_text", "_charges", "_credits", "_dates", "reference_text")


def flagged_fields() -> Column:
    """Sorted field names to mark; a flag that names no known field marks all money fields."""
    known = F.array(*[F.lit(f) for f in fixed.FIELD_COLUMNS])
    flags = F.coalesce(F.col("validation_flags"), F.array().cast("array<string>"))
    marked = F.map_keys(F.map_filter(F.col("field_confidence"), lambda k, v: v == "flagged"))
    marked = F.coalesce(marked, F.array().cast("array<string>"))
    named = F.transform(flags, lambda f: F.when(F.instr(f, ":") > 0, F.substring(f, F.instr(f, ":") + 1, F.length(f))))

    def with_money(suspects: Column) -> Column:
        hits = F.filter(suspects, lambda f: F.coalesce(F.array_contains(known, f), F.lit(False)))
        stray = F.exists(suspects, lambda f: ~F.coalesce(F.array_contains(known, f), F.lit(False)))
        money = F.when(stray, F.array(*[F.lit(f) for f in fixed.MONEY_FIELDS])).otherwise(F.array().cast("array<string>"))
        return F.array_sort(F.array_union(hits, money))

    # in an array of one, so that it is made once and not at each mention
    return F.get(F.transform(F.array(F.concat(marked, named)), with_money), F.lit(0))


def is_flagged() -> Column:
    levels = F.map_values(F.col("field_confidence"))
    return (F.coalesce(F.size("validation_flags"), F.lit(0)) > 0) | F.coalesce(
        F.exists(levels, lambda v: v == "flagged"), F.lit(False)
    )
