"""Reading a model reply: tolerant about wrapping, strict about types."""

from pyspark.sql import Column, DataFrame, functions as F

from billweave import fixed
from billweave.functions.text import SPACE, trim_all

# Spark's JSON reader stops after the first value. Reading ``[text, mark]`` and
# looking for the mark as second element accepts a text only when all of it is one value.
_MARK = "␞end of text␞"


def _listed(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARK}"]')))


def _only_value(listed: Column) -> Column:
    return F.when(F.try_variant_get(listed, "$[1]", "string") == _MARK, F.variant_get(listed, "$[0]", "variant"))


def _without_fences(reply: Column) -> Column:
    opened = F.regexp_replace(trim_all(reply), rf"^```(?:[jJ][sS][oO][nN])?{SPACE}*", "")
    return trim_all(F.regexp_replace(opened, rf"{SPACE}*```\z", ""))


def _braced(text: Column) -> Column:
    """From the first ``{`` to the last ``}``."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((start > 0) & (end > start) & (end <= F.length(text)), F.substring(text, start, end - start + 1))


def with_reply_value(df: DataFrame, column: str, value: str) -> DataFrame:
    """Adds the VARIANT of a reply: fences stripped, else only its braced part.

    Each step is a column of its own, so a text is rewritten and parsed once.
    """
    return (
        df.withColumn("_bare", _without_fences(F.col(column)))
        .withColumn("_direct", _listed(F.col("_bare")))
        .withColumn("_whole", _only_value(F.col("_direct")))
        .withColumn("_inner", F.when(F.col("_whole").isNull(), _listed(_braced(F.col("_bare")))))
        .withColumn(value, F.coalesce("_whole", _only_value(F.col("_inner"))))
        .drop("_bare", "_direct", "_whole", "_inner")
    )


_KINDS = {"VOID": "null", "STRING": "string", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array"}


def variant_kind(value: Column) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean``, ``null``; SQL null when missing."""
    name = F.substring_index(F.schema_of_variant(value), "<", 1)
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, name), F.when(name.isNotNull(), "number"))


def _key_kind(value: Column, key: str) -> Column:
    return F.coalesce(variant_kind(F.try_variant_get(value, f"$.{key}", "variant")), F.lit("null"))


def reply_errors(value: Column) -> Column:
    """Type errors of a decoded reply, in schema order; a missing key counts as null."""
    checks = []
    for key in fixed.REPLY_KEYS:
        kind = _key_kind(value, key)
        allowed = ["string"] if key in fixed.REPLY_REQUIRED else ["string", "null"]
        checks.append(
            F.when(~kind.isin(*allowed), F.concat(F.lit(f"{key}: Invalid input: expected string, received "), kind))
        )
    return F.when(variant_kind(value) == "object", F.array_compact(F.array(*checks))).otherwise(
        F.array(F.lit(fixed.REPLY_NOT_OBJECT))
    )


def error_detail(errors: Column) -> Column:
    text = F.array_join(errors, "; ")
    cut = F.concat(F.left(text, F.lit(fixed.REPLY_DETAIL_CHARS)), F.lit("..."))
    return F.when(F.size(errors) > 0, F.when(F.length(text) > fixed.REPLY_DETAIL_CHARS, cut).otherwise(text))


def reply_field(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "string")
