"""Money: printed text to integer cents and back, without floating point."""

from pyspark.sql import Column, functions as F

from billweave import fixed
from billweave.functions.text import NOT_LINE_END, trim_all


_CREDIT = (
    rf"^\({NOT_LINE_END}*\)\z"  # (45.00)
    r"|-\z"  # 45.00-
    r"|(?<![A-Za-z0-9_])[cC][rR](?![A-Za-z0-9_])\.?\z"  # 45.00 CR
    r"|-[^0-9]*[0-9]"  # USD -45.00
)
# Where the decimal mark is: the last of two different separators, or a single
# one that is not a comma before exactly three digits. Everything else groups.
_DECIMAL = r"^(?:(?=[0-9,]*\.)(?=[0-9.]*,)([0-9.,]*)[.,]|([0-9]*)(?:\.|,(?![0-9]{3}\z)))([0-9]+)\z"


_LIMIT = str(fixed.MAX_SAFE_INTEGER)
# digit texts above the limit: longer ones, or equal up to some place and greater there
_TOO_LARGE = r"^-?(?:[0-9]{%d,}|%s)\z" % (
    len(_LIMIT) + 1,
    "|".join(
        f"{_LIMIT[:i]}[{int(d) + 1}-9][0-9]{{{len(_LIMIT) - i - 1}}}" for i, d in enumerate(_LIMIT) if d != "9"
    ),
)


def _whole_number(digits: Column) -> Column:
    """Signed digit text to BIGINT; null when unreadable or beyond the exact integer range.

    The range is tested on the text, in line, so that the rewrites before it run once.
    """
    return F.regexp_replace(digits, _TOO_LARGE, "").try_cast("bigint")


# what most amounts look like: nothing to decide about marks, signs or range
_PLAIN = r"^\$?(?:[0-9]{1,12}|[0-9]{1,3}(?:,[0-9]{3}){1,3})\.[0-9]{2}\z"


def printed_to_cents(raw: Column) -> Column:
    """Integer cents of a printed amount, or null when it carries no readable number.

    Extra decimals are cut, never rounded. Plain amounts are only stripped of their marks.
    """
    trimmed = trim_all(raw)
    plain = F.translate(trimmed, "$,.", "").cast("bigint")
    return F.when(F.rlike(trimmed, F.lit(_PLAIN)), plain).otherwise(_any_to_cents(raw))


def _any_to_cents(raw: Column) -> Column:
    """One pass of rewrites, each reading the previous text once, which keeps the generated code small."""
    trimmed = trim_all(raw)
    number = F.regexp_replace(F.regexp_replace(trimmed, r"[^0-9.,]", ""), r"[.,]+\z", "")
    marked = F.translate(F.regexp_replace(number, _DECIMAL, "$1$2d$3"), ".,", "")
    marked = F.regexp_replace(F.regexp_replace(marked, r"^([0-9]+)\z", "$1d"), r"^\z", "none")
    digits = F.regexp_replace(F.concat(marked, F.lit("00")), r"^0*([0-9]*)d([0-9]{2})[0-9]*\z", "$1$2")
    sign = F.when(F.rlike(trimmed, F.lit(_CREDIT)), F.lit("-")).otherwise(F.lit(""))
    return _whole_number(F.concat(sign, digits))


def typed_to_cents(raw: Column) -> Column:
    """Cents of an amount typed by a person: ``$`` and commas allowed, at most two decimals."""
    cleaned = trim_all(F.replace(F.regexp_replace(trim_all(raw), r"^\$", ""), F.lit(","), F.lit("")))
    padded = F.concat(F.regexp_replace(cleaned, r"^([0-9]+)\z", "$1."), F.lit("00"))
    digits = F.regexp_replace(padded, r"^0*([0-9]*)\.([0-9]{2})(?:00|0)?\z", "$1$2")
    return F.when(F.rlike(cleaned, F.lit(r"^[0-9]+(?:\.[0-9]{1,2})?\z")), _whole_number(digits))


def _padded_digits(cents: Column) -> Column:
    digits = F.abs(cents).cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0"))


def whole_part(cents: Column) -> Column:
    digits = _padded_digits(cents)
    return F.substring(digits, F.lit(1), F.length(digits) - 2)


def fraction_part(cents: Column) -> Column:
    return F.right(_padded_digits(cents), F.lit(2))


def group_digits(whole: Column, separator: str) -> Column:
    return F.regexp_replace(whole, r"(?<=[0-9])(?=(?:[0-9]{3})+\z)", separator)


def _sign(cents: Column) -> Column:
    return F.when(cents < 0, F.lit("-")).otherwise(F.lit(""))


def cents_to_input(cents: Column) -> Column:
    """``-1336.05``: what an editable amount starts as."""
    return F.concat(_sign(cents), whole_part(cents), F.lit("."), fraction_part(cents))


def cents_to_display(cents: Column) -> Column:
    """``-$1,336.05``."""
    return F.concat(_sign(cents), F.lit("$"), group_digits(whole_part(cents), ","), F.lit("."), fraction_part(cents))


def cents_to_decimal_string(cents: Column) -> Column:
    """``1336.05`` for amounts that are zero or more, else null (credits are never sent)."""
    return F.when(cents >= 0, F.concat(whole_part(cents), F.lit("."), fraction_part(cents)))


def is_postable(cents: Column) -> Column:
    return F.coalesce(cents.between(fixed.MIN_AMOUNT_CENTS, fixed.MAX_AMOUNT_CENTS), F.lit(False))
