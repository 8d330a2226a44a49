"""Does a value really stand in the source text?

All functions expect text already passed through ``collapse``. A number only
counts when it is not part of a longer number.

Amounts and dates are taken out of a text once, by constant patterns, as the texts they are printed as; a value is then
looked up by its own printed forms. No amount starts inside another one, as digits and marks stand before
such a place; dates may overlap, so they are found at every place.
"""

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from billweave import fixed
from billweave.functions.dates import printed_forms
from billweave.functions.money import fraction_part, group_digits, whole_part
from billweave.functions.text import collapse, quote

_NOT_INSIDE_NUMBER = r"(?<![0-9.,])"
_NUMBER_ENDS = r"(?![0-9])"
_MINUS_AHEAD = r"[-(][^0-9a-z]{0,4}"
_CREDIT_BEHIND = r" ?(?:-|\)|cr(?![a-z0-9_]))"

# an amount has two decimals behind either mark; whole digits may be grouped by the other mark
_WHOLE = "0|[1-9][0-9]*|[1-9][0-9]{0,2}(?:%s[0-9]{3})+"
_AMOUNT = f"{_NOT_INSIDE_NUMBER}(?=[0-9])(?:(?:{_WHOLE % ','})[.]|(?:{_WHOLE % '[.]'}),)[0-9]{{2}}{_NUMBER_ENDS}"
_CHARGE = f"(?=[0-9])(?<!{_MINUS_AHEAD}){_AMOUNT}(?!{_CREDIT_BEHIND})"
_CREDIT = f"(?=[0-9])(?:(?<={_MINUS_AHEAD}){_AMOUNT}|{_AMOUNT}(?={_CREDIT_BEHIND}))"
_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in fixed.MONTHS) + ")"
_DATE_FORMS = (
    "[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2})",
    "[0-9]{2}-[0-9]{2}-[0-9]{4}",
    "[0-9]{2}[.][0-9]{2}[.][0-9]{4}",
    f"{_MONTH} [0-9]{{1,2}},? [0-9]{{4}}",
    f"[0-9]{{1,2}} {_MONTH} [0-9]{{4}}",
)
_DATE = rf"(?=[0-9a-z]){_NOT_INSIDE_NUMBER}(?=((?:{'|'.join(_DATE_FORMS)}){_NUMBER_ENDS}))"


@dataclass(frozen=True)
class Printed:
    """What is printed in a text: amounts by their sign, and dates, each an array of texts."""

    charges: Column
    credits: Column
    dates: Column


def printed_in(text: Column) -> Printed:
    return Printed(
        F.regexp_extract_all(text, F.lit(_CHARGE), F.lit(0)),
        F.regexp_extract_all(text, F.lit(_CREDIT), F.lit(0)),
        F.regexp_extract_all(text, F.lit(_DATE), F.lit(1)),
    )


def _any_of(found: Column, forms: Column) -> Column:
    return F.coalesce(F.arrays_overlap(found, forms), F.lit(False))


def grounds_name(text: Column, value: Column) -> Column:
    return F.coalesce(F.contains(text, collapse(value)), F.lit(False)) & (text != "")


def grounds_token(text: Column, value: Column) -> Column:
    """A pattern of the value's own is only made where the text has it at all."""
    needle = collapse(value)
    whole = F.regexp_like(text, F.concat(F.lit(_NOT_INSIDE_NUMBER), quote(needle), F.lit(_NUMBER_ENDS)))
    return F.when((needle != "") & F.contains(text, needle), whole).otherwise(F.lit(False))


def grounds_date(text: Column, date: Column, printed: Printed | None = None) -> Column:
    return _any_of((printed or printed_in(text)).dates, printed_forms(date))


def amount_forms(cents: Column) -> Column:
    """The four printed forms of an amount: either decimal mark, whole digits grouped or not."""
    whole, fraction = whole_part(cents), fraction_part(cents)
    dot, comma = F.concat(F.lit("."), fraction), F.concat(F.lit(","), fraction)
    return F.array(F.concat(whole, dot), F.concat(group_digits(whole, ","), dot), F.concat(whole, comma), F.concat(group_digits(whole, "."), comma))


def grounds_money(text: Column, cents: Column, printed: Printed | None = None) -> Column:
    """An amount stands in the text with the same sign it has as a value."""
    printed = printed or printed_in(text)
    forms = amount_forms(cents)
    return F.when(cents < 0, _any_of(printed.credits, forms)).otherwise(_any_of(printed.charges, forms))
