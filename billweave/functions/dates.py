"""Dates: printed text to DATE, the printed forms of a DATE, and day arithmetic."""

from pyspark.sql import Column, functions as F

from billweave import fixed
from billweave.functions.text import NOT_LINE_END, SPACE, is_blank, trim_all

# Each rewrite turns one printed layout into =year-month-day; a double == marks a year
# that may still be two digits long (no printed = gets this far). Every step reads the text once, so
# nothing runs twice in the generated code.
_SHORT = [m[:3] for m in fixed.MONTHS]
_NAMES = "|".join(f"({m[:3]})(?:{m[3:]})?" for m in fixed.MONTHS)
_LAYOUTS = (
    (rf"^([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}})(?:[t ]{NOT_LINE_END}*)?\z", "=$1-$2-$3"),
    (r"^(1[3-9]|[2-9][0-9])[/.-]([0-9]{1,2})[/.-]([0-9]{2}|[0-9]{4})\z", "==$3-$2-$1"),
    (r"^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{2}|[0-9]{4})\z", "==$3-$1-$2"),
    (r"^==([0-6][0-9])-", "=20$1-"),
    (r"^==([7-9][0-9])-", "=19$1-"),
    (rf"^([a-z]{{3,9}})\.?{SPACE}+([0-9]{{1,2}})(?:st|nd|rd|th)?,?{SPACE}+([0-9]{{4}})\z", "=$3-$1-$2"),
    (rf"^([0-9]{{1,2}})(?:st|nd|rd|th)?{SPACE}+([a-z]{{3,9}})\.?,?{SPACE}+([0-9]{{4}})\z", "=$3-$2-$1"),
    (rf"-(?:{_NAMES})-", "-" + "".join(f"${i}" for i in range(1, 13)) + "-"),
)


# what the second and third layout read
_NUMERIC = r"^[0-9]{1,2}[/.-][0-9]{1,2}[/.-](?:[0-9]{2}|[0-9]{4})\z"
_READ = r"^={1,2}([1-9][0-9]{3}-[0-9]{1,2}-[0-9]{1,2})\z"


def printed_to_date(raw: Column) -> Column:
    """DATE of a printed date, null when absent or unreadable.

    Numeric dates are month-first unless the first number cannot be a month. Dates that
    are written year first are read as they are, plain numeric ones by their own layouts, and named months are only
    looked for where there are letters.
    """
    trimmed = trim_all(raw)
    return (
        F.when(F.rlike(trimmed, F.lit(r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}\z")), trimmed.try_cast("date"))
        .when(F.rlike(trimmed, F.lit(_NUMERIC)), _numeric_to_date(trimmed))
        .otherwise(_any_to_date(raw))
    )


def _numeric_to_date(text: Column) -> Column:
    for pattern, layout in _LAYOUTS[1:5]:
        text = F.regexp_replace(text, pattern, layout)
    return F.regexp_extract(text, _READ, 1).try_cast("date")


def _any_to_date(raw: Column) -> Column:
    text = F.translate(F.lower(trim_all(raw)), "=", "?")
    for pattern, layout in _LAYOUTS:
        text = F.regexp_replace(text, pattern, layout)
    numeric = F.regexp_extract(text, _READ, 1)
    return F.when(F.rlike(text, F.lit(r"^=[^a-z]*\z")), numeric.try_cast("date")).otherwise(_named_to_date(text))


def _named_to_date(text: Column) -> Column:
    for number, name in enumerate(_SHORT, 1):
        text = F.replace(text, F.lit(f"-{name}-"), F.lit(f"-{number}-"))
    return F.regexp_extract(text, _READ, 1).try_cast("date")


def date_is_flagged(raw: Column) -> Column:
    """Something was printed but it is not a date; an absent date is not an error."""
    return ~is_blank(raw) & printed_to_date(raw).isNull()


def iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def is_iso(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z")), F.lit(False))


def printed_forms(date: Column) -> Column:
    """The twelve ways a date may be printed, as an array of lower-case texts."""
    long_name = F.element_at(F.array(*[F.lit(m) for m in fixed.MONTHS]), F.month(date))
    short_name = F.left(long_name, F.lit(3))
    year = F.date_format(date, "yyyy")
    day = F.dayofmonth(date).cast("string")

    def said(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    numeric = [F.date_format(date, p) for p in ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "MM-dd-yyyy", "MM.dd.yyyy", "MM/dd/yy")]
    named = [
        form
        for name in (long_name, short_name)
        for form in (
            said(name, " ", day, ", ", year),
            said(name, " ", day, " ", year),
            said(day, " ", name, " ", year),
        )
    ]
    return F.array(*numeric, *named)


def shift_days(date: Column, days: int) -> Column:
    return F.date_add(date, days)


def days_between(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``; negative when ``end`` is earlier."""
    return F.datediff(end, start)
