"""Money, dates, absence words, file names: small tables of input and expected value."""

import random

import pytest
from pyspark.sql import functions as F

from billweave.functions import dates, grounding, money
from billweave.functions.text import collapse
from billweave.operators import cache, ingest, parse


def check(spark, fn, cases, result_type="string"):
    rows = [(k, v) for k, v in cases]
    df = spark.createDataFrame(rows, f"raw string, want {result_type}").withColumn("got", fn(F.col("raw")))
    wrong = df.filter(~F.col("want").eqNullSafe(F.col("got"))).collect()
    assert not wrong, wrong


def test_printed_money(spark):
    cases = {
        "1,234.10": 123410, "12,00": 1200, "1.234,56": 123456, "1,234": 123400, "1,234,567": 123456700, "1.234.567": 123456700,
        "1.234": 123, "19.999": 1999, "12.5": 1250, "$12": 1200, " 108.00 ": 10800, "USD 42.50": 4250, ".5": 50, "0.07": 7,
        "($5.50)": -550, "USD -45.00": -4500, "-$45.00": -4500, "45.00-": -4500, "$45.00 -": -4500, "$1,234.10 CR": -123410,
        "45.00 cr": -4500, "45.00 CR.": -4500, "45.00 DR": 4500, "CREDIT MEMO 45.00": 4500, "$45.00.": 4500, "45.00,": 4500,
        "\u00a05.00\u2003": 500, "90071992547409.91": 9007199254740991, "90071992547409.92": None, "-90071992547409.91": -9007199254740991,
        "99999999999999999999999": None, "000000000000000000012.50": 1250, "N/A": None, "": None, "--": None, "$": None, ".": None,
        None: None, "0": 0, "(0.00)": 0,
    }
    check(spark, money.printed_to_cents, cases.items(), "bigint")


def plain_cents(raw):
    """Slow second opinion, one character at a time."""
    text = raw.strip()
    number = "".join(c for c in text if c in "0123456789.,").rstrip(".,")
    if not any(c.isdigit() for c in number):
        return None
    kinds = {c for c in number if c in ".,"}
    cut = None
    if len(kinds) == 2:
        cut = max(number.rfind("."), number.rfind(","))
    elif kinds:
        mark = kinds.pop()
        if number.count(mark) == 1 and not (mark == "," and len(number) - number.index(mark) == 4):
            cut = number.index(mark)
    whole, part = (number, "") if cut is None else (number[:cut], number[cut + 1 :])
    digits = "".join(c for c in whole if c.isdigit()) or "0"
    cents = int(digits + ("".join(c for c in part if c.isdigit()) + "00")[:2])
    minus = (text[0] == "(" and text[-1] == ")") or text[-1] == "-" or any(
        c == "-" and any(d.isdigit() for d in text[i:]) for i, c in enumerate(text)
    )
    return None if cents > 2**53 - 1 else -cents if minus else cents


def test_printed_money_random(spark):
    random.seed(7)
    texts = {"".join(random.choice("0123456789.,,.-$ ()") for _ in range(random.randint(1, 9))) for _ in range(4000)}
    check(spark, money.printed_to_cents, [(x, plain_cents(x)) for x in texts if x.strip()], "bigint")


def test_typed_money(spark):
    cases = {"1336": 133600, "1336.5": 133650, "1,336.00": 133600, " $1,336.05 ": 133605, "1336.567": None, "-5": None, "": None, "$": None, "0": 0, "007": 700, ".5": None}
    check(spark, money.typed_to_cents, cases.items(), "bigint")


def test_money_text(spark):
    df = spark.createDataFrame([(0,), (7,), (-5,), (133600,), (123456789012,), (-100000,)], "c bigint")
    rows = df.select(money.cents_to_input(F.col("c")), money.cents_to_display(F.col("c")), money.cents_to_decimal_string(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [
        ("0.00", "$0.00", "0.00"), ("0.07", "$0.07", "0.07"), ("-0.05", "-$0.05", None), ("1336.00", "$1,336.00", "1336.00"),
        ("1234567890.12", "$1,234,567,890.12", "1234567890.12"), ("-1000.00", "-$1,000.00", None),
    ]


def test_printed_dates(spark):
    cases = {
        "07/24/2026": "2026-07-24", "2026-07-24": "2026-07-24", "24/07/2026": "2026-07-24", "13/45/2026": None, "2026-02-30": None,
        "July 4, 2026": "2026-07-04", "Jul. 4th 2026": "2026-07-04", "JULY  4 2026": "2026-07-04", "4 July 2026": "2026-07-04",
        "4th Sept, 2026": None, "1/2/69": "2069-01-02", "1/2/70": "1970-01-02", "2026-7-4T10:00": "2026-07-04", "2026-7-4 noon": "2026-07-04",
        "0999-01-01": None, "5-6-26": "2026-05-06", "5.6.26": "2026-05-06", "May 5 2026": "2026-05-05", "next week": None, "": None,
        "2/29/2024": "2024-02-29", "2/29/2023": None, "12/12/123": None, "==26-1-1": None, "=2026-01-01": None,
    }
    check(spark, lambda c: dates.iso(dates.printed_to_date(c)), cases.items())
    flagged = [(k, k != "" and v is None) for k, v in cases.items()]
    check(spark, dates.date_is_flagged, flagged, "boolean")


def test_absence_words(spark):
    cases = {"null": None, "(None)": None, "N/A.": None, " not   applicable": "not   applicable", "unknown": None, "INV-1": "INV-1", "  ": None, "'na'": None, "none of it": "none of it"}
    check(spark, parse.absence_to_null, cases.items())


def test_grounding(spark):
    text = collapse(F.lit("Tax  8.00\nTotal $108.00 credit (450.00) adj -12.50 and 7.25 CR, 1,234.56 on July 4, 2026, ref INV-1042"))
    cents = {800: True, 10800: True, 45000: False, -45000: True, -1250: True, 1250: False, -725: True, 725: False, 123456: True, 0: False, 400: False}
    row = spark.range(1).select(*[grounding.grounds_money(text, F.lit(c)).alias(str(c)) for c in cents]).first()
    assert row.asDict() == {str(k): v for k, v in cents.items()}
    row = spark.range(1).select(
        grounding.grounds_date(text, F.lit("2026-07-04").cast("date")), grounding.grounds_date(text, F.lit("2026-07-05").cast("date")),
        grounding.grounds_token(text, F.lit("INV-1042")), grounding.grounds_token(text, F.lit("INV-104")), grounding.grounds_name(text, F.lit("TOTAL   $108")),
    ).first()
    assert tuple(row) == (True, False, True, False, True)


def test_tax_does_not_ground_inside_total(spark):
    text = collapse(F.lit("total $108.00"))
    assert spark.range(1).select(grounding.grounds_money(text, F.lit(800))).first()[0] is False


def test_file_names(spark):
    cases = {
        "C:\\x\\home\tdepot.pdf": "home depot.pdf", "../../._x.pdf": "x.pdf", "a<b>:c?.jpg. ": "abc.jpg", "///": "upload", None: "upload",
        "x" * 300 + ".pdf": "x" * 176 + ".pdf", "x." + "y" * 300: "x." + "y" * 300, " __a  b.png": "a b.png",
    }
    check(spark, ingest.sanitize_filename, cases.items())


@pytest.mark.parametrize(
    "name,junk,supported,target",
    [
        (".DS_Store", True, False, None), ("Thumbs.db", True, False, None), ("._bill.pdf", True, True, None), (".bill.pdf.icloud", False, False, "bill.pdf"),
        ("bill.PDF", False, True, None), ("bill.docx", False, False, None), ("noext", False, False, None), (".icloud", False, False, ""),
    ],
)
def test_name_rules(spark, name, junk, supported, target):
    c = F.lit(name)
    assert tuple(spark.range(1).select(ingest.is_junk(c), ingest.is_supported(c), ingest.placeholder_target(c)).first()) == (junk, supported, target)


def test_url_host(spark):
    cases = {
        "https://Api.Example.com/v1?x=1": "api.example.com", "https://k:s@host:8443/": "host:8443", "https://host:443": "host", "http://host:443": "host:443",
        "not a url": None, "": None, None: None,
    }
    check(spark, cache.url_host, cases.items())


def test_replies(spark):
    good = '{"vendor": "A", "total": "1"}'
    cases = {
        good: None, f"```json\n{good}\n```": None, f"Sure: {good} bye": None, f"[1] {good}": None, '{"vendor": "A", "total": "1", "vendor": "B"}': None,
        "null": "the reply did not contain a JSON object", "": "the reply did not contain a JSON object", f"{good} {good}": "the reply did not contain a JSON object",
        '{"vendor": 1, "tax": [], "currency": {}}': "vendor: Invalid input: expected string, received number; tax: Invalid input: expected string, received array; "
        "total: Invalid input: expected string, received null; currency: Invalid input: expected string, received object",
    }
    df = spark.createDataFrame(list(cases.items()), "reply string, want string")
    wrong = parse.decode_reply(df).filter(~F.col("want").eqNullSafe(F.col("reply_detail"))).drop("reply_value").collect()
    assert not wrong, wrong
