"""Queries for routing, replies, validation, confidence and the parse table."""

from pyspark.sql import functions as F

from billweave.functions import dates, grounding, money
from billweave.functions.text import collapse
from billweave.operators import cache, confidence, ingest, parse
from billweave.plans.intake import by_case
from billweave.plans.registry import query


# --- routing -------------------------------------------------------------------
@query(
    "page_signals",
    """SELECT l_suppkey AS file_hash, month(l_shipdate) AS page_no, sum(CASE WHEN l_linestatus = 'F' THEN floor(l_quantity) ELSE 0 END) / 2000.0 AS bitmap_coverage,
      count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'O') / count(*) FILTER (l_returnflag <> 'N')::DOUBLE AS invisible_glyph_ratio,
      CAST(sum(length(l_returnflag || CAST(l_partkey AS VARCHAR))) AS INTEGER) AS non_ws_chars, CAST(count(DISTINCT l_returnflag) AS INTEGER) AS embedded_fonts
    FROM lineitem GROUP BY 1, 2""",
)
def page_signals(t):
    """Line items as page operations of a supplier's monthly pages."""
    ops = t.lineitem.select(
        F.col("l_suppkey").alias("file_hash"),
        F.month("l_shipdate").alias("page_no"),
        F.lit(2000.0).alias("page_area"),
        F.when(F.col("l_linestatus") == "F", F.floor("l_quantity").cast("double")).alias("image_area"),
        (F.col("l_returnflag") != "N").alias("is_glyph_show"),
        (F.col("l_linestatus") == "O").alias("is_invisible"),
        F.col("l_returnflag").alias("font"),
        F.concat(F.lit(" "), "l_returnflag", F.lit("\t"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("text"),
    )
    return parse.page_signals(ops)


def _signals(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("file_hash"),
        F.col("l_linenumber").alias("page_no"),
        F.col("l_partkey"),
        F.when(F.col("l_returnflag") == "R", F.lit(float("nan"))).otherwise(F.col("l_discount") * 10).alias("bitmap_coverage"),
        (F.col("l_tax") * 12).alias("invisible_glyph_ratio"),
        (F.col("l_quantity") * 3).cast("int").alias("non_ws_chars"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("embedded_fonts"),
    )


_ROUTES = """routes AS (SELECT *, CASE WHEN l_returnflag <> 'R' AND l_discount * 10 >= 0.75 THEN 'image-only' WHEN l_tax * 12 > 0.9 THEN 'image-only'
  WHEN l_quantity * 3 >= 50 THEN 'native' ELSE 'image-only' END AS page_route FROM lineitem)"""


@query(
    "page_route",
    f"WITH {_ROUTES} SELECT l_orderkey AS file_hash, l_linenumber AS page_no, l_partkey, page_route FROM routes",
)
def page_route(t):
    """Native or image-only per page; a non-finite signal counts as zero."""
    return _signals(t).select("file_hash", "page_no", "l_partkey", parse.page_route().alias("page_route"))


@query(
    "doc_route",
    f"""WITH {_ROUTES}, p AS (SELECT l_orderkey AS k, count(*) AS n, avg(CASE WHEN page_route = 'native' THEN 1.0 ELSE 0.0 END) AS share FROM routes GROUP BY 1)
    SELECT o_orderkey AS file_hash, CASE WHEN o_orderstatus <> 'F' AND coalesce(share, 0) >= 0.5 THEN 'native' ELSE 'image-only' END AS route,
      CASE WHEN o_orderstatus <> 'F' THEN coalesce(n, 0) ELSE 1 END AS page_count FROM orders LEFT JOIN p ON k = o_orderkey""",
)
def doc_route(t):
    """Documents are native when at least half of their pages are; files without pages survive."""
    files = t.orders.select(
        F.col("o_orderkey").alias("file_hash"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "F", ".jpg").otherwise(".PDF")).alias("filename"),
    )
    return parse.document_route(files, _signals(t)).select("file_hash", "route", "page_count")


@query(
    "page_pick",
    """WITH c AS (SELECT o_custkey AS file_hash, count(*) AS n FROM orders GROUP BY 1)
    SELECT file_hash, CAST(p AS BIGINT) AS page_index, n > 10 AS truncated FROM c, range(0, 100000) r(p) WHERE p < n AND (n <= 10 OR p < 3 OR p >= n - 2)""",
)
def page_pick(t):
    """A customer's orders as pages: all of up to ten, else three from the front and two from the back."""
    files = t.orders.groupBy(F.col("o_custkey").alias("file_hash")).agg(F.count("*").alias("n"))
    return files.select(
        "file_hash",
        F.explode(parse.selected_pages(F.col("n")).cast("array<bigint>")).alias("page_index"),
        parse.pages_are_truncated(F.col("n")).alias("truncated"),
    )


@query(
    "reference_text",
    r"""WITH j AS (SELECT source AS file_hash, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY doc_id),
      '^[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '', 'g') AS t FROM documents GROUP BY 1)
    SELECT file_hash, md5(left(t, 50000)) AS text_md5, length(t) AS full_length, length(t) > 50000 AS text_truncated FROM j WHERE t <> ''""",
)
def reference_text(t):
    """All documents of a source as the pages of one file."""
    pages = t.documents.select(F.col("source").alias("file_hash"), F.col("doc_id").alias("page_no"), "text")
    return parse.reference_text(pages).select(
        "file_hash", F.md5("reference_text").alias("text_md5"), "full_length", "text_truncated"
    )


@query(
    "native_text",
    r"""WITH r AS (SELECT concat(coalesce(source, 'none'), '/', coalesce(lang, 'none')) AS file_hash, avg(CASE WHEN coalesce(n_chars, 0) >= 2000 THEN 1.0 ELSE 0.0 END) >= 0.5 AND coalesce(source, 'none') <> 'src5' AS native FROM documents GROUP BY 1, coalesce(source, 'none')),
    j AS (SELECT concat(coalesce(source, 'none'), '/', coalesce(lang, 'none')) AS file_hash, regexp_replace(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id),
      '^[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '', 'g') AS t FROM documents GROUP BY 1)
    SELECT r.file_hash, CASE WHEN native THEN 'native' ELSE 'image-only' END AS route, CASE WHEN native AND t <> '' THEN md5(left(t, 50000)) END AS text_md5, native AND length(t) > 50000 AS text_truncated FROM r JOIN j ON j.file_hash = r.file_hash""",
)
def native_text(t):
    """Reference text goes along only with files whose pages are mostly native; the others have none."""
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")))
    pages = t.documents.select(name.alias("file_hash"), F.col("doc_id").alias("page_no"), "text", "n_chars", "source")
    signals = pages.select(
        "file_hash", F.lit(0.0).alias("bitmap_coverage"), F.lit(0.0).alias("invisible_glyph_ratio"),
        F.when(F.col("n_chars") >= 2000, F.col("n_chars")).otherwise(0).alias("non_ws_chars"), F.lit(1).alias("embedded_fonts"),
    )
    names = pages.groupBy("file_hash").agg(F.bool_or(F.coalesce(F.col("source") == "src5", F.lit(False))).alias("photo"))
    files = names.select("file_hash", F.concat("file_hash", F.when(F.col("photo"), ".jpg").otherwise(".pdf")).alias("filename"))
    routes = parse.document_route(files, signals).select("file_hash", "route")
    texts = parse.reference_text(pages, routes)
    return routes.join(texts, "file_hash", "left").select(
        "file_hash", "route", F.md5("reference_text").alias("text_md5"), F.coalesce("text_truncated", F.lit(False)).alias("text_truncated")
    )


# --- replies -------------------------------------------------------------------
def _cents(t):
    return t.orders.withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))


_CENTS = "orders_c AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"


def replies(t):
    key = F.col("o_orderkey").cast("string")
    good = F.concat(
        F.lit('{"vendor": "Customer '), F.col("o_custkey").cast("string"), F.lit('", "invoice_number": "INV-'), key,
        F.lit('", "total": "'), money.cents_to_display(F.col("cents")), F.lit('", "tax": null, "extra": [1, {"a": 2}]}'),
    )
    typed = F.concat(F.lit('{"vendor": "Customer '), F.col("o_custkey").cast("string"), F.lit('", "due_date": true, "total": '), key, F.lit("}"))
    wrapped = F.concat(F.lit("Here you are: "), good, F.lit(" Anything else?"))
    priority = F.left("o_orderpriority", F.lit(1))
    reply = (
        F.when(priority == "1", good)
        .when(priority == "2", F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(priority == "3", wrapped)
        .when(priority == "4", typed)
        .otherwise(F.concat(good, F.lit(" "), good))
    )
    return _cents(t).select("o_orderkey", "o_custkey", "cents", reply.alias("reply"))


@query(
    "reply_decode",
    f"""WITH {_CENTS}, k AS (SELECT *, CAST(left(o_orderpriority, 1) AS INTEGER) AS p, CAST(cents // 100 AS VARCHAR) AS w FROM orders_c)
    SELECT o_orderkey, p <= 3 AS reply_valid,
      CASE p WHEN 4 THEN 'due_date: Invalid input: expected string, received boolean; total: Invalid input: expected string, received number'
        WHEN 5 THEN 'the reply did not contain a JSON object' END AS reply_detail,
      CASE WHEN p <= 3 THEN 'Customer ' || o_custkey END AS vendor, CASE WHEN p <= 3 THEN 'INV-' || o_orderkey END AS invoice_number,
      CASE WHEN p <= 3 THEN '$' || format('{{:,}}', cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS total, CAST(NULL AS VARCHAR) AS tax FROM k""",
)
def reply_decode(t):
    """Plain, fenced, wrapped, wrongly typed and broken replies."""
    decoded = parse.decode_reply(replies(t))
    fields = {c: F.col(f"raw_{c}") for c in ("vendor", "invoice_number", "total", "tax")}
    return decoded.select("o_orderkey", "reply_valid", "reply_detail", *parse.bill_columns()).select(
        "o_orderkey", "reply_valid", "reply_detail", *[v.alias(c) for c, v in fields.items()]
    )


def calls(t):
    """Recorded calls: line number picks rung and attempt, a mix of keys picks what came back."""
    n = F.col("l_linenumber")
    kind = F.pmod(F.col("l_orderkey") * 7 + n * n * 3, F.lit(8))
    failed = kind.isin(0, 1, 2, 3)
    return t.lineitem.select(
        F.col("l_orderkey").alias("file_hash"),
        F.lit(1).alias("pass"),
        F.when(n <= 3, "json_schema").when(n <= 5, "json_object").otherwise("plain").alias("rung"),
        F.when(n <= 3, n).when(n <= 5, n - 3).otherwise(n - 5).alias("attempt"),
        by_case(kind, 400, 422, 401).cast("int").alias("http_status"),
        by_case(kind, F.lit("temperature is not supported"), F.lit("bad request"), F.lit("denied"), F.lit("Connection reset")).alias("error"),
        F.when(kind.isin(4, 5), F.concat(F.lit('{"vendor": "v", "total": "'), n.cast("string"), F.lit('"}')))
        .when(~failed, F.lit("{}"))
        .alias("reply"),
    )


_CALL_SQL = """c AS (SELECT l_orderkey AS file_hash, l_linenumber AS n, (l_orderkey * 7 + l_linenumber * l_linenumber * 3) % 8 AS k FROM lineitem),
s AS (SELECT file_hash, max(k) FILTER (n = 1) AS a1, max(k) FILTER (n = 2) AS a2, max(k) FILTER (n = 3) AS a3, max(k) FILTER (n = 4) AS b1,
  max(k) FILTER (n = 5) AS b2, max(k) FILTER (n = 6) AS c1, max(k) FILTER (n = 7) AS c2 FROM c GROUP BY 1),
r AS (SELECT *, coalesce(a1 = 0, false) AS ra, coalesce(a1 <> 0, true) AND coalesce(b1 = 0, false) AS rb FROM s),
q AS (SELECT *, coalesce(a1 <> 0, true) AND coalesce(b1 <> 0, true) AND coalesce(c1 = 0, false) AS rc FROM r),
w AS (SELECT file_hash, CASE WHEN ra THEN a2 ELSE a1 END AS f1, CASE WHEN ra THEN a3 ELSE a2 END AS g1, CASE WHEN ra THEN 2 ELSE 1 END AS fn1, CASE WHEN ra THEN 3 ELSE 2 END AS gn1,
  CASE WHEN rb THEN b2 ELSE b1 END AS f2, CASE WHEN rb THEN NULL ELSE b2 END AS g2, CASE WHEN rb THEN 5 ELSE 4 END AS fn2, 5 AS gn2,
  CASE WHEN rc THEN c2 ELSE c1 END AS f3, CASE WHEN rc THEN NULL ELSE c2 END AS g3, CASE WHEN rc THEN 7 ELSE 6 END AS fn3, 7 AS gn3 FROM q),
u AS (SELECT file_hash, CASE WHEN f1 IN (0, 1) THEN CASE WHEN f2 IN (0, 1) THEN 3 ELSE 2 END ELSE 1 END AS rung, * FROM w),
v AS (SELECT file_hash, rung, CASE rung WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END AS f, CASE rung WHEN 1 THEN g1 WHEN 2 THEN g2 ELSE g3 END AS g,
  CASE rung WHEN 1 THEN fn1 WHEN 2 THEN fn2 ELSE fn3 END AS fn, CASE rung WHEN 1 THEN gn1 WHEN 2 THEN gn2 ELSE gn3 END AS gn FROM u),
x AS (SELECT *, CASE WHEN f IS NULL THEN 'no-reply' WHEN f <= 3 THEN 'call-failed' WHEN f IN (4, 5) THEN 'ok' WHEN g IS NULL THEN 'no-reply'
  WHEN g <= 3 THEN 'call-failed' WHEN g IN (4, 5) THEN 'repaired' ELSE 'schema-invalid' END AS o FROM v)"""


@query(
    "first_valid_attempt",
    f"""WITH {_CALL_SQL} SELECT file_hash, o IN ('ok', 'repaired') AS ok, CASE WHEN o NOT IN ('ok', 'repaired') THEN o END AS reason,
      CASE WHEN o <> 'no-reply' THEN CASE rung WHEN 1 THEN 'json_schema' WHEN 2 THEN 'json_object' ELSE 'plain' END END AS rung,
      CASE WHEN o = 'call-failed' THEN CASE CASE WHEN f <= 3 THEN f ELSE g END WHEN 0 THEN 400 WHEN 1 THEN 422 WHEN 2 THEN 401 END END AS status,
      CASE o WHEN 'ok' THEN '{{"vendor": "v", "total": "' || fn || '"}}' WHEN 'repaired' THEN '{{"vendor": "v", "total": "' || gn || '"}}'
        WHEN 'schema-invalid' THEN '{{}}' WHEN 'call-failed' THEN CASE WHEN f > 3 THEN '{{}}' END END AS reply FROM x""",
)
def first_valid_attempt(t):
    """Rung descent, one repair, one resend without temperature."""
    return parse.extraction_outcome(calls(t)).select("file_hash", "ok", "reason", "rung", "status", "reply")


def _batch(t):
    kind, value = F.col("event_type"), F.col("value")
    failure = (
        F.when((kind == "error") & (value > 150), "rate-limited")
        .when((kind == "signup") & (value > 170), "auth-rejected")
        .when(kind == "click", "schema-invalid")
    )
    return t.events.select(
        F.col("user_id").alias("batch_id"), F.col("event_id").alias("position"), (kind == "view").alias("cached"), failure.alias("failure")
    )


_BATCH_SQL = """b AS (SELECT user_id AS batch_id, event_id AS position, event_type = 'view' AS cached, CASE WHEN event_type = 'error' AND value > 150 THEN 'rate-limited'
  WHEN event_type = 'signup' AND value > 170 THEN 'auth-rejected' WHEN event_type = 'click' THEN 'schema-invalid' END AS failure FROM events),
w AS (SELECT *, first(CASE WHEN failure IN ('rate-limited', 'auth-rejected') AND NOT cached THEN failure END IGNORE NULLS) OVER
  (PARTITION BY batch_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM b),
p AS (SELECT batch_id, position, CASE WHEN cached THEN NULL ELSE coalesce(stop, failure) END AS failure,
  CASE WHEN cached THEN 'cached' WHEN coalesce(stop, failure) IS NULL THEN 'parsed' ELSE 'parse-failed' END AS parse_status FROM w)"""


@query("terminal_cutoff", f"WITH {_BATCH_SQL} SELECT * FROM p")
def terminal_cutoff(t):
    """After a terminal failure later uncached files fail alike."""
    return parse.parse_statuses(_batch(t)).select("batch_id", "position", "failure", "parse_status")


@query(
    "parse_summary",
    f"""WITH {_BATCH_SQL} SELECT batch_id, count(*) AS total, count(*) FILTER (parse_status = 'parsed') AS parsed,
    count(*) FILTER (parse_status = 'parse-failed') AS failed, count(*) FILTER (parse_status = 'cached') AS cached FROM p GROUP BY 1""",
)
def parse_summary(t):
    return parse.parse_summary(parse.parse_statuses(_batch(t)))


@query(
    "failure_codes",
    """SELECT event_id, CASE WHEN event_type = 'error' AND value > 100 THEN 'auth-rejected' WHEN event_type = 'error' AND value > 50 THEN 'rate-limited'
      WHEN event_type IN ('error', 'click') THEN 'call-failed' WHEN event_type = 'view' THEN 'schema-invalid' WHEN event_type = 'signup' THEN 'missing-bytes' ELSE 'unreadable' END AS code,
      event_type = 'error' AND value > 50 AS terminal FROM events""",
)
def failure_codes(t):
    """Status, reason or file error to one failure code."""
    kind, value = F.col("event_type"), F.col("value")
    status = F.when(kind == "error", F.when(value > 200, 401).when(value > 100, 403).when(value > 50, 429).otherwise(500))
    reason = F.when(kind.isin("error", "click"), "call-failed").when(kind == "view", "schema-invalid")
    errno = F.when(kind == "signup", "ENOENT").otherwise("EIO")
    code = parse.failure_code(reason, status, errno)
    return t.events.select("event_id", code.alias("code"), parse.is_terminal(code).alias("terminal"))


# --- values --------------------------------------------------------------------
def printed_money(cents, style):
    whole, fraction = money.whole_part(cents), money.fraction_part(cents)
    comma, dot = money.group_digits(whole, ","), money.group_digits(whole, ".")
    return by_case(
        style,
        F.concat(whole, F.lit("."), fraction),
        F.concat(F.lit("$"), comma, F.lit("."), fraction),
        F.concat(dot, F.lit(","), fraction),
        F.concat(F.lit("USD -"), whole, F.lit("."), fraction),
        F.concat(F.lit("("), comma, F.lit("."), fraction, F.lit(")")),
        F.concat(whole, F.lit("."), fraction, F.lit("-")),
        F.concat(F.lit("$"), comma, F.lit("."), fraction, F.lit(" CR")),
        F.concat(whole, F.lit(","), fraction),
        F.concat(F.lit("  "), comma, F.lit("."), fraction, F.lit(" DR ")),
        F.concat(whole, F.lit("."), fraction, F.lit("9")),
        F.lit("N/A"),
        comma,
    )


@query(
    "money_cents",
    f"""WITH {_CENTS} SELECT o_orderkey, CASE WHEN o_orderkey % 12 IN (3, 4, 5, 6) THEN -cents WHEN o_orderkey % 12 = 10 THEN NULL
      WHEN o_orderkey % 12 = 11 THEN cents // 100 * 100 ELSE cents END AS cents FROM orders_c""",
)
def money_cents(t):
    """Twelve printed styles of the order total back to cents."""
    raw = printed_money(F.col("cents"), F.pmod(F.col("o_orderkey"), F.lit(12)))
    return _cents(t).select("o_orderkey", money.printed_to_cents(raw).alias("cents"))


@query(
    "money_text",
    f"""WITH {_CENTS}, s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -cents WHEN o_orderstatus = 'O' THEN cents % 100 ELSE cents END AS c FROM orders_c),
    p AS (SELECT *, CASE WHEN c < 0 THEN '-' ELSE '' END AS sign, abs(c) // 100 AS w, lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0') AS f FROM s)
    SELECT o_orderkey, sign || w || '.' || f AS input_text, sign || '$' || format('{{:,}}', w) || '.' || f AS display_text, CASE WHEN c >= 0 THEN w || '.' || f END AS decimal_text,
      CASE WHEN c >= 0 THEN c END AS typed_cents FROM p""",
)
def money_text(t):
    """Cents to the three text forms, and what a person typed back to cents."""
    c = F.when(F.col("o_orderstatus") == "F", -F.col("cents")).when(F.col("o_orderstatus") == "O", F.col("cents") % 100).otherwise(F.col("cents"))
    shown = money.cents_to_display(F.col("c"))
    return _cents(t).select("o_orderkey", c.alias("c")).select(
        "o_orderkey",
        money.cents_to_input(F.col("c")).alias("input_text"),
        shown.alias("display_text"),
        money.cents_to_decimal_string(F.col("c")).alias("decimal_text"),
        money.typed_to_cents(F.concat(F.lit(" "), shown)).alias("typed_cents"),
    )


def printed_date(day, style):
    return by_case(
        style,
        F.date_format(day, "yyyy-MM-dd"),
        F.date_format(day, "MM/dd/yyyy"),
        F.date_format(day, "M-d-yy"),
        F.concat(F.date_format(day, "MMMM d"), F.lit("th, "), F.date_format(day, "yyyy")),
        F.concat(F.date_format(day, "d MMM"), F.lit(". "), F.date_format(day, "yyyy")),
        F.concat(F.date_format(day, "yyyy-M-d"), F.lit("T10:00:00Z")),
        F.concat(F.lit("13/45/"), F.date_format(day, "yyyy")),
        F.lit("  "),
        F.date_format(day, "dd.MM.yyyy"),
        F.concat(F.date_format(day, "yyyy"), F.lit("-02-30")),
    )


@query(
    "date_normalise",
    """WITH d AS (SELECT o_orderkey, o_orderkey % 10 AS s, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT o_orderkey, CASE WHEN s IN (6, 7, 9) THEN NULL WHEN s = 8 AND day(d) <= 12 THEN strftime(d, '%Y-%d-%m') ELSE strftime(d, '%Y-%m-%d') END AS iso,
      s IN (6, 9) AS flagged FROM d""",
)
def date_normalise(t):
    """Printed date styles, absent and impossible ones."""
    raw = printed_date(F.col("o_orderdate"), F.pmod(F.col("o_orderkey"), F.lit(10)))
    return t.orders.select(
        "o_orderkey", dates.iso(dates.printed_to_date(raw)).alias("iso"), dates.date_is_flagged(raw).alias("flagged")
    )


# --- validation ----------------------------------------------------------------
def raw_bills(t):
    """Printed bill texts derived from the orders; status and priority decide what goes wrong."""
    key, cents = F.col("o_orderkey"), F.col("cents")
    tax = F.floor(cents * 8 / 100).cast("bigint")
    off = F.pmod(key, F.lit(6))
    priority = F.left("o_orderpriority", F.lit(1))
    shown = lambda c: money.cents_to_display(c)
    return _cents(t).select(
        key.alias("file_hash"),
        "o_orderstatus",
        F.when(priority == "5", F.lit("  ")).otherwise(F.concat(F.lit(" Customer "), F.col("o_custkey").cast("string"))).alias("raw_vendor"),
        F.when(priority == "4", "(N/A).").otherwise(F.concat(F.lit("INV-"), key.cast("string"))).alias("raw_invoice_number"),
        printed_date(F.col("o_orderdate"), F.pmod(key, F.lit(10))).alias("raw_invoice_date"),
        F.when(F.col("o_orderstatus") == "P", "next week").otherwise(F.date_format(F.date_add("o_orderdate", 30), "MM/dd/yyyy")).alias("raw_due_date"),
        shown(cents - tax + off).alias("raw_subtotal"),
        F.when(priority == "3", F.lit(None)).when(priority == "2", "exempt").otherwise(shown(tax)).alias("raw_tax"),
        F.when((priority == "1") & (F.col("o_orderstatus") == "O"), "see attached").otherwise(shown(cents)).alias("raw_total"),
        F.when(priority == "1", "none").otherwise("USD").alias("raw_currency"),
        F.when(priority == "2", "Not Specified").otherwise(F.col("o_orderstatus")).alias("raw_suggested_category"),
    )


_BILL_SQL = f"""{_CENTS}, d AS (SELECT *, CAST(left(o_orderpriority, 1) AS INTEGER) AS p, CAST(o_orderdate AS DATE) AS day, o_orderkey % 10 AS s FROM orders_c),
v AS (SELECT o_orderkey AS file_hash, o_orderstatus, p, s, day, CASE WHEN p = 5 THEN '' ELSE 'Customer ' || o_custkey END AS vendor,
  CASE WHEN p <> 4 THEN 'INV-' || o_orderkey END AS invoice_number,
  CASE WHEN s IN (6, 7, 9) THEN NULL WHEN s = 8 AND day(day) <= 12 THEN strftime(day, '%Y-%d-%m') ELSE strftime(day, '%Y-%m-%d') END AS invoice_date,
  CASE WHEN o_orderstatus <> 'P' THEN strftime(day + 30, '%Y-%m-%d') END AS due_date, cents - (cents * 8) // 100 + o_orderkey % 6 AS subtotal_cents,
  CASE WHEN p NOT IN (2, 3) THEN (cents * 8) // 100 END AS tax_cents, CASE WHEN NOT (p = 1 AND o_orderstatus = 'O') THEN cents END AS total,
  CASE WHEN p <> 1 THEN 'USD' END AS currency, CASE WHEN p <> 2 THEN o_orderstatus END AS suggested_category FROM d),
b AS (SELECT *, coalesce(total, 0) AS total_cents, list_filter([CASE WHEN vendor = '' THEN 'missing:vendor' END, CASE WHEN s IN (6, 9) THEN 'date:invoiceDate' END,
  CASE WHEN o_orderstatus = 'P' THEN 'date:dueDate' END, CASE WHEN p = 2 THEN 'money:taxCents' END, CASE WHEN total IS NULL THEN 'money:totalCents' END,
  CASE WHEN abs(subtotal_cents + tax_cents - total) > 2 THEN 'arithmetic:subtotal+tax!=total' END], lambda x: x IS NOT NULL) AS flag_list FROM v)"""


@query(
    "validate_bill",
    f"""WITH {_BILL_SQL} SELECT file_hash, vendor, invoice_number, invoice_date, due_date, subtotal_cents, tax_cents, total_cents, currency, suggested_category,
      array_to_string(flag_list, '|') AS flags FROM b""",
)
def validate_bill(t):
    """Typed fields and the ordered list of failed checks."""
    return parse.validate_bills(raw_bills(t)).select(
        "file_hash", "vendor", "invoice_number", dates.iso(F.col("invoice_date")).alias("invoice_date"),
        dates.iso(F.col("due_date")).alias("due_date"), "subtotal_cents", "tax_cents", "total_cents", "currency",
        "suggested_category", F.array_join("validation_flags", "|").alias("flags"),
    )


@query(
    "arith_flags",
    f"WITH {_BILL_SQL} SELECT file_hash, CASE WHEN tax_cents IS NOT NULL AND total IS NOT NULL THEN abs(subtotal_cents + tax_cents - total) <= 2 END AS sums_up FROM b",
)
def arith_flags(t):
    """subtotal + tax = total within two cents; null when a part is absent."""
    raw = raw_bills(t)
    cents = {c: money.printed_to_cents(F.col(f"raw_{c}")) for c in ("subtotal", "tax", "total")}
    return raw.select("file_hash", parse.arithmetic_ok(cents["subtotal"], cents["tax"], cents["total"]).alias("sums_up"))


def second_reading(t):
    """The same bills read again: totals of finished orders and some invoice numbers differ."""
    status = F.col("o_orderstatus")
    return parse.validate_bills(
        raw_bills(t)
        .withColumn("raw_total", F.when(status == "F", "$1.00").otherwise(F.col("raw_total")))
        .withColumn("raw_tax", F.when(status == "O", F.lit(None)).otherwise(F.col("raw_tax")))
        .withColumn("raw_invoice_number", F.when(status == "P", F.lower("raw_invoice_number")).otherwise(F.concat("raw_invoice_number", F.lit("x"))))
    )


def agreed_bills(t):
    first = parse.validate_bills(raw_bills(t)).withColumn(
        "route", F.when(F.col("suggested_category").isNull(), "native").otherwise("image-only")
    )
    return confidence.add_agreement(first, second_reading(t))


_AGREE_SQL = """CASE WHEN p = 2 THEN [] ELSE list_filter([CASE WHEN o_orderstatus = 'F' AND total_cents <> 100 THEN 'agreement:totalCents' END,
  CASE WHEN o_orderstatus = 'O' AND tax_cents IS NOT NULL THEN 'agreement:taxCents' END,
  CASE WHEN o_orderstatus <> 'P' THEN 'agreement:invoiceNumber' END], lambda x: x IS NOT NULL) END"""


@query(
    "agreement",
    f"WITH {_BILL_SQL} SELECT file_hash, array_to_string(list_concat(flag_list, {_AGREE_SQL}), '|') AS flags FROM b",
)
def agreement(t):
    """Two readings compared on five fields, image-only documents only."""
    return agreed_bills(t).select("file_hash", F.array_join("validation_flags", "|").alias("flags"))


def bill_texts(t):
    """Source text per order: true vendor, number and date; the total is one cent off on partly shipped orders."""
    cents = F.col("cents") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    text = F.concat(
        F.lit("INVOICE inv-"), F.col("o_orderkey").cast("string"), F.lit("\nCustomer   "), F.col("o_custkey").cast("string"), F.lit("\n\tdated "),
        F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" due "), F.date_format(F.date_add("o_orderdate", 30), "d MMM yyyy"),
        F.lit("\nTotal: "), money.cents_to_display(cents), F.lit("\n"), F.col("o_orderstatus"), F.lit(" USD"),
    )
    return _cents(t).select(F.col("o_orderkey").alias("file_hash"), text.alias("reference_text"))


_LEVELS_SQL = f"""{_BILL_SQL}, f AS (SELECT *, list_concat(flag_list, {_AGREE_SQL}) AS flags FROM b),
l AS (SELECT file_hash, unnest(['vendor', 'invoiceNumber', 'invoiceDate', 'dueDate', 'subtotalCents', 'taxCents', 'totalCents', 'currency', 'suggestedCategory']) AS field,
  unnest([CASE WHEN list_contains(flags, 'missing:vendor') THEN 'flagged' ELSE 'high' END,
    CASE WHEN invoice_number IS NULL THEN CASE WHEN false THEN '' END WHEN list_contains(flags, 'agreement:invoiceNumber') THEN 'low' ELSE 'high' END,
    CASE WHEN list_contains(flags, 'date:invoiceDate') THEN 'flagged' WHEN invoice_date IS NULL THEN NULL WHEN s = 8 AND day(day) <= 12 AND day(day) <> month(day) AND invoice_date <> strftime(day + 30, '%Y-%m-%d') THEN 'low' ELSE 'high' END,
    CASE WHEN list_contains(flags, 'date:dueDate') THEN 'flagged' ELSE 'high' END,
    CASE WHEN list_contains(flags, 'arithmetic:subtotal+tax!=total') THEN 'flagged' ELSE 'low' END,
    CASE WHEN list_contains(flags, 'arithmetic:subtotal+tax!=total') OR p = 2 THEN 'flagged' WHEN tax_cents IS NULL THEN NULL ELSE 'low' END,
    CASE WHEN list_contains(flags, 'arithmetic:subtotal+tax!=total') OR total IS NULL THEN 'flagged' WHEN list_contains(flags, 'agreement:totalCents') THEN 'low'
      WHEN o_orderstatus = 'P' THEN 'low' ELSE 'high' END,
    CASE WHEN currency IS NOT NULL THEN 'high' END, CASE WHEN suggested_category IS NOT NULL THEN 'low' END]) AS level FROM f)"""


def scored(t):
    return confidence.score_bills(agreed_bills(t), bill_texts(t))


@query("confidence_map", f"WITH {_LEVELS_SQL} SELECT file_hash, field, level FROM l WHERE level IS NOT NULL")
def confidence_map(t):
    """Trust level of every field of every bill, one row per field."""
    # the plain explode would push a "not empty" filter below and score every bill twice
    levels = scored(t).select("file_hash", F.explode_outer("field_confidence").alias("field", "level"))
    return levels.filter(F.col("field").isNotNull())


@query(
    "flagged_fields",
    f"""WITH {_LEVELS_SQL}, m AS (SELECT file_hash, field FROM l WHERE level = 'flagged'
      UNION SELECT file_hash, split_part(x, ':', 2) FROM (SELECT file_hash, unnest(flags) AS x FROM f) WHERE x LIKE 'agreement:%')
    SELECT b.file_hash, coalesce(string_agg(field, '|' ORDER BY field), '') AS fields, count(field) > 0 AS flagged FROM b LEFT JOIN m USING (file_hash) GROUP BY 1""",
)
def flagged_fields(t):
    """Fields to mark for review."""
    return scored(t).select(
        "file_hash", F.array_join(confidence.flagged_fields(), "|").alias("fields"), confidence.is_flagged().alias("flagged")
    )


@query(
    "ground_money",
    f"""WITH {_CENTS} SELECT o_orderkey, o_orderstatus <> 'P' AS total_found, false AS digit_found, o_orderstatus = 'F' AS credit_found FROM orders_c""",
)
def ground_money(t):
    """Amounts in text: right, one cent off, and printed as a credit."""
    cents = F.col("cents")
    shown = money.cents_to_display(cents + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0))
    text = collapse(F.concat(F.lit("Order of "), F.date_format("o_orderdate", "MMM d"), F.lit("\nTOTAL  "), shown, F.lit(" and\n"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("("), money.cents_to_display(cents + 5), F.lit(")"))).otherwise(money.cents_to_display(cents + 5))))
    tail = F.right(cents.cast("string"), F.lit(4)).cast("bigint")
    return _cents(t).select(
        "o_orderkey",
        grounding.grounds_money(text, cents).alias("total_found"),
        (grounding.grounds_money(text, tail) & (tail != cents)).alias("digit_found"),
        grounding.grounds_money(text, -(cents + 5)).alias("credit_found"),
    )


@query(
    "ground_date",
    "SELECT o_orderkey, (o_orderkey % 10 <> 5 OR (month(o_orderdate) >= 10 AND day(o_orderdate) >= 10)) AND o_orderkey % 10 NOT IN (6, 7, 9) AND (o_orderkey % 10 <> 8 OR day(o_orderdate) = month(o_orderdate)) AND o_orderkey % 10 NOT IN (2, 3, 4) AS found FROM orders",
)
def ground_date(t):
    """Dates in text in their printed forms; layouts outside the known twelve do not count."""
    text = collapse(F.concat(F.lit("Dated  "), printed_date(F.col("o_orderdate"), F.pmod(F.col("o_orderkey"), F.lit(10))), F.lit(" ok")))
    return t.orders.select("o_orderkey", grounding.grounds_date(text, F.col("o_orderdate").cast("date")).alias("found"))


# --- the parse table -----------------------------------------------------------
def parsed_documents(t):
    """Labelled documents stand for finished parses; poor ones were written under the previous contract."""
    return (
        t.documents.join(t.labels, "doc_id")
        .groupBy(ingest.content_hash(F.col("text")).alias("file_hash"))
        .agg(F.min("doc_id").alias("first_doc"), F.max(F.col("quality") + 1).alias("schema_version"))
    )


_PARSED_SQL = "p AS (SELECT sha256(text) AS file_hash, min(doc_id) AS first_doc, max(quality + 1) AS schema_version FROM documents JOIN labels USING (doc_id) GROUP BY 1)"


@query(
    "cache_split",
    f"WITH {_PARSED_SQL} SELECT doc_id, CASE WHEN schema_version = 2 THEN first_doc END AS answered_by, coalesce(schema_version = 2, false) AS cached FROM documents d LEFT JOIN p ON p.file_hash = sha256(d.text)",
)
def cache_split(t):
    """Documents answered from the table and those to parse."""
    files = t.documents.select("doc_id", ingest.content_hash(F.col("text")).alias("file_hash"))
    answered, todo = cache.split_by_cache(files, parsed_documents(t))
    return answered.select("doc_id", F.col("first_doc").alias("answered_by"), F.lit(True).alias("cached")).unionByName(
        todo.select("doc_id", F.lit(None).cast("bigint").alias("answered_by"), F.lit(False).alias("cached"))
    )


@query(
    "cache_upsert",
    f"""WITH {_PARSED_SQL}, n AS (SELECT sha256(text) AS file_hash, max(doc_id) AS first_doc FROM documents WHERE lang <> 'en' GROUP BY 1)
    SELECT coalesce(n.file_hash, p.file_hash) AS file_hash, coalesce(n.first_doc, p.first_doc) AS first_doc,
      CASE WHEN n.file_hash IS NOT NULL THEN 2 ELSE schema_version END AS schema_version FROM p FULL JOIN n ON p.file_hash = n.file_hash""",
)
def cache_upsert(t):
    """Fresh parses of all documents that are not English replace or extend the table."""
    fresh = (
        t.documents.filter(F.col("lang") != "en")
        .select(ingest.content_hash(F.col("text")).alias("file_hash"), F.col("doc_id").alias("first_doc"))
        .withColumn("schema_version", F.lit(0))
    )
    return cache.store(parsed_documents(t), fresh, newest="first_doc")


@query(
    "url_hosts",
    r"""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || ':8443' AS host_port,
      CAST(NULL AS VARCHAR) AS junk FROM pages""",
)
def url_hosts(t):
    """Host and port of an address, credentials and default port removed."""
    with_port = F.regexp_replace("url", "^([a-z]+)://([^/?#]*)", "$1://me:secret@$2:8443")
    default_port = F.regexp_replace("url", "^[a-z]+://([^/?#]*)", "https://$1:443")
    return t.pages.select(
        "page_id", cache.url_host(default_port).alias("host"), cache.url_host(with_port).alias("host_port"), cache.url_host(F.substring_index("url", ":", -1)).alias("junk")
    )


@query(
    "json_columns",
    """SELECT event_id, event_type = 'error' AS broken, CASE WHEN event_type = 'error' THEN '' ELSE 'high' END AS level,
      CASE WHEN event_type = 'error' THEN '' ELSE 'money:taxCents|' || event_type END AS flags FROM events""",
)
def json_columns(t):
    """Stored JSON columns decoded; unknown levels and items that are not text are dropped."""
    kind = F.col("event_type")
    levels = F.when(kind == "error", F.lit("{oops")).otherwise(F.concat(F.lit('{"vendor": "high", "total": "perhaps", "k": '), "props", F.lit("}")))
    flags = F.when(kind == "error", F.lit("{}")).otherwise(F.concat(F.lit('["money:taxCents", 5, null, "'), kind, F.lit('"]')))
    decoded = cache.decode_confidence(levels)
    return t.events.select(
        "event_id",
        (F.size(decoded) == 0).alias("broken"),
        F.array_join(F.map_values(decoded), "|").alias("level"),
        F.array_join(cache.decode_flags(flags), "|").alias("flags"),
    )
