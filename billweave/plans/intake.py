"""Intake queries. A listing is derived from ``documents``: the language is the folder, the text the bytes."""

import os
import uuid

from pyspark.sql import functions as F

from billweave.functions.dates import iso
from billweave.operators import ingest
from billweave.plans.registry import query
from billweave.session import cut_lineage, shared_folder
from billweave.sources.folder import read_folder


def _style():
    return F.pmod(F.col("doc_id"), F.lit(12))


def by_case(selector, *values):
    """CASE over 0, 1, 2, ..."""
    expression = F
    for i, value in enumerate(values):
        expression = expression.when(selector == i, value)
    return expression


def inventory(t, *more):
    """The listing, with ``more`` columns of its documents."""
    key = F.col("doc_id").cast("string")
    name = by_case(
        _style(),
        F.concat(F.lit("bill-"), key, F.lit(".PDF")),
        F.concat(F.lit("scan-"), key, F.lit(".jpg")),
        F.concat(F.lit("photo-"), key, F.lit(".heic")),
        F.concat(F.lit("notes-"), key, F.lit(".docx")),
        F.concat(F.lit(".hidden-"), key, F.lit(".pdf")),
        F.concat(F.lit("._bill-"), key, F.lit(".pdf")),
        F.concat(F.lit(".bill-"), key, F.lit(".pdf.icloud")),
        F.concat(F.lit("bill-"), key, F.lit(".pdf")),
        F.concat(F.lit(".bill-"), (F.col("doc_id") - 8).cast("string"), F.lit(".PDF.icloud")),
        F.concat(F.lit("x"), key, F.lit(".png")),
        F.lit("Thumbs.db"),
        F.concat(F.lit("receipt-"), key, F.lit(".pdf")),
    )
    return t.documents.select(
        F.col("lang").alias("scan_id"),
        F.col("doc_id").alias("position"),
        name.alias("filename"),
        (F.col("source") != "src3").alias("is_file"),
        (F.col("source") == "src5").alias("is_symlink"),
        F.col("n_chars").alias("size_bytes"),
        F.when(_style() == 7, 0).otherwise(8).cast("bigint").alias("blocks"),
        F.when(_style() == 11, 0x1020).otherwise(0x20).cast("bigint").alias("attributes"),
        F.when(F.col("lang") == "en", "darwin").otherwise("win32").alias("platform"),
        (_style() != 9).alias("settled"),
        ingest.content_hash(F.col("text")).alias("hash"),
        *more,
    )


def ledger(t):
    """Documents a reviewer marked as poor stand for the ones already posted."""
    return (
        t.documents.join(t.labels.filter(F.col("quality") == 0), "doc_id")
        .groupBy(ingest.content_hash(F.col("text")).alias("hash"))
        .agg(F.min(F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int"))).alias("posted_at"))
    )


INVENTORY_SQL = """inventory AS (
  SELECT lang AS scan_id, doc_id AS position,
    CASE doc_id % 12
      WHEN 0 THEN 'bill-' || doc_id || '.PDF' WHEN 1 THEN 'scan-' || doc_id || '.jpg'
      WHEN 2 THEN 'photo-' || doc_id || '.heic' WHEN 3 THEN 'notes-' || doc_id || '.docx'
      WHEN 4 THEN '.hidden-' || doc_id || '.pdf' WHEN 5 THEN '._bill-' || doc_id || '.pdf'
      WHEN 6 THEN '.bill-' || doc_id || '.pdf.icloud' WHEN 7 THEN 'bill-' || doc_id || '.pdf'
      WHEN 8 THEN '.bill-' || (doc_id - 8) || '.PDF.icloud' WHEN 9 THEN 'x' || doc_id || '.png'
      WHEN 10 THEN 'Thumbs.db' ELSE 'receipt-' || doc_id || '.pdf' END AS filename,
    source <> 'src3' AS is_file, source = 'src5' AS is_symlink, n_chars AS size_bytes,
    CASE WHEN doc_id % 12 = 7 THEN 0 ELSE 8 END AS blocks,
    CASE WHEN doc_id % 12 = 11 THEN 4128 ELSE 32 END AS attributes,
    CASE WHEN lang = 'en' THEN 'darwin' ELSE 'win32' END AS platform,
    doc_id % 12 <> 9 AS settled, sha256(text) AS hash
  FROM documents),
ledger AS (
  SELECT sha256(d.text) AS hash, strftime(min(DATE '2024-01-01' + CAST(d.doc_id AS INTEGER)), '%Y-%m-%d') AS posted_at
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0 GROUP BY 1),
targets AS (
  SELECT *, CASE WHEN starts_with(filename, '.') AND ends_with(lower(filename), '.icloud')
    THEN substr(filename, 2, length(filename) - 8) END AS target FROM inventory WHERE is_file AND NOT is_symlink),
classified AS (
  SELECT scan_id, position, target AS filename, 'not-ready-skipped' AS status, NULL AS hash FROM targets t
  WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM inventory i WHERE i.scan_id = t.scan_id AND i.filename = t.target)
  UNION ALL
  SELECT scan_id, position, filename, status, CASE WHEN status = 'loaded' THEN hash END FROM (
    SELECT *, CASE
      WHEN NOT regexp_matches(lower(filename), '\\.(pdf|jpg|jpeg|png|heic|heif)$') THEN 'unsupported-skipped'
      WHEN platform = 'darwin' AND ((size_bytes > 0 AND blocks = 0) OR EXISTS (
        SELECT 1 FROM inventory i WHERE i.scan_id = t.scan_id AND i.filename = '.' || t.filename || '.icloud')) THEN 'not-ready-skipped'
      WHEN platform = 'win32' AND (attributes & 4460544) <> 0 THEN 'not-ready-skipped'
      WHEN NOT settled THEN 'not-ready-skipped' ELSE 'loaded' END AS status
    FROM targets t WHERE target IS NULL AND NOT starts_with(filename, '.') AND lower(filename) <> 'thumbs.db')),
marked AS (
  SELECT *, CASE WHEN status = 'loaded' AND row_number() OVER (PARTITION BY scan_id, status, hash ORDER BY position) > 1
    THEN 'duplicate-in-batch' ELSE status END AS batch_status FROM classified),
scanned AS (
  SELECT m.scan_id, m.position, m.filename, m.hash,
    CASE WHEN m.hash IS NOT NULL AND l.hash IS NOT NULL THEN 'duplicate-excluded' ELSE batch_status END AS status, l.posted_at
  FROM marked m LEFT JOIN ledger l ON m.hash = l.hash)"""


@query("scan_classify", f"WITH {INVENTORY_SQL} SELECT scan_id, position, filename, status, hash FROM classified")
def scan_classify(t):
    """Listing, junk, type and readiness rules per file."""
    return ingest.classify(inventory(t)).select("scan_id", "position", "filename", "status", "hash")


@query(
    "dup_in_batch",
    f"WITH {INVENTORY_SQL} SELECT scan_id, position, filename, hash, batch_status AS status FROM marked",
)
def dup_in_batch(t):
    """First listed copy stays loaded, later copies are duplicates."""
    return ingest.mark_duplicates(ingest.classify(inventory(t))).select("scan_id", "position", "filename", "hash", "status")


@query("ledger_exclude", f"WITH {INVENTORY_SQL} SELECT scan_id, position, filename, hash, status, posted_at FROM scanned")
def ledger_exclude(t):
    """Full scan: posted documents are excluded in every copy."""
    return ingest.scan(inventory(t), ledger(t)).select(
        "scan_id", "position", "filename", "hash", "status", iso(F.col("posted_at")).alias("posted_at")
    )


@query(
    "scan_summary",
    f"""WITH {INVENTORY_SQL} SELECT scan_id, count(*) AS total, count(*) FILTER (status = 'loaded') AS loaded,
    count(*) FILTER (status LIKE 'duplicate%') AS duplicates, count(*) FILTER (status = 'not-ready-skipped') AS not_ready,
    count(*) FILTER (status = 'unsupported-skipped') AS unsupported FROM scanned GROUP BY scan_id""",
)
def scan_summary(t):
    return ingest.scan_summary(ingest.scan(inventory(t), ledger(t)))


@query(
    "sentinel_anti",
    f"WITH {INVENTORY_SQL} SELECT scan_id, target FROM targets t WHERE target IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM inventory i WHERE i.scan_id = t.scan_id AND i.filename = t.target)",
)
def sentinel_anti(t):
    """Placeholders whose real file is not listed."""
    return ingest.listed_files(inventory(t)).filter("placeholder").select("scan_id", F.col("filename").alias("target"))


@query(
    "reviewable_files",
    f"""WITH {INVENTORY_SQL} SELECT scan_id, position, filename, status FROM scanned s WHERE status = 'loaded' OR (status = 'duplicate-excluded'
    AND EXISTS (SELECT 1 FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND sha256(d.text) = s.hash))""",
)
def reviewable_files(t):
    """Loaded files and the excluded ones that were put back."""
    scanned = ingest.scan(inventory(t), ledger(t))
    again = t.documents.join(t.labels.filter(F.col("toxic") == 1), "doc_id").select(
        ingest.content_hash(F.col("text")).alias("hash")
    )
    keys = scanned.select("filename", "hash").join(again, "hash", "left_semi")
    return ingest.reviewable(scanned, keys).select("scan_id", "position", "filename", "status")


@query(
    "file_labels",
    f"""WITH {INVENTORY_SQL} SELECT s.scan_id, s.position, CASE
      WHEN status = 'duplicate-excluded' THEN 'Already entered on ' || posted_at
      WHEN status = 'duplicate-in-batch' THEN 'Duplicate in this scan'
      WHEN status = 'not-ready-skipped' THEN 'Not downloaded yet, re-scan shortly'
      WHEN status = 'unsupported-skipped' THEN 'Unsupported'
      WHEN source IN ('src1', 'src2') THEN 'Could not read' WHEN n_chars > 4000 THEN 'Needs review'
      WHEN source = 'src4' THEN 'Already read' WHEN source < 'src2' THEN 'Ready to review' ELSE 'Loaded' END AS label
    FROM scanned s JOIN documents d ON s.position = d.doc_id""",
)
def file_labels(t):
    """The one label a file shows."""
    docs = t.documents.select(F.col("doc_id").alias("position"), "source", "n_chars")
    scanned = ingest.scan(inventory(t), ledger(t)).join(docs, "position")
    source = F.col("source")
    parse = (
        F.when(source.isin("src1", "src2"), "parse-failed").when(source == "src4", "cached").when(source < "src2", "parsed")
    )
    label = ingest.status_label(F.col("status"), F.col("posted_at"), parse, F.col("n_chars") > 4000)
    return scanned.select("scan_id", "position", label.alias("label"))


@query(
    "stale_bytes",
    """SELECT doc_id AS position, sha256(text) AS hash, lang = 'fr' AS stale FROM documents""",
)
def stale_bytes(t):
    """Hash at scan time against the bytes read now; French documents were changed in between."""
    files = t.documents.select(
        F.col("lang").alias("scan_id"), F.col("doc_id").cast("string").alias("filename"), F.col("doc_id").alias("position"),
        ingest.content_hash(F.col("text")).alias("hash"),
    )
    now = t.documents.select(
        F.col("lang").alias("scan_id"),
        F.col("doc_id").cast("string").alias("filename"),
        F.when(F.col("lang") == "fr", F.concat(F.col("text"), F.lit("."))).otherwise(F.col("text")).alias("content"),
    )
    return ingest.stale_files(files, now).select("position", "hash", "stale")


@query(
    "unsafe_paths",
    r"""SELECT page_id, url, regexp_matches(url, '[/\\]') OR regexp_matches(url, '^[A-Za-z]:') OR url IN ('', '.', '..') AS unsafe_url,
    regexp_matches(regexp_extract(url, '[^/]*$'), '^[A-Za-z]:') OR regexp_extract(url, '[^/]*$') IN ('', '.', '..') AS unsafe_name FROM pages""",
)
def unsafe_paths(t):
    """Names that are not plain file names."""
    return t.pages.select(
        "page_id",
        "url",
        ingest.is_unsafe_path(F.col("url")).alias("unsafe_url"),
        ingest.is_unsafe_path(F.regexp_extract("url", r"[^/]*\z", 0)).alias("unsafe_name"),
    )


@query(
    "settle_check",
    """WITH s AS (SELECT user_id AS path, length(event_type) AS size, CAST(floor(value / 40) AS BIGINT) AS mtime,
      row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n,
      lag(length(event_type)) OVER (PARTITION BY user_id ORDER BY ts) AS size0,
      lag(CAST(floor(value / 40) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) AS mtime0 FROM events)
    SELECT path, bool_or(coalesce(size = size0 AND mtime = mtime0, false)) AS settled FROM s WHERE n <= 7 GROUP BY path""",
)
def settle_check(t):
    """Two equal samples in a row within the first seven."""
    samples = t.events.select(
        F.col("user_id").alias("path"),
        F.length("event_type").alias("size"),
        F.floor(F.col("value") / 40).alias("mtime"),
        F.col("ts").alias("sample_ts"),
    )
    return ingest.settled_files(samples)


_TITLE = r"<title>([^<]*)</title>"
_WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@query(
    "sanitize_names",
    rf"""WITH raw AS (SELECT page_id, url || chr(9) || ' ' || regexp_extract(html, '{_TITLE}', 1) || chr(10) || '..pdf ' AS raw FROM pages),
    a AS (SELECT page_id, regexp_replace(raw, '(?s)^.*[\\/]', '') AS n FROM raw),
    b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(n, '[\t\n\r\x0b\f]', ' ', 'g'), '[<>:"|?*\x00-\x1f\x7f]', '', 'g'), '{_WS}+', ' ', 'g') AS n FROM a),
    c AS (SELECT page_id, regexp_replace(regexp_replace(trim(n), '[. ]+$', ''), '^[._]+', '') AS n FROM b),
    d AS (SELECT page_id, n, CASE WHEN regexp_matches(n, '(?s)^.+\.[^.]*$') THEN regexp_extract(n, '(?s)(\.[^.]*)$', 1) ELSE '' END AS e FROM c)
    SELECT page_id, CASE WHEN n = '' THEN 'upload' WHEN length(n) > 180 THEN
      left(left(n, length(n) - length(e)), greatest(1, 180 - length(e))) || e ELSE n END AS saved_name FROM d""",
)
def sanitize_names(t):
    """Untrusted names made of address, page title and odd endings."""
    raw = F.concat(
        F.col("url"), F.lit("\t "), F.regexp_extract("html", _TITLE, 1), F.lit("\n..pdf ")
    )
    return t.pages.select("page_id", ingest.sanitize_filename(raw).alias("saved_name"))


@query(
    "collision_names",
    """WITH arrivals AS (SELECT p_brand AS folder, p_partkey AS arrival, p_name || '.pdf' AS desired, p_name AS base FROM part),
    existing AS (SELECT DISTINCT p_brand AS folder, CASE WHEN p_size > 45 THEN p_name || ' (' || (p_size - 43) || ').pdf' ELSE p_name || '.pdf' END AS filename
      FROM part WHERE p_size > 45 OR p_size < 3),
    wanted AS (SELECT DISTINCT folder, desired, base FROM arrivals),
    numbers AS (SELECT folder, desired, n, row_number() OVER (PARTITION BY folder, desired ORDER BY n) AS k
      FROM wanted w, range(1, 1000) r(n) WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.folder = w.folder
        AND e.filename = CASE WHEN n = 1 THEN w.desired ELSE w.base || ' (' || n || ').pdf' END)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY folder, desired ORDER BY arrival) AS k FROM arrivals)
    SELECT r.folder, r.arrival, CASE WHEN n = 1 THEN r.desired WHEN n IS NULL THEN base || ' (' || r.arrival || ').pdf' ELSE base || ' (' || n || ').pdf' END AS saved_name
    FROM ranked r LEFT JOIN numbers m ON r.folder = m.folder AND r.desired = m.desired AND r.k = m.k""",
)
def collision_names(t):
    """k-th arrival of a name takes the k-th free number."""
    arrivals = t.part.select(
        F.col("p_brand").alias("folder"),
        F.col("p_partkey").alias("arrival"),
        F.concat("p_name", F.lit(".pdf")).alias("desired"),
        F.col("p_partkey").alias("arrived_ms"),
    )
    existing = (
        t.part.filter((F.col("p_size") > 45) | (F.col("p_size") < 3))
        .select(
            F.col("p_brand").alias("folder"),
            F.when(F.col("p_size") > 45, F.concat("p_name", F.lit(" ("), (F.col("p_size") - 43).cast("string"), F.lit(").pdf")))
            .otherwise(F.concat("p_name", F.lit(".pdf")))
            .alias("filename"),
        )
        .distinct()
    )
    return ingest.collision_names(arrivals, existing).select("folder", "arrival", "saved_name")


def _chained_names(t):
    """Arrivals whose names are numbered forms of each other, up to two counters deep."""
    size = F.pmod("p_size", F.lit(4))
    counters = by_case(size, F.lit(""), F.lit(" (2)"), F.lit(" (3)"), F.lit(" (2) (2)"))
    return t.part.select(
        F.col("p_type").alias("folder"),
        F.col("p_partkey").alias("arrival"),
        F.concat(F.substring_index("p_name", " ", 1), counters, F.lit(".pdf")).alias("desired"),
        F.col("p_partkey").alias("arrived_ms"),
    )


@query(
    "collision_chains",
    """WITH RECURSIVE a AS (SELECT p_type AS folder, p_partkey AS arrival, split_part(p_name, ' ', 1) || [' ', ' (2)', ' (3)', ' (2) (2)'][p_size % 4 + 1] AS base FROM part),
    b AS (SELECT folder, arrival, trim(base) AS base, split_part(base, ' ', 1) AS root, row_number() OVER (PARTITION BY folder, split_part(base, ' ', 1) ORDER BY arrival) AS i FROM a),
    w(folder, root, i, arrival, saved, taken) AS (
      SELECT DISTINCT folder, root, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, []::VARCHAR[] FROM b
      UNION ALL SELECT folder, root, i, arrival, name, taken || [name] FROM (
        SELECT b.folder, b.root, b.i, b.arrival, w.taken, list_filter([base] || list_transform(range(2, 1000), lambda n: base || ' (' || n || ')'), lambda x: NOT list_contains(w.taken, x))[1] AS name
        FROM w JOIN b ON b.folder = w.folder AND b.root = w.root AND b.i = w.i + 1))
    SELECT folder, arrival, coalesce(saved, base || ' (' || arrival || ')') || '.pdf' AS saved_name FROM w JOIN b USING (folder, root, arrival)""",
)
def collision_chains(t):
    """Names that arrive in plain and in numbered forms take what is free when they come."""
    none = t.part.limit(0).select(F.col("p_type").alias("folder"), F.col("p_name").alias("filename"))
    return ingest.collision_names(_chained_names(t), none).select("folder", "arrival", "saved_name")


@query(
    "intake_filter",
    """WITH u AS (SELECT l_orderkey AS request_id, l_linenumber AS line, l_partkey, l_suppkey,
      CASE WHEN l_returnflag = 'R' THEN 'IMAGE/JPEG; q=1' WHEN l_returnflag = 'A' THEN 'application/pdf' ELSE 'image/gif' END AS mime,
      CASE WHEN l_linestatus = 'O' THEN 'photo.jpg' ELSE 'letter.docx' END AS name, CAST(l_extendedprice * 270 AS BIGINT) AS size FROM lineitem),
    k AS (SELECT *, name = 'photo.jpg' AND mime <> 'image/gif' AS ok FROM u),
    q AS (SELECT request_id, coalesce(max(size) FILTER (ok), 0) AS largest, count(*) AS files FROM k GROUP BY 1)
    SELECT request_id, line, l_partkey, l_suppkey, CASE WHEN files > 20 THEN 'request-too-many-files' WHEN largest > 26214400 THEN 'request-file-too-large'
      WHEN NOT ok THEN 'file-type' END AS reject_reason FROM k JOIN q USING (request_id)""",
)
def intake_filter(t):
    """Type rules per file, size and count rules per request."""
    flag = F.col("l_returnflag")
    uploads = t.lineitem.select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_linenumber").alias("line"),
        "l_partkey",
        "l_suppkey",
        F.when(flag == "R", "IMAGE/JPEG; q=1").when(flag == "A", "application/pdf").otherwise("image/gif").alias("mime_type"),
        F.when(F.col("l_linestatus") == "O", "photo.jpg").otherwise("letter.docx").alias("filename"),
        F.round(F.col("l_extendedprice") * 270).cast("bigint").alias("size_bytes"),
    )
    return ingest.intake(uploads).select("request_id", "line", "l_partkey", "l_suppkey", "reject_reason")


# --- a real folder -------------------------------------------------------------
def _put(batches, root):
    """Write one file, folder or link a row; a name that stands already is left, so a repeated task changes nothing."""
    for rows in batches:
        for scan, name, is_file, is_link, text in zip(*(rows[c] for c in ("scan_id", "filename", "is_file", "is_symlink", "text"))):
            folder = os.path.join(root, scan)
            os.makedirs(folder, exist_ok=True)
            target = os.path.join(folder, name)
            if not is_file:
                os.makedirs(target, exist_ok=True)
            elif is_link:
                if not os.path.lexists(target):
                    os.symlink("nowhere", target)
            else:
                part = os.path.join(root, f"{os.getpid()}-{uuid.uuid4().hex}")  # outside every listing until it is whole
                with open(part, "w", encoding="utf-8", newline="") as file:
                    file.write(text or "")
                os.replace(part, target)
        yield rows[["filename"]].iloc[:0]


def written_folder(t) -> str:
    """The documents' listing as real folders below the shared one, a folder a language."""
    root = f"{shared_folder(t.spark)}/{uuid.uuid4().hex}".removeprefix("file://").removeprefix("file:")
    put = inventory(t, "text").filter(F.col("filename") != "Thumbs.db").select(
        F.coalesce("scan_id", F.lit("none")).alias("scan_id"), "filename", F.coalesce("is_file", F.lit(True)).alias("is_file"),
        F.coalesce("is_symlink", F.lit(False)).alias("is_symlink"), "text",
    )
    os.makedirs(root)
    put.mapInPandas(lambda batches: _put(batches, root), "filename string").count()
    return root


@query(
    "scan_folder",
    r"""WITH f AS (SELECT coalesce(lang, 'none') AS scan_id, CASE doc_id % 12 WHEN 0 THEN 'bill-' || doc_id || '.PDF' WHEN 1 THEN 'scan-' || doc_id || '.jpg' WHEN 2 THEN 'photo-' || doc_id || '.heic'
      WHEN 3 THEN 'notes-' || doc_id || '.docx' WHEN 6 THEN '.bill-' || doc_id || '.pdf.icloud' WHEN 7 THEN 'bill-' || doc_id || '.pdf' WHEN 8 THEN '.bill-' || (doc_id - 8) || '.PDF.icloud'
      WHEN 9 THEN 'x' || doc_id || '.png' WHEN 11 THEN 'receipt-' || doc_id || '.pdf' END AS entry, coalesce(source, '') NOT IN ('src3', 'src5') AS plain, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 12 NOT IN (4, 5, 10)),
    l AS (SELECT *, starts_with(entry, '.') AS stub, CASE WHEN starts_with(entry, '.') THEN substr(entry, 2, length(entry) - 8) ELSE entry END AS filename FROM f),
    s AS (SELECT scan_id, filename, CASE WHEN stub THEN 'not-ready-skipped' WHEN ends_with(filename, '.docx') THEN 'unsupported-skipped' ELSE 'loaded' END AS status, h FROM l
      WHERE plain AND NOT (stub AND EXISTS (SELECT 1 FROM f o WHERE o.scan_id = l.scan_id AND o.entry = l.filename))),
    n AS (SELECT *, row_number() OVER (PARTITION BY scan_id, status, h ORDER BY filename) AS copy FROM s),
    ledger AS (SELECT sha256(d.text) AS lh, strftime(min(DATE '2024-01-01' + CAST(d.doc_id AS INTEGER)), '%Y-%m-%d') AS posted_at FROM documents d JOIN labels g ON d.doc_id = g.doc_id WHERE g.quality = 0 GROUP BY 1)
    SELECT scan_id, filename, CASE WHEN status <> 'loaded' THEN status WHEN lh IS NOT NULL THEN 'duplicate-excluded' WHEN copy > 1 THEN 'duplicate-in-batch' ELSE 'loaded' END AS status,
      CASE WHEN status = 'loaded' THEN h END AS hash, CASE WHEN status = 'loaded' THEN posted_at END AS posted_at FROM n LEFT JOIN ledger ON lh = h""",
)
def scan_folder(t):
    """Full scan of real folders with dotfiles, placeholders, links and subfolders in them."""
    listed = read_folder(t.spark, written_folder(t), subfolders=True, platform="linux")
    scanned = ingest.scan(cut_lineage(listed), ledger(t))
    return scanned.select("scan_id", "filename", "status", "hash", iso(F.col("posted_at")).alias("posted_at"))
