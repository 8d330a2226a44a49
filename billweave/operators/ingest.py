"""Intake of document files: listing rules, readiness, content hash, duplicates."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from billweave import fixed
from billweave.functions.text import SPACE, trim_all
from billweave.operators.joins import left_join_sparse

LOADED = "loaded"
DUPLICATE_IN_BATCH = "duplicate-in-batch"
DUPLICATE_EXCLUDED = "duplicate-excluded"
NOT_READY = "not-ready-skipped"
UNSUPPORTED = "unsupported-skipped"


# --- rules on one name ---------------------------------------------------------
def is_junk(name: Column) -> Column:
    lower = F.lower(name)
    hidden = F.startswith(name, F.lit(".")) & ~F.endswith(lower, F.lit(fixed.PLACEHOLDER_SUFFIX))
    return lower.isin(*fixed.JUNK_NAMES) | F.startswith(name, F.lit("._")) | hidden


def is_supported(name: Column) -> Column:
    extension = F.lower(F.regexp_extract(name, r"(?s)(\.[^.]*)\z", 1))
    return extension.isin(*fixed.SUPPORTED_EXTENSIONS)


def placeholder_target(name: Column) -> Column:
    """The file a cloud placeholder ``.<name>.icloud`` stands for, else null."""
    sentinel = F.startswith(name, F.lit(".")) & F.endswith(F.lower(name), F.lit(fixed.PLACEHOLDER_SUFFIX))
    length = F.greatest(F.length(name) - len(fixed.PLACEHOLDER_SUFFIX) - 1, F.lit(0))
    return F.when(sentinel, F.substring(name, F.lit(2), length))


def is_unsafe_path(name: Column) -> Column:
    """Names that are not a plain file name."""
    return F.coalesce(
        name.isin("", ".", "..") | F.rlike(name, F.lit(r"[/\\\x00]")) | F.rlike(name, F.lit(r"^[A-Za-z]:")), F.lit(True)
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def sanitize_filename(raw: Column) -> Column:
    """One safe path segment; the extension survives the length cap."""
    name = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?s)^.*[\\/]", "")
    name = F.regexp_replace(F.translate(name, "\t\n\r\x0b\f", "     "), r'[<>:"|?*\x00-\x1f\x7f]', "")
    name = F.regexp_replace(name, rf"{SPACE}+", " ")
    name = F.regexp_replace(name, r"^ | \z", "")
    name = F.regexp_replace(F.regexp_replace(name, r"[. ]+\z", ""), r"^[._]+", "")
    extension = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)\z", 1)
    room = F.greatest(F.lit(1), fixed.FILENAME_MAX_LENGTH - F.length(extension))
    stem_length = F.least(room, F.length(name) - F.length(extension))
    capped = F.concat(F.left(name, stem_length), extension)
    return (
        F.when(name == "", fixed.FILENAME_FALLBACK)
        .when(F.length(name) > fixed.FILENAME_MAX_LENGTH, capped)
        .otherwise(name)
    )


# --- readiness -----------------------------------------------------------------
def settled_files(samples: DataFrame) -> DataFrame:
    """(path, size, mtime, sample_ts) -> (path, settled).

    Settled when two samples in a row agree within the first sample and six
    repeats. Only the first seven samples of a path count, so that many reach
    its task at most: Spark cuts each map task to seven before the shuffle.
    """
    by_time = Window.partitionBy("path").orderBy("sample_ts")
    head = samples.withColumn("_n", F.row_number().over(by_time)).filter(
        F.col("_n") <= fixed.SETTLE_MAX_RESAMPLES + 1
    )
    same = (F.lag("size").over(by_time) == F.col("size")) & (F.lag("mtime").over(by_time) == F.col("mtime"))
    return (
        head.withColumn("_same", F.coalesce(same, F.lit(False))).groupBy("path").agg(F.bool_or("_same").alias("settled"))
    )


def _stub_facts(inventory: DataFrame) -> DataFrame:
    """(scan_id, _real, lone, has_stub) for every name a placeholder refers to: few rows, names only."""
    name = F.col("filename")
    target = placeholder_target(name)
    exact = F.endswith(name, F.lit(fixed.PLACEHOLDER_SUFFIX))
    return (
        inventory.select(
            "scan_id", F.coalesce(target, name).alias("_real"), target.isNotNull().alias("_stub"), exact.alias("_exact")
        )
        .groupBy("scan_id", "_real")
        .agg(
            F.bool_or("_stub").alias("_any"),
            F.bool_and("_stub").alias("lone"),
            F.bool_or(F.col("_stub") & F.col("_exact")).alias("has_stub"),
        )
        .filter("_any")
        .drop("_any")
    )


def listed_files(inventory: DataFrame) -> DataFrame:
    """Regular files of a listing, junk dropped, lone placeholders renamed to their target.

    A placeholder next to its real file is dropped. Adds placeholder and has_stub.
    """
    target = placeholder_target(F.col("filename"))
    files = (
        inventory.filter(F.col("is_file") & ~F.col("is_symlink"))
        .withColumn("placeholder", target.isNotNull())
        .filter(F.col("placeholder") | ~is_junk(F.col("filename")))
        .withColumn("_real", F.coalesce(target, F.col("filename")))
    )
    joined = files.join(_stub_facts(inventory), ["scan_id", "_real"], "left")
    return (
        joined.filter(~F.col("placeholder") | F.col("lone"))
        .withColumn("filename", F.col("_real"))
        .withColumn("has_stub", F.coalesce("has_stub", F.lit(False)))
        .select(*inventory.columns, "placeholder", "has_stub")
    )


def is_not_materialized(has_stub: Column) -> Column:
    """Bytes not on disk; missing metadata counts as present."""
    mac = (F.col("platform") == "darwin") & (((F.col("size_bytes") > 0) & (F.col("blocks") == 0)) | has_stub)
    windows = (F.col("platform") == "win32") & (F.col("attributes").bitwiseAND(fixed.OFFLINE_ATTRIBUTE_MASK) != 0)
    return F.coalesce(mac, F.lit(False)) | F.coalesce(windows, F.lit(False))


def classify(inventory: DataFrame) -> DataFrame:
    """Status of every listed file before duplicates are looked at.

    Needs ``settled`` and ``hash`` (null when the bytes could not be read). One
    listing of one folder is (scan_id, position, filename, ...).
    """
    files = listed_files(inventory)
    absent = is_not_materialized(F.col("has_stub"))
    status = (
        F.when(F.col("placeholder"), NOT_READY)
        .when(~is_supported(F.col("filename")), UNSUPPORTED)
        .when(absent | ~F.coalesce(F.col("settled"), F.lit(False)) | F.col("hash").isNull(), NOT_READY)
        .otherwise(LOADED)
    )
    return files.withColumn("status", status).withColumn(
        "hash", F.when(F.col("status") == LOADED, F.col("hash"))
    ).drop("has_stub", "placeholder")


# --- duplicates ----------------------------------------------------------------
def mark_duplicates(files: DataFrame) -> DataFrame:
    """The first listed copy of a hash stays loaded, later copies become duplicates.

    First positions come from a map-side combined minimum, and only hashes with
    more than one copy are joined back.
    """
    first = (
        files.filter(F.col("status") == LOADED)
        .groupBy("scan_id", "hash")
        .agg(F.min("position").alias("_first"), F.count("*").alias("_copies"))
        .filter(F.col("_copies") > 1)
        .drop("_copies")
    )
    later = (F.col("status") == LOADED) & (F.col("position") > F.col("_first"))
    marked = left_join_sparse(files, first, "hash", ["scan_id"])
    return marked.withColumn("status", F.when(later, DUPLICATE_IN_BATCH).otherwise(F.col("status"))).select(*files.columns)


def exclude_posted(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every copy of an already posted document is excluded and carries the posting time."""
    joined = left_join_sparse(files, ledger.select("hash", "posted_at"), "hash")
    return joined.withColumn(
        "status", F.when(F.col("posted_at").isNotNull(), DUPLICATE_EXCLUDED).otherwise(F.col("status"))
    ).select(*files.columns, "posted_at")


def scan(inventory: DataFrame, ledger: DataFrame) -> DataFrame:
    """Listing -> one row per surfaced file with its final status."""
    return exclude_posted(mark_duplicates(classify(inventory)), ledger)


def scan_summary(scanned: DataFrame) -> DataFrame:
    status = F.col("status")
    return scanned.groupBy("scan_id").agg(
        F.count("*").alias("total"),
        F.count_if(status == LOADED).alias("loaded"),
        F.count_if(status.isin(DUPLICATE_EXCLUDED, DUPLICATE_IN_BATCH)).alias("duplicates"),
        F.count_if(status == NOT_READY).alias("not_ready"),
        F.count_if(status == UNSUPPORTED).alias("unsupported"),
    )


def stale_files(inventory: DataFrame, contents: DataFrame) -> DataFrame:
    """Files whose bytes no longer have the hash recorded at scan time (or are gone)."""
    now = contents.select("scan_id", "filename", content_hash(F.col("content")).alias("_now"))
    return (
        inventory.filter(F.col("hash").isNotNull())
        .join(now, ["scan_id", "filename"], "left")
        .withColumn("stale", ~F.coalesce(F.col("hash") == F.col("_now"), F.lit(False)))
        .drop("_now")
    )


def reviewable(scanned: DataFrame, included_again: DataFrame) -> DataFrame:
    """Loaded files, plus excluded duplicates a person put back by (filename, hash)."""
    loaded = scanned.filter(F.col("status") == LOADED)
    back = scanned.filter(F.col("status") == DUPLICATE_EXCLUDED).join(
        included_again.select("filename", "hash"), ["filename", "hash"], "left_semi"
    )
    return loaded.unionByName(back.select(*scanned.columns))


def status_label(status: Column, posted_at: Column, parse_status: Column, flagged: Column) -> Column:
    """The one label a file shows, first match wins."""
    posted_day = F.date_format(posted_at, "yyyy-MM-dd")
    return (
        F.when((status == DUPLICATE_EXCLUDED) & posted_at.isNotNull(), F.concat(F.lit(fixed.FILE_POSTED_ON), posted_day))
        .when(status == DUPLICATE_EXCLUDED, fixed.FILE_POSTED)
        .when(status == DUPLICATE_IN_BATCH, fixed.FILE_DUPLICATE)
        .when(status == NOT_READY, fixed.FILE_NOT_READY)
        .when(status == UNSUPPORTED, fixed.FILE_UNSUPPORTED)
        .when(parse_status == "parse-failed", fixed.FILE_PARSE_FAILED)
        .when(F.coalesce(flagged, F.lit(False)), fixed.FILE_FLAGGED)
        .when(parse_status == "cached", fixed.FILE_CACHED)
        .when(parse_status == "parsed", fixed.FILE_PARSED)
        .otherwise(fixed.FILE_LOADED)
    )


# --- uploads -------------------------------------------------------------------
def intake(uploads: DataFrame) -> DataFrame:
    """Accept or reject uploaded files; an oversized file or too many files fail the whole request.

    Needs request_id, filename, mime_type, size_bytes. Files of a wrong type are
    skipped before the limits count, so they never fail a request by size.
    """
    mime = trim_all(F.lower(F.element_at(F.split(F.coalesce(F.col("mime_type"), F.lit("")), ";"), 1)))
    named = uploads.withColumn("saved_name", sanitize_filename(F.col("filename")))
    typed = named.withColumn("_ok", is_supported(F.col("saved_name")) & mime.isin(*fixed.INTAKE_MIME_TYPES))
    limits = typed.groupBy("request_id").agg(
        F.coalesce(F.max(F.when(F.col("_ok"), F.col("size_bytes"))), F.lit(0)).alias("_largest"),
        F.count("*").alias("_files"),
    )
    outcome = (
        F.when(F.col("_files") > fixed.INTAKE_MAX_FILES, "request-too-many-files")
        .when(F.col("_largest") > fixed.INTAKE_MAX_FILE_BYTES, "request-file-too-large")
        .when(~F.col("_ok"), "file-type")
    )
    return (
        typed.join(limits, "request_id")
        .withColumn("reject_reason", outcome)
        .withColumn("accepted", F.col("reject_reason").isNull())
        .drop("_ok", "_largest", "_files")
    )


_NUMBERED = r"(?s)^(.+) \(([2-9]|[1-9][0-9]{1,2})\)\z"


def _extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]*)\z", 1)


def _stem(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(_extension(name)))


def _unnumbered(name: Column) -> Column:
    """``a (2).pdf`` -> ``a.pdf``; null for a name without a counter."""
    stem = _stem(name)
    parent = F.concat(F.regexp_extract(stem, _NUMBERED, 1), _extension(name))
    return F.when(F.rlike(stem, F.lit(_NUMBERED)), parent)


def _number(name: Column) -> Column:
    return F.regexp_extract(_stem(name), _NUMBERED, 2).try_cast("int")


def _counted(name: Column, number: Column) -> Column:
    return F.concat(_stem(name), F.lit(" ("), number.cast("string"), F.lit(")"), _extension(name))


def _root(name: Column) -> Column:
    """A name without any of its counters: ``a (2) (3).pdf`` -> ``a.pdf``."""
    return F.concat(F.regexp_replace(_stem(name), r"(?s)^(.+?)(?: \((?:[2-9]|[1-9][0-9]{1,2})\))+\z", "$1"), _extension(name))


def _walk_family(family: pd.DataFrame) -> pd.DataFrame:
    """Numbers for the arrivals of all names that are counted forms of one root, plain names before their numbered forms.

    Rows: n = 0 is an arrival, n > 0 a number that is taken from ``at`` on; ``level`` counts a name's counters and
    ``head`` and ``tail`` are what stands before and behind a further one. A name has 999 of each kind at most.
    """
    given: dict[str, int] = {}  # names an arrival got with a number, and when
    got = []
    for _, names in family.groupby("level", sort=True):
        for desired, rows in names.groupby("desired", sort=False):
            blocked: dict[int, int] = {}
            for n, at in zip(rows["n"], rows["at"]):
                if n > 0:
                    blocked[n] = min(at, blocked.get(n, at))
            if desired in given:
                blocked[1] = min(given[desired], blocked.get(1, given[desired]))
            head, tail, mine = rows["head"].iloc[0], rows["tail"].iloc[0], set()
            for at in sorted(int(at) for n, at in zip(rows["n"], rows["at"]) if n == 0):
                n = next((n for n in range(1, fixed.COLLISION_LAST_NUMBER + 1) if n not in mine and blocked.get(n, at) >= at), None)
                if n is None:
                    continue
                mine.add(n)
                got.append((family["folder"].iloc[0], at, n))
                if n > 1:
                    given[f"{head} ({n}){tail}"] = at
    return pd.DataFrame(got, columns=["folder", "arrival", "n"])


def collision_names(arrivals: DataFrame, existing: DataFrame) -> DataFrame:
    """Name every arriving file ends up with in its folder.

    ``arrivals``: folder, arrival (unique, >= 0, the order of arriving), desired,
    arrived_ms. ``existing``: folder, filename. An arrival takes the first free of
    ``base.ext``, ``base (2).ext`` .. ``base (999).ext``, else a time suffix. At most
    999 arrivals of one name can get a number, so only those are ranked together.

    Most names only compete with themselves: their k-th arrival takes the k-th free
    number. Where a name and one of its numbered forms both arrive, all counted forms of
    its root are one group, walked in order; other names never meet in a task.
    """
    last = fixed.COLLISION_LAST_NUMBER
    key = ["folder", "desired"]
    wanted = arrivals.groupBy(*key).agg(F.min("arrival").alias("first_at"))
    forms = wanted.withColumn("parent", _unnumbered(F.col("desired")))
    children = forms.join(
        wanted.select("folder", F.col("desired").alias("parent")), ["folder", "parent"], "left_semi"
    ).select("folder", F.col("parent").alias("desired"), _number(F.col("desired")).alias("n"), F.col("first_at").alias("at"), F.col("desired").alias("child"))
    tangled = children.select(*key).unionByName(children.select("folder", F.col("child").alias("desired"))).distinct()

    # numbers of a wanted name that are taken from the start, read off the existing names
    name = F.col("filename")
    used = (
        existing.select("folder", _unnumbered(name).alias("desired"), _number(name).alias("n"))
        .filter(F.col("desired").isNotNull())
        .unionByName(existing.select("folder", name.alias("desired"), F.lit(1).alias("n")))
        .distinct()
        .join(wanted, key, "left_semi")
    )
    by_arrival = Window.partitionBy(*key).orderBy("arrival")
    ranked = (
        arrivals.select(*key, "arrival").withColumn("_k", F.row_number().over(by_arrival)).filter(F.col("_k") <= last)
    )
    used_set = used.groupBy(*key).agg(F.collect_set("n").alias("_used"))
    free = F.array_except(F.sequence(F.lit(1), F.lit(last)), F.coalesce(F.col("_used"), F.array().cast("array<int>")))
    numbers = (
        ranked.join(tangled, key, "left_anti")
        .join(used_set, key, "left")
        .select(*key, "arrival", F.get(free, F.col("_k") - 1).alias("n"))
    )

    rows = (
        ranked.select(*key, F.lit(0).alias("n"), F.col("arrival").cast("bigint").alias("at"))
        .unionByName(used.select(*key, "n", F.lit(-1).cast("bigint").alias("at")))
        .unionByName(children.select(*key, "n", F.col("at").cast("bigint").alias("at")))
        .join(tangled, key, "left_semi")
    )
    name = F.col("desired")
    counters = F.regexp_extract(_stem(name), r"((?: \([0-9]+\))*)\z", 1)
    family = rows.withColumns({"root": _root(name), "head": _stem(name), "tail": _extension(name), "level": F.size(F.split(counters, r"\("))})
    walked = family.groupBy("folder", "root").applyInPandas(_walk_family, "folder string, arrival bigint, n int")
    numbers = numbers.select("folder", F.col("arrival").cast("bigint").alias("arrival"), "n").unionByName(walked)
    n = F.col("n")
    return (
        arrivals.join(numbers, ["folder", "arrival"], "left")
        .withColumn(
            "saved_name",
            F.when(n == 1, F.col("desired"))
            .when(n.isNotNull(), _counted(F.col("desired"), n))
            .otherwise(_counted(F.col("desired"), F.col("arrived_ms"))),
        )
        .drop("n")
    )
