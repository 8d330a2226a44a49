"""The table of finished parses: what can be answered from it and how it is kept."""

from pyspark.sql import Column, DataFrame, functions as F

from billweave import fixed
from billweave.functions.text import is_blank, trim_all
from billweave.operators.joins import upsert


def split_by_cache(files: DataFrame, parsed: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(answered, to_parse): a row counts only when written under the current contract version.

    A different model is not a reason to parse again; ``force`` parses everything.
    """
    if force:
        return files.limit(0).join(parsed, "file_hash"), files
    current = parsed.filter(F.col("schema_version") == fixed.PARSE_SCHEMA_VERSION)
    answered = files.join(current, "file_hash")
    return answered, files.join(current.select("file_hash"), "file_hash", "left_anti")


def store(parsed: DataFrame, fresh: DataFrame, newest: str = "parsed_at") -> DataFrame:
    """New snapshot of the parse table: one row per file, the fresh one (the newest of several) wins."""
    values = [c for c in parsed.columns if c != "file_hash"]
    stamped = fresh.withColumn("schema_version", F.lit(fixed.PARSE_SCHEMA_VERSION))
    latest = stamped.groupBy("file_hash").agg(F.max_by(F.struct(*values), newest).alias("_v"))
    return upsert(parsed, latest.select("file_hash", *[F.col(f"_v.{c}").alias(c) for c in values]), ["file_hash"])


def url_host(url: Column) -> Column:
    """host[:port] of a web address without user info and default port, null on junk."""
    address = trim_all(url)
    scheme = F.lower(F.regexp_extract(address, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*:[\\/]{2,}([^/\\?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, r"^.*@", ""))
    host = F.when(scheme == "https", F.regexp_replace(host, r":(443)?\z", ""))\
        .when(scheme == "http", F.regexp_replace(host, r":(80)?\z", ""))\
        .otherwise(F.regexp_replace(host, r":\z", ""))
    valid = F.rlike(host, F.lit(r"^(?:\[[0-9a-f:.]+\]|[^\s:<>\[\]^|%]+)(?::[0-9]{1,5})?\z"))
    return F.when(~is_blank(url) & valid, host)


def decode_confidence(text: Column) -> Column:
    """Stored JSON -> map with only the three known levels; empty when unreadable."""
    levels = F.from_json(text, "map<string,string>")
    return F.coalesce(
        F.map_filter(levels, lambda k, v: v.isin("high", "low", "flagged")), F.create_map().cast("map<string,string>")
    )


def decode_flags(text: Column) -> Column:
    """Stored JSON -> list of its text items; empty when unreadable or not a list."""
    items = F.from_json(text, "array<variant>")
    texts = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    empty = F.array().cast("array<string>")
    return F.coalesce(F.transform(texts, lambda v: F.variant_get(v, "$", "string")), empty)
