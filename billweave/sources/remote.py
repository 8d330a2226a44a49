"""Landed pages of a remote accounting service."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from billweave import fixed

RECORD = (
    "struct<Id: string, DisplayName: string, CompanyName: string, Name: string, FullyQualifiedName: string, "
    "AccountType: string, AccountSubType: string, Active: boolean>"
)
PAGE = f"realm_id string, entity string, page_no int, QueryResponse struct<Vendor: array<{RECORD}>, Account: array<{RECORD}>, Item: array<{RECORD}>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one page per line -> realm_id, entity, page_no, records; never infers a schema."""
    pages = spark.read.schema(PAGE).json(path)
    body = F.col("QueryResponse")
    records = (
        F.when(F.col("entity") == "Vendor", body["Vendor"]).when(F.col("entity") == "Account", body["Account"]).otherwise(body["Item"])
    )
    return pages.select("realm_id", "entity", "page_no", records.alias("records"))


def _last_pages(pages: DataFrame) -> DataFrame:
    """realm_id, entity and the number of the first short or empty page, which ends a pull (null: none landed yet)."""
    short = F.coalesce(F.size("records"), F.lit(0)) < fixed.REMOTE_PAGE_SIZE
    return pages.groupBy("realm_id", "entity").agg(F.min(F.when(short, F.col("page_no"))).alias("_last"), F.count_distinct("page_no").alias("_pages"))


def complete_pages(pages: DataFrame) -> DataFrame:
    """Pages up to the first short or empty one. However many pages a pull has, none of them is left out."""
    return (
        pages.join(_last_pages(pages), ["realm_id", "entity"])
        .filter(F.col("_last").isNull() | (F.col("page_no") <= F.col("_last")))
        .drop("_last", "_pages")
    )


def complete_pulls(pages: DataFrame) -> DataFrame:
    """realm_id, entity of the pulls that reached their end with every page before it landed.

    Only these may be merged as whole snapshots: records missing from any other pull are not gone.
    """
    first = pages.groupBy("realm_id", "entity").agg(F.min("page_no").alias("_first"), F.max("page_no").alias("_highest"))
    kept = complete_pages(pages).groupBy("realm_id", "entity").agg(F.count_distinct("page_no").alias("_kept"))
    ended = _last_pages(pages).join(first, ["realm_id", "entity"]).join(kept, ["realm_id", "entity"])
    return ended.filter(F.col("_last").isNotNull() & (F.col("_kept") == F.col("_last") - F.col("_first") + 1)).select("realm_id", "entity")


def wanted_records(rows: DataFrame) -> DataFrame:
    """The filter of each kind: active vendors and items, accounts of the three usable types."""
    usable = F.col("record.AccountType").isin(*fixed.EXPENSE_ACCOUNT_TYPES, *fixed.PAYMENT_ACCOUNT_TYPES)
    active = F.coalesce(F.col("record.Active"), F.lit(True))
    return rows.filter(F.when(F.col("entity") == "Account", usable).otherwise(active))


def remote_records(pages: DataFrame) -> DataFrame:
    """One row per wanted record of the kept pages."""
    return wanted_records(complete_pages(pages).select("realm_id", "entity", F.explode("records").alias("record")))
