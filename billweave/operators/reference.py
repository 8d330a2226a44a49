"""Reference lists: remote pages to a snapshot that deactivates instead of deleting."""

from pyspark.sql import Column, DataFrame, functions as F

from billweave import fixed
from billweave.functions.text import ascii_lower, trim_all
from billweave.operators.joins import lookup

COLUMNS = ["realm_id", "entity_kind", "entity_id", "name", "active", "account_type", "account_sub_type", "synced_at"]
_KEY = ["realm_id", "entity_kind", "entity_id"]


def map_records(records: DataFrame) -> DataFrame:
    """Remote records -> reference rows; records without an id or a usable name are dropped."""
    r = F.col("record")
    vendor_ok = ~F.coalesce(r["DisplayName"] == "", F.lit(False))
    name = (
        F.when((F.col("entity") == "Vendor") & vendor_ok, F.coalesce(r["DisplayName"], r["CompanyName"]))
        .when(
            (F.col("entity") == "Account") & ~F.coalesce(r["Name"] == "", F.lit(False)),
            F.coalesce(r["FullyQualifiedName"], r["Name"]),
        )
        .when(F.col("entity") == "Item", r["Name"])
    )
    is_account = F.col("entity") == "Account"
    return records.select(
        "realm_id",
        F.lower("entity").alias("entity_kind"),
        r["Id"].alias("entity_id"),
        name.alias("name"),
        F.coalesce(r["Active"], F.lit(True)).alias("active"),
        F.when(is_account, r["AccountType"]).alias("account_type"),
        F.when(is_account, r["AccountSubType"]).alias("account_sub_type"),
    ).filter(
        (F.col("entity_id") != "")
        & (F.col("name") != "")
        & (~(F.col("entity_kind") == "account") | F.coalesce(F.col("account_type") != "", F.lit(False)))
    )


def merge_snapshot(old: DataFrame, received: DataFrame, realms: DataFrame, synced_at: Column) -> DataFrame:
    """Next snapshot: received rows replace, vanished rows of a synced realm stay but turn inactive.

    ``realms`` (realm_id) are the companies whose pull succeeded; rows of any other
    realm are left alone. A record received twice keeps its last page position if
    ``received`` has one, else the greatest row.
    """
    values = [c for c in COLUMNS if c not in (*_KEY, "synced_at")]
    order = F.col("row_order") if "row_order" in received.columns else F.struct(*values)
    new = received.groupBy(*_KEY).agg(F.max_by(F.struct(*values), order).alias("_new"))
    before = old.select(*_KEY, F.struct(*values, "synced_at").alias("_old"))
    pulled = realms.select("realm_id", F.lit(True).alias("_pulled")).distinct()
    merged = lookup(before.join(new, _KEY, "full_outer"), pulled, "realm_id")
    arrived = F.col("_new").isNotNull()
    kept = [
        F.when(arrived, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in values if c != "active"
    ]
    active = (
        F.when(arrived, F.col("_new.active"))
        .when(F.coalesce(F.col("_pulled"), F.lit(False)), F.lit(False))
        .otherwise(F.col("_old.active"))
    )
    stamp = F.when(arrived, synced_at).otherwise(F.col("_old.synced_at"))
    return merged.select(*_KEY, active.alias("active"), *kept, stamp.alias("synced_at")).select(*COLUMNS)


def sync_counts(received: DataFrame) -> DataFrame:
    kind, account = F.col("entity_kind"), F.col("account_type")
    return received.groupBy("realm_id").agg(
        F.count_if(kind == "vendor").alias("vendors"),
        F.count_if((kind == "account") & account.isin(*fixed.EXPENSE_ACCOUNT_TYPES)).alias("expense_accounts"),
        F.count_if((kind == "account") & account.isin(*fixed.PAYMENT_ACCOUNT_TYPES)).alias("payment_accounts"),
        F.count_if(kind == "item").alias("items"),
    )


def list_name() -> Column:
    """Which of the four lists a reference row belongs to; null when it belongs to none."""
    kind, account = F.col("entity_kind"), F.col("account_type")
    return (
        F.when(kind == "vendor", "vendors")
        .when(kind == "item", "items")
        .when((kind == "account") & account.isin(*fixed.EXPENSE_ACCOUNT_TYPES), "expense_accounts")
        .when((kind == "account") & account.isin(*fixed.PAYMENT_ACCOUNT_TYPES), "payment_accounts")
    )


def read_lists(reference: DataFrame, realm_id: str | None = None) -> DataFrame:
    """The lists of one realm (or of all), ordered by name without regard to ASCII case."""
    rows = reference if realm_id is None else reference.filter(F.col("realm_id") == realm_id)
    leaf = F.when(F.col("entity_kind") == "account", account_leaf(F.col("name")))
    return (
        rows.withColumn("list_name", list_name())
        .filter(F.col("list_name").isNotNull())
        .withColumn("short_name", leaf)
        .orderBy("realm_id", "list_name", ascii_lower(F.col("name")), "entity_id")
    )


def account_leaf(path: Column) -> Column:
    """Last segment of a colon path, or the whole path when that segment is blank."""
    leaf = trim_all(F.substring_index(path, ":", -1))
    return F.when(leaf != "", leaf).otherwise(path)


def resolve(df: DataFrame, reference: DataFrame, kind: str, id_column: str, name_as: str, type_as: str | None = None) -> DataFrame:
    """Point lookup by (realm, kind, id), inactive rows included."""
    names = reference.filter(F.col("entity_kind") == kind).select(
        "realm_id",
        F.col("entity_id").alias(id_column),
        F.col("name").alias(name_as),
        *([F.col("account_type").alias(type_as)] if type_as else []),
    )
    return lookup(df, names, ["realm_id", id_column])


def drop_realm(reference: DataFrame, realm_id: str) -> DataFrame:
    return reference.filter(F.col("realm_id") != realm_id)


def option_list(records: DataFrame, selected: DataFrame) -> DataFrame:
    """Active records plus inactive ones that a row has selected (``selected``: realm_id, entity_id)."""
    chosen = selected.select("realm_id", "entity_id").distinct()
    return records.filter("active").unionByName(
        records.filter(~F.col("active")).join(chosen, ["realm_id", "entity_id"], "left_semi").select(*records.columns)
    )


def vision_class(model_id: Column, input_modalities: Column | None = None) -> Column:
    """vision by the endpoint's own metadata, vision-family by a known name, else unknown."""
    known = F.rlike(model_id, F.lit("(?i)" + "|".join(fixed.VISION_MODEL_PATTERNS)))
    declared = (
        F.lit(False) if input_modalities is None else F.exists(input_modalities, lambda m: F.lower(m) == "image")
    )
    return (
        F.when(F.coalesce(declared, F.lit(False)), "vision").when(F.coalesce(known, F.lit(False)), "vision-family").otherwise("unknown")
    )


MODEL_ENTRY = "id string, name string, architecture struct<input_modalities: array<string>, output_modalities: array<string>>, supported_parameters array<string>, context_length double"


def model_catalogue(entries: DataFrame, column: str = "entry") -> DataFrame:
    """JSON entries of a model listing -> classified models; entries without a usable id are skipped."""
    e = F.col("_e")
    return (
        entries.withColumn("_e", F.from_json(F.col(column), MODEL_ENTRY))
        .filter(F.length(e["id"]).between(1, 256) & (F.coalesce(F.length(e["name"]), F.lit(0)) <= 512))
        .select(
            e["id"].alias("id"),
            e["name"].alias("label"),
            vision_class(e["id"], e["architecture"]["input_modalities"]).alias("vision"),
            e["architecture"]["input_modalities"].alias("input_modalities"),
            e["supported_parameters"].alias("supported_parameters"),
            e["context_length"].alias("context_length"),
        )
    )
