"""Join and merge helpers shared by the operators."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def lookup(df: DataFrame, table: DataFrame, on, how: str = "left") -> DataFrame:
    """Join to a lookup table without a hint.

    Spark broadcasts the table only when its size, estimated before or measured at
    run time, is below ``spark.sql.autoBroadcastJoinThreshold``; beyond that it is a
    shuffle join whose hot keys adaptive execution splits.
    """
    return df.join(table, on, how)


def left_join_sparse(df: DataFrame, table: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Left join on a text key that is null in many rows of ``df``.

    A shuffle would send every null to one task; here each such row gets a key of
    its own that matches nothing, so they spread evenly.
    """
    rest = [c for c in df.columns if c != key]
    spread = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.xxhash64(*[F.col(c) for c in rest if not _is_map(df, c)]).cast("string")))
    right = table.withColumnRenamed(key, "_key")
    return df.withColumn("_key", spread).join(right, ["_key", *by], "left").drop("_key")


def _is_map(df: DataFrame, name: str) -> bool:
    return "map<" in df.schema[name].dataType.simpleString() or "variant" in df.schema[name].dataType.simpleString()


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], keep: Sequence[str]) -> DataFrame:
    """The row with the lowest ``order`` per key, as an aggregate.

    Unlike a window this combines on the map side, so a key that holds a third of
    all rows is reduced to one row per task before anything moves.
    """
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_first"))
        .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in keep])
    )


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New snapshot of a keyed table: a row of ``new`` replaces all columns of ``old``."""
    values = [c for c in old.columns if c not in keys]
    n = new.select(*keys, F.struct(*values).alias("_new"))
    o = old.select(*keys, F.struct(*values).alias("_old"))
    merged = o.join(n, list(keys), "full_outer").withColumn("_row", F.coalesce("_new", "_old"))
    return merged.select(*keys, *[F.col(f"_row.{v}").alias(v) for v in values]).select(*old.columns)
