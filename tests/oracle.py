"""Compare registered queries with their SQL text in DuckDB, the way the driver does."""

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr), sorted(columns)


def difference(df, con, sql):
    """None when equal, else a short text."""
    result = con.execute(sql)
    want, want_columns = rows_of([d[0] for d in result.description], result.fetchall())
    got, got_columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want_columns != got_columns:
        return f"columns {got_columns} expected {want_columns}"
    if got == want:
        return None
    extra, missing = sorted(set(got) - set(want), key=repr)[:3], sorted(set(want) - set(got), key=repr)[:3]
    return f"{len(got)} rows, expected {len(want)}; extra {extra}; missing {missing}"


def main():
    from pyspark.sql import SparkSession

    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(folder), entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                diff = difference(fn(spark, folder), con, oracles[name])
                text = "ok" if diff is None else f"DIFF {diff}"
            else:
                text = f"rows {fn(spark, folder).count()}"
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            text = f"ERROR {type(e).__name__} {str(e)[:700]}"
        print(f"{name} {time.time() - start:.1f}s {text}", flush=True)


if __name__ == "__main__":
    main()
