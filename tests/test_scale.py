"""What keeps work, disk and tasks in proportion to the tables: plans and partitions of the steps that once were not."""

import time

from pyspark.sql import functions as F

from billweave.streaming import stateful

EVENT = "batch_id string, file_hash string, seq bigint, event_ts timestamp, kind string, remote_id string, sync_token string, error string"


def test_events_are_folded_without_a_call_per_entry(spark, tmp_path):
    events = spark.readStream.schema(EVENT).parquet(str(tmp_path))
    for job in (stateful.fold_stream, stateful.correction_stream):
        assert "TransformWithState" not in job(events)._jdf.queryExecution().analyzed().toString()
        assert "TransformWithState" in job(events, kept_ms=1000)._jdf.queryExecution().analyzed().toString()


def _states(spark, rows, job, path, kept_ms=None):
    """What a stream over the rows tells last of each key, and how many states it holds."""
    rows.repartition(3).write.parquet(f"{path}/in")
    stream = job(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), kept_ms)
    told = []
    writer = stream.writeStream.outputMode("update").foreachBatch(lambda batch, number: told.extend(batch.collect())).option("checkpointLocation", f"{path}/check")
    query = (writer if kept_ms else writer.trigger(availableNow=True)).start()
    if kept_ms:  # time alone starts micro-batches, so it runs on
        until = time.time() + 60
        while time.time() < until and sum(p["numInputRows"] for p in query.recentProgress) < rows.count():
            time.sleep(0.2)
        query.stop()
    query.awaitTermination()
    states = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    return told, states


def test_files_share_calls_and_state(spark, tmp_path, monkeypatch):
    from billweave.operators import ingest

    monkeypatch.setattr(stateful, "BUCKETS", 5, raising=False)
    samples = [(f"p{i % 40}", i % 7 // 2, i % 3, None if i % 90 == 0 else i * 7 % 200) for i in range(200)]
    rows = spark.createDataFrame(samples, "path string, size_bytes long, mtime long, at long").withColumn("sample_ts", F.timestamp_seconds("at")).drop("at")
    want = {tuple(r) for r in ingest.settled_files(rows.withColumnRenamed("size_bytes", "size")).collect()}
    for kept_ms, most in ((None, 5), (10**9, 40)):
        told, states = _states(spark, rows, stateful.settle_stream, tmp_path / f"settle{kept_ms}", kept_ms)
        assert set({r["path"]: tuple(r) for r in told}.values()) == want
        assert states <= most


def test_documents_share_calls_and_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 5, raising=False)
    files = [(f"s{i % 2}", f"h{i % 60}", 1000 - i, f"f{i}", i, "loaded") for i in range(300)] + [("s0", None, i, f"n{i}", i, "loaded") for i in range(3)]
    rows = spark.createDataFrame(files, "scan_id string, hash string, position long, filename string, size_bytes long, status string")
    for kept_ms, most in ((None, 5), (10**9, 61)):
        told, states = _states(spark, rows, stateful.first_copies, tmp_path / f"copies{kept_ms}", kept_ms)
        last = {r["filename"]: r["status"] for r in told}
        assert {f for f, status in last.items() if status == "loaded"} == {f"f{i}" for i in range(240, 300)} | {"n0"} and len(last) == 303
        assert states <= most


def test_short_lists_of_names_are_scored_in_many_tasks(spark):
    from billweave.operators import reconcile

    names = [(f"north pipe {i}",) for i in range(40)]
    q = spark.createDataFrame(names, "query_norm string").selectExpr("'r' as realm_id", "query_norm", "split(query_norm, ' ') as q_words")
    o = spark.createDataFrame(names, "option_norm string").selectExpr("'r' as realm_id", "option_norm", "split(option_norm, ' ') as o_words")
    near = q.withColumn("near", F.transform("q_words", lambda w: F.struct(w.alias("word"), w.alias("similar"), F.lit(1.0).alias("weight")))).drop("q_words")
    pairs = reconcile.candidate_pairs(q, o, near)
    used = pairs.withColumn("part", F.spark_partition_id()).select("part").distinct().count()
    found = [tuple(r)[1:3] for r in pairs.collect()]
    assert used > 4
    assert len(found) == len(set(found)) and {(n, n) for (n,) in names} <= set(found)


class Few:
    """An order that is a batch and one that is a send; the send lists one supplier's bill twice."""

    def __init__(self, spark):
        self.spark = spark
        self.orders = spark.sql(
            "select * from values (1L, timestamp'1992-05-01', '1-URGENT'), (2L, timestamp'1995-05-01', '1-URGENT') as o(o_orderkey, o_orderdate, o_orderpriority)"
        )
        self.lineitem = spark.sql(
            "select o as l_orderkey, p as l_partkey, s as l_suppkey, n as l_linenumber, 10.0D as l_extendedprice, 0.0D as l_discount, 0.0D as l_tax, f as l_returnflag, 'O' as l_linestatus, "
            "timestamp'1995-06-01' as l_shipdate from values (1L, 5L, 7L, 1, 'R'), (2L, 6L, 7L, 2, 'N'), (2L, 5L, 7L, 1, 'N'), (2L, 5L, 8L, 3, 'N') as l(o, p, s, n, f)"
        )


def test_documents_of_orders_are_computed_once(spark):
    from billweave.plans import posting

    found = posting.documents_of_orders(Few(spark))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["batch_id"], r["vendor_id"], r["position"]) for r in found.collect()) == [("1", "7", 1), ("2", "7", 1), ("2", "8", 3)]
    opened = [(r["send_no"], r["batch_id"], r["resumed"]) for r in posting.open_batch(Few(spark)).collect()]
    assert opened == [(2, "1", True)]
