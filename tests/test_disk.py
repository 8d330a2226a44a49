"""What a query leaves on disk while it runs: shuffle files of steps that are written, state and files of streams that ended."""

import os

from pyspark.sql import functions as F

from billweave import session
from billweave.operators import posting as posting_steps
from billweave.operators import sending
from billweave.plans import posting, streams
from billweave.streaming import batches, stateful
from tests.test_scale import EVENT, Few

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffles(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    return tracker.shuffleStatuses().size()


def test_a_written_step_leaves_no_shuffle(spark):
    before = _shuffles(spark)
    rows = session.cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k"))
    assert _shuffles(spark) <= before
    assert rows.count() == 7 and rows.groupBy().sum("count").first()[0] == 1000
    assert spark.conf.get(RELEASE, "false") == "false"


def test_streams_drop_what_they_have_read(spark, tmp_path, monkeypatch):
    for name, query in (("fold", streams.stream_fold), ("batches", streams.stream_batches), ("duplicates", streams.stream_duplicates)):
        monkeypatch.setattr(streams, "_folder", lambda t: f"{tmp_path}/{name}")  # noqa: B023
        rows = query(Few(spark)).collect()
        assert sorted(os.listdir(f"{tmp_path}/{name}")) == ["out"]
        if name == "fold":
            assert len(rows) == 4
        elif name == "batches":
            assert {r["batch_id"]: r["total"] for r in rows} == {"1": 1, "2": 3}
        else:
            assert sorted(map(tuple, rows)) == sorted(map(tuple, posting.dup_warnings(Few(spark)).collect()))


def test_state_keys_are_packed(spark, tmp_path):
    events = spark.readStream.schema(EVENT).parquet(str(tmp_path))
    for job in (stateful.fold_stream, stateful.correction_stream):
        assert "unhex" in job(events)._jdf.queryExecution().analyzed().toString()
    assert int(spark.conf.get("spark.sql.streaming.minBatchesToRetain")) == 2


def test_newest_rows_of_any_key(spark):
    digest = "ab" * 32
    rows = [("b", digest, "old", 0), ("b", digest, "new", 1), ("b", "no digest", "x", 0), ("b", None, "y", 1), (None, digest.upper(), "z", 0)]
    got = batches.newest_rows(spark.createDataFrame(rows, "batch_id string, file_hash string, state string, batch int"), ["batch_id", "file_hash"])
    assert got.columns == ["batch_id", "file_hash", "state"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("b", digest, "new"), ("b", "no digest", "x"), ("b", None, "y"), (None, digest.upper(), "z")], key=repr)


def test_sends_and_what_they_touch_are_computed_once(spark):
    documents = posting.documents_of_orders(Few(spark))
    rows = posting.sends(documents)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    before, held = posting.earlier_batches(Few(spark), documents)
    changed = sending.changed_entries(rows, sending.open_batches(rows, before, held), held)
    assert "maxby" not in changed._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
    assert sorted(r["file_hash"] for r in changed.collect()) == sorted(r["file_hash"] for r in rows.select("file_hash").distinct().collect())


def test_duplicates_are_found_before_they_are_dated(spark):
    few = Few(spark)
    found = posting.dup_warnings(few)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the ledger's; entries and probes have met before
    digest = posting.entries(few).select("id", "file_hash").collect()
    whole = posting_steps.duplicate_warnings(posting.probes(few), posting.coarse_entries(few), posting.ledger(few))
    assert {(r["entry_id"], r["file_hash"]) for r in whole.collect()} <= {tuple(r) for r in digest}
    assert found.count() == whole.count() > 0
