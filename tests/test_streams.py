"""Stream jobs on small folders; the whole-table comparison is part of test_queries."""

from pyspark.sql import functions as F

from billweave.streaming import batches


def drain(job):
    job.trigger(availableNow=True).start().awaitTermination()


def test_inbox_job_marks_copies_across_batches(spark, tmp_path):
    inbox, out, ledger, check = (str(tmp_path / n) for n in ("inbox", "out", "ledger", "check"))
    (tmp_path / "inbox").mkdir()

    def put(name, text):
        (tmp_path / "inbox" / name).write_text(text)

    put("a.pdf", "one")
    put("b.pdf", "one")
    put("c.docx", "two")
    put("d.pdf", "posted")
    spark.range(1).select(F.sha2(F.lit("posted"), 256).alias("hash"), F.timestamp_seconds(F.lit(0)).alias("posted_at")).write.parquet(ledger)
    drain(batches.inbox_job(spark, inbox, ledger, out, check))
    put("e.pdf", "one")
    put("f.pdf", "three")
    drain(batches.inbox_job(spark, inbox, ledger, out, check))
    got = {r["filename"]: r["status"] for r in spark.read.parquet(out).collect()}
    assert sorted([got.pop("a.pdf"), got.pop("b.pdf")]) == ["duplicate-in-batch", "loaded"]
    assert got == {"c.docx": "unsupported-skipped", "d.pdf": "duplicate-excluded", "e.pdf": "duplicate-in-batch", "f.pdf": "loaded"}


def test_duplicate_job(spark, tmp_path):
    entries, ledger, probes, out = (str(tmp_path / n) for n in ("entries", "ledger", "probes", "out"))
    spark.sql(
        "select 'v' as vendor_id, 5L as amount_cents, date'2026-01-02' as txn_date, 'b' as batch_id, 'h' as file_hash, '1' as id, 'f' as filename, 'bill' as entry_type, "
        "'r' as remote_id, 'V' as vendor_name, 'confirmed' as state, cast(null as date) as undone_at"
    ).write.parquet(entries)
    spark.sql("select 'h' as hash, date'2026-01-03' as posted_at").write.parquet(ledger)
    spark.sql("select 'p' as row_key, 'v' as vendor_id, 5L as amount_cents, date'2026-01-05' as txn_date").write.parquet(probes)
    stream = spark.readStream.schema("row_key string, vendor_id string, amount_cents bigint, txn_date date").parquet(probes)
    drain(batches.duplicate_job(stream, entries, ledger, out, str(tmp_path / "check")))
    assert [(r["row_key"], r["days_apart"]) for r in spark.read.parquet(out).collect()] == [("p", -3)]


def test_streams_do_not_depend_on_arrival(spark, tmp_path):
    """One key with 30,000 events, undone first, and samples of text paths out of order, in several micro-batches."""
    import random

    from billweave.operators import posting
    from billweave.streaming import stateful

    r = random.Random(1)
    events = [("b", "h", 0, "undone"), ("b", "h", 29_000, "undone"), ("b", "h", 28_000, "confirmed")]
    events += [("b", "h", i, r.choice(["pending", "sent", "failed"])) for i in range(1, 30_000) if i not in (28_000, 29_000)]
    events += [("b", "other", 5, "confirmed"), ("b", "other", 9, "sent"), ("b", "third", 3, "undone")]
    rows = [(b, h, s, k, f"id{s}", f"t{s}", f"e{s}") for b, h, s, k in events]
    columns = "batch_id string, file_hash string, seq bigint, kind string, remote_id string, sync_token string, error string"
    frame = spark.createDataFrame(rows, columns).withColumn("event_ts", F.timestamp_seconds(1_770_000_000 + 37 * F.col("seq")))
    folded = run(spark, tmp_path / "fold", frame.repartition(3, F.hash("seq")), stateful.fold_stream, ["batch_id", "file_hash"])
    want = posting.fold_events(frame).select(*folded.columns)
    assert sorted(map(repr, folded.collect())) == sorted(map(repr, want.collect()))

    samples = [("a/b.pdf", 5 - i, 10, 1) for i in range(2)] + [("c.pdf", i, i, 1) for i in range(9, 0, -1)] + [("d.pdf", i, i // 8, 1) for i in range(20)] + [("e", 1, 1, 1)]
    frame = spark.createDataFrame(samples, "path string, at long, size_bytes long, mtime long").withColumn("sample_ts", F.timestamp_seconds("at")).drop("at")
    got = {x["path"]: x["settled"] for x in run(spark, tmp_path / "settle", frame.repartition(3, F.hash("sample_ts")), stateful.settle_stream, ["path"]).collect()}
    assert got == {"a/b.pdf": True, "c.pdf": False, "d.pdf": True, "e": False}


def run(spark, folder, rows, job, key):
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    batches.run_available(job(stream), "update", f"{folder}/out", f"{folder}/check")
    written = spark.read.parquet(f"{folder}/out")
    assert written.select("batch").distinct().count() >= 2
    return batches.newest_rows(written, key)


def parts_of(spark, folder, rows, parts, job):
    """Rows come in parts (functions of a row), one micro-batch each and a restart between; the job gets the stream."""
    for keep in parts:
        rows.filter(keep).coalesce(1).write.mode("append").parquet(f"{folder}")
        job(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))


def test_first_copies_whatever_comes_first(spark, tmp_path):
    import random

    from billweave.operators import ingest
    from billweave.streaming import stateful

    r = random.Random(4)
    files = [(f"s{r.randrange(2)}", f"h{int(r.expovariate(0.05))}", i, f"f{i}.pdf", i, "loaded") for i in range(400)]
    files += [("s0", None, 1000 + i, f"g{i}", i, "unsupported-skipped") for i in range(9)] + [("s0", "hot", 2000 - i, f"hot{i}", 1, "loaded") for i in range(300)]
    files += [("s1", "tie", 7, "b", 1, "loaded"), ("s1", "tie", 7, "a", 1, "loaded")]
    r.shuffle(files)
    schema = "scan_id string, hash string, position long, filename string, size_bytes long, status string, part int"
    rows = spark.createDataFrame([(*f, r.randrange(3)) for f in files], schema)
    rows = rows.unionByName(rows.filter("part = 0").withColumn("part", F.lit(2)))  # some files are told again
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    job = lambda stream: batches.run_available(stateful.first_copies(stream), "update", out, check)
    parts_of(spark, tmp_path / "in", rows, [F.col("part") == p for p in range(3)], job)
    got = batches.newest_rows(spark.read.parquet(out), ["scan_id", "position", "filename"])
    by_name = spark.createDataFrame(files, schema.rsplit(", ", 1)[0]).withColumn("position", F.struct("position", "filename"))
    want = ingest.mark_duplicates(by_name).withColumn("position", F.col("position.position"))
    columns = ["scan_id", "hash", "position", "filename", "size_bytes", "status"]
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))


def test_corrections_add_up_to_the_counts(spark, tmp_path):
    import random

    from billweave.operators import posting
    from billweave.streaming import stateful

    r = random.Random(8)
    kinds = ["pending", "sent", "failed", "confirmed", "undone", "undo-refused"]
    events = [(f"b{r.randrange(6)}", f"h{r.randrange(40)}", seq, r.choice(kinds), "i", "t", "e", r.randrange(3)) for seq in range(600)]
    rows = spark.createDataFrame(events, "batch_id string, file_hash string, seq long, kind string, remote_id string, sync_token string, error string, part int")
    rows = rows.withColumn("event_ts", F.timestamp_seconds(F.col("seq")))
    rows = rows.unionByName(rows.filter("part = 1").withColumn("part", F.lit(2)))  # a part is sent again
    corrections, out = str(tmp_path / "corrections"), str(tmp_path / "out")

    def job(stream):
        batches.run_corrections(stream.drop("part"), corrections, str(tmp_path / "check1"))
        counted = stateful.batch_stream(spark.readStream.schema(spark.read.parquet(corrections).schema).parquet(corrections))
        batches.run_available(counted, "update", out, str(tmp_path / "check2"))

    parts_of(spark, tmp_path / "in", rows, [F.col("part") == p for p in range(3)], job)
    got = batches.newest_rows(spark.read.parquet(out), ["batch_id"]).filter("total > 0")
    folded = posting.fold_events(rows.drop("part").distinct()).withColumn("amount_cents", F.lit(0))
    ids = spark.createDataFrame([(f"b{i}", "t", "r") for i in range(6)], "id string, created_at string, realm_id string")
    want = posting.batch_counts(ids, folded).filter("total > 0").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 6


def test_duplicates_between_two_streams(spark, tmp_path):
    import datetime
    import random

    from billweave.operators import posting
    from billweave.streaming import batches as jobs

    r = random.Random(6)
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    one = lambda i: (f"v{r.randrange(3)}", r.randrange(2) * 100, day(i // 3), i // 3 + r.randrange(10))
    probes = spark.createDataFrame([(f"p{i}", *one(i)) for i in range(600)], "row_key string, vendor_id string, amount_cents long, txn_date date, comes int")
    kept = "batch_id string, file_hash string, filename string, entry_type string, remote_id string, vendor_name string, state string, undone_at date"
    rows = [(f"e{i}", *one(i), "b", f"h{i % 7}", "f", "bill", "r", "V", "sent" if i % 11 == 0 else "confirmed", day(1) if i % 13 == 0 else None) for i in range(600)]
    entries = spark.createDataFrame(rows, f"id string, vendor_id string, amount_cents long, txn_date date, comes int, {kept}")
    ledger = spark.createDataFrame([(f"h{i}", day(i)) for i in range(4)], "hash string, posted_at date")
    ledger.write.parquet(str(tmp_path / "ledger"))
    state = 0
    for part in range(4):
        sides = []
        for name, side in (("probes", probes), ("entries", entries)):
            side.filter(F.floor(F.col("comes") / 55) == part).write.mode("append").parquet(str(tmp_path / name))
            sides.append(spark.readStream.schema(side.schema).parquet(str(tmp_path / name)))
        query = jobs.alert_job(*sides, str(tmp_path / "ledger"), str(tmp_path / "out"), str(tmp_path / "check"), late_days=10).trigger(availableNow=True).start()
        query.awaitTermination()
        state = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:])
    found = spark.read.parquet(str(tmp_path / "out"))
    want = posting.duplicate_warnings(probes, entries, ledger)
    columns = sorted(want.columns)
    assert sorted(map(repr, found.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
    assert 0 < state < 400  # of 1,800 rows with their buckets: what the watermarks have passed is gone
