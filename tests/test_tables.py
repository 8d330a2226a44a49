"""Operators on small literal tables: edges and state rules."""

import random

from pyspark.sql import functions as F

from billweave.operators import confidence, ingest, parse, posting, reference, review, sending
from billweave.sources import remote


def test_collision_names_equal_a_sequential_walk(spark):
    random.seed(11)
    wanted = ["a.pdf", "a (2).pdf", "a (3).pdf", "a (2) (2).pdf", "b", "b (2)", "c.x.pdf", ".pdf", "d (1).pdf"]
    existing = {"f": {"a (3).pdf", "c.x.pdf", "b (4)"}, "g": set()}
    arrivals = [(random.choice("fg"), i, random.choice(wanted), 1000 + i) for i in range(120)]
    taken, want = {k: set(v) for k, v in existing.items()}, {}
    for folder, at, name, ms in arrivals:
        dot = name.rfind(".")
        base, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        free = [name] + [f"{base} ({n}){ext}" for n in range(2, 1000)]
        want[at] = next(x for x in free if x not in taken[folder])
        taken[folder].add(want[at])
    df = spark.createDataFrame(arrivals, "folder string, arrival bigint, desired string, arrived_ms bigint")
    old = spark.createDataFrame([(f, n) for f, ns in existing.items() for n in ns], "folder string, filename string")
    got = {r["arrival"]: r["saved_name"] for r in ingest.collision_names(df, old).collect()}
    assert got == want


def test_collision_time_suffix_after_999(spark):
    df = spark.range(1001).select(F.lit("f").alias("folder"), F.col("id").alias("arrival"), F.lit("a.pdf").alias("desired"), (F.col("id") + 5000).alias("arrived_ms"))
    old = spark.createDataFrame([("f", "a (7).pdf")], "folder string, filename string")
    names = [r["saved_name"] for r in ingest.collision_names(df, old).orderBy("arrival").collect()]
    assert names[0] == "a.pdf" and names[5] == "a (6).pdf" and names[6] == "a (8).pdf" and names[997] == "a (999).pdf"
    assert names[998:] == ["a (5998).pdf", "a (5999).pdf", "a (6000).pdf"]


def test_page_route_edges(spark):
    nan, inf = float("nan"), float("inf")
    cases = [(0.75, 0.0, 900, 2, "image-only"), (0.74, 0.9, 50, 1, "native"), (0.0, 0.91, 500, 3, "image-only"), (0.0, 0.0, 49, 1, "image-only"), (0.0, 0.0, 50, 0, "image-only"), (nan, inf, 60, 1, "native"), (None, None, None, None, "image-only")]
    df = spark.createDataFrame(cases, "bitmap_coverage double, invisible_glyph_ratio double, non_ws_chars int, embedded_fonts int, want string")
    assert df.filter(parse.page_route() != F.col("want")).count() == 0


def test_selected_pages(spark):
    df = spark.createDataFrame([(1,), (10,), (11,), (0,), (None,)], "n int")
    got = [tuple(r[0]) for r in df.select(parse.selected_pages(F.col("n"))).collect()]
    assert got == [(0,), tuple(range(10)), (0, 1, 2, 9, 10), (0,), (0,)]


def test_reference_text_equals_plain_join(spark):
    random.seed(2)
    docs = {f"f{k}": ["".join(random.choice("ab \n\u00a0") for _ in range(random.choice([0, 3, 9000, 26000]))) for _ in range(random.randint(1, 7))] for k in range(25)}
    docs["blank"] = [" ", "\n", ""]
    rows = [(f, i, t) for f, pages in docs.items() for i, t in enumerate(pages)]
    got = {r[0]: r for r in parse.reference_text(spark.createDataFrame(rows, "file_hash string, page_no int, text string")).collect()}
    space = " \t\n\r\x0b\x0c\u00a0"
    for f, pages in docs.items():
        joined = "\n\n".join(pages).strip(space)
        if joined == "":
            assert f not in got
        else:
            assert (got[f]["reference_text"], got[f]["text_truncated"], got[f]["full_length"]) == (joined[:50000], len(joined) > 50000, len(joined)), f


def test_reference_text_of_one_large_file(spark):
    """20,000 pages of one file, more beside it; blank ones in front, inside and behind; out of order."""
    r = random.Random(5)
    pages = {"big": ["" if i < 700 or i > 19_000 or i % 5 == 0 else r.choice([" a", "b\n", " c ", "d" * 9]) for i in range(20_000)], "one": ["", " x ", ""], "blank": [" "] * 600}
    rows = [(f, i - 300, t) for f, texts in pages.items() for i, t in enumerate(texts)] + [("one", None, "left out"), (None, 1, "left out"), ("nulls", 1, None), ("nulls", 2, "n")]
    r.shuffle(rows)
    routes = spark.createDataFrame([("big", "native"), ("one", "image-only"), ("nulls", "native")], "file_hash string, route string")
    frame = spark.createDataFrame(rows, "file_hash string, page_no int, text string")
    got = {x["file_hash"]: x for x in parse.reference_text(frame).collect()}
    joined = "\n\n".join(pages["big"]).strip(" \n ")
    assert (got["big"]["reference_text"], got["big"]["full_length"], got["big"]["text_truncated"]) == (joined[:50_000], len(joined), len(joined) > 50_000)
    assert (got["one"]["reference_text"], got["nulls"]["reference_text"], sorted(got)) == ("x", "n", ["big", "nulls", "one"])
    assert {x["file_hash"] for x in parse.reference_text(frame, routes).collect()} == {"big", "nulls"}
    assert parse.reference_text(frame.limit(0)).count() == 0
    plan = parse.reference_text(frame)._jdf.queryExecution().executedPlan().toString()
    assert all("_block" in line for line in plan.splitlines() if "Window [" in line and "_t#" in line)


def test_ladder(spark):
    ok, bad = '{"vendor": "v", "total": "1"}', "{}"
    calls = [
        ("first", "json_schema", 1, None, None, ok), ("repaired", "json_schema", 1, None, None, bad), ("repaired", "json_schema", 2, None, None, ok),
        ("twice", "json_schema", 1, None, None, bad), ("twice", "json_schema", 2, None, None, bad), ("twice", "json_object", 1, None, None, ok),
        ("down", "json_schema", 1, 400, "no such mode", None), ("down", "json_object", 1, None, None, ok), ("auth", "json_schema", 1, 401, "denied", None), ("auth", "json_object", 1, None, None, ok),
        ("dead", "json_schema", 1, None, "Connection reset", None), ("dead", "json_object", 1, None, None, ok), ("bare", "json_schema", 1, None, "x.parse is not a function", None), ("bare", "json_object", 1, None, None, ok),
        ("temp", "json_schema", 1, 400, "Temperature unsupported", None), ("temp", "json_schema", 2, None, None, bad), ("temp", "json_schema", 3, None, None, ok),
        ("fault", "json_schema", 1, 500, "temperature?", None), ("none", "plain", 2, None, None, ok),
    ]
    df = spark.createDataFrame([(f, 1, *c) for f, *c in calls], "file_hash string, pass int, rung string, attempt int, http_status int, error string, reply string")
    got = {r["file_hash"]: (r["ok"], r["reason"], r["rung"], r["status"]) for r in parse.extraction_outcome(df).collect()}
    assert got == {
        "first": (True, None, "json_schema", None), "repaired": (True, None, "json_schema", None), "twice": (False, "schema-invalid", "json_schema", None),
        "down": (True, None, "json_object", None), "auth": (False, "call-failed", "json_schema", 401), "dead": (False, "call-failed", "json_schema", None),
        "bare": (True, None, "json_object", None), "temp": (True, None, "json_schema", None), "fault": (False, "call-failed", "json_schema", 500), "none": (False, "no-reply", None, None),
    }


def test_self_report_only_fills_the_last_rung(spark):
    df = spark.sql(
        "select 'Acme' as vendor, cast(null as string) as invoice_number, cast(null as date) as invoice_date, cast(null as date) as due_date, 100L as subtotal_cents, "
        "cast(null as bigint) as tax_cents, 100L as total_cents, 'USD' as currency, 'Fuel' as suggested_category, array('date:dueDate', 'junk', 'x:other') as validation_flags, "
        "map('suggestedCategory', 'high') as report"
    )
    got = df.select(confidence.field_confidence(F.lit("acme fuel 1.00"), F.col("report"))).first()[0]
    assert got == {"vendor": "high", "dueDate": "flagged", "subtotalCents": "high", "totalCents": "high", "currency": "low", "suggestedCategory": "high"}
    marked = df.withColumn("field_confidence", F.create_map(F.lit("vendor"), F.lit("low"))).select(confidence.flagged_fields()).first()[0]
    assert marked == ["dueDate", "subtotalCents", "taxCents", "totalCents"]


ENTRY = (
    "id string, batch_id string, position int, file_hash string, filename string, entry_type string, request_id string, state string, remote_id string, sync_token string, error string, "
    "vendor_id string, vendor_name string, category_account_id string, category_account_name string, paid_from_account_id string, paid_from_account_name string, txn_date date, due_date date, "
    "ref_number string, memo string, amount_cents bigint, realm_id string, created_at string, updated_at string, undone_at date"
)


def entries(spark, *rows):
    import datetime

    base = dict(entry_type="bill", state="confirmed", vendor_id="42", category_account_id="7", amount_cents=12345, realm_id="r", created_at="t0", updated_at="t0", position=0)
    names = [c.split()[0] for c in ENTRY.split(", ")]
    out = []
    for r in rows:
        full = {**base, **r}
        if isinstance(full.get("txn_date"), str):
            full["txn_date"] = datetime.date.fromisoformat(full["txn_date"])
        out.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(out, ENTRY)


def test_duplicate_window_is_three_days_inclusive(spark):
    days = ["2026-07-23", "2026-07-24", "2026-07-30", "2026-07-31"]
    e = entries(spark, *[dict(id=str(i), batch_id="b", file_hash=f"h{i}", txn_date=d) for i, d in enumerate(days)], dict(id="9", batch_id="b", file_hash="h9", txn_date="2026-07-27", state="sent"))
    probe = spark.sql("select 'p' as row_key, '42' as vendor_id, 12345L as amount_cents, date'2026-07-27' as txn_date union all select 'q', '42', 1L, date'2026-07-27'")
    ledger = spark.createDataFrame([("h1", "2026-07-25")], "hash string, posted_at string").withColumn("posted_at", F.col("posted_at").cast("date"))
    found = posting.duplicate_warnings(probe, e, ledger).orderBy("txn_date").collect()
    assert [(str(r["txn_date"]), r["days_apart"], str(r["posted_at"])) for r in found] == [("2026-07-24", -3, "2026-07-25"), ("2026-07-30", 3, "None")]
    assert [tuple(r) for r in posting.duplicate_counts(probe, e, ledger).collect()] == [("p", 2, "2026-07-25")]


def test_send_joins_the_open_batch_and_keeps_request_ids(spark):
    batches = spark.createDataFrame([("b1", "t1", "r"), ("b2", "t2", "r")], "id string, created_at string, realm_id string")
    e = entries(
        spark, dict(id="1", batch_id="b2", file_hash="h1", request_id="k1", state="failed", error="x", position=0, vendor_id="1"),
        dict(id="2", batch_id="b2", file_hash="h2", request_id="k2", position=1, vendor_id="1"), dict(id="3", batch_id="b1", file_hash="h3", request_id="k3"),
    )
    rows = e.select("file_hash", "position", *posting.ENTRY_FIELDS).filter("file_hash = 'h1'")
    rows = rows.unionByName(rows.withColumn("file_hash", F.lit("h8")).withColumn("position", F.lit(5))).unionByName(rows.withColumn("file_hash", F.lit("h2")).withColumn("position", F.lit(2))).withColumn("vendor_id", F.lit("77"))
    send = {"realm_id": F.lit("r"), "send_id": F.lit("s9"), "send_no": F.lit(9).cast("long"), "sent_at": F.lit("t9")}
    rows = rows.withColumns(send)
    batch = sending.open_batches(rows, batches, e)
    assert batch.select("batch_id", "resumed").collect()[0][:] == ("b2", True)
    got = {r["file_hash"]: r for r in sending.prepare_entries(rows, batch, e).collect()}
    assert (got["h1"]["state"], got["h1"]["request_id"], got["h1"]["vendor_id"], got["h1"]["error"]) == ("pending", "k1", "77", None)
    assert (got["h2"]["state"], got["h2"]["vendor_id"], got["h2"]["updated_at"]) == ("confirmed", "1", "t0")
    assert (got["h8"]["state"], got["h8"]["position"], got["h8"]["batch_id"]) == ("pending", 2, "b2") and len(got["h8"]["request_id"]) == 64
    other = rows.withColumn("file_hash", F.concat(F.lit("z"), "file_hash"))
    assert sending.open_batches(other, batches, e).select("batch_id", "resumed").first()[0] not in ("b1", "b2")


def send_one_by_one(batches, entries, rows):
    """The same on dictionaries: {(batch, document): entry} and {send: (batch, resumed)}, one send after another."""
    import hashlib

    batches, held, went = {b: (at, realm) for b, at, realm in batches}, {(e["batch_id"], e["file_hash"]): dict(e) for e in entries}, {}
    sends = sorted({(r["realm_id"], r["send_no"], r["send_id"], r["sent_at"]) for r in rows})
    for realm, no, name, at in sends:
        mine = sorted((r for r in rows if (r["realm_id"], r["send_id"]) == (realm, name)), key=lambda r: r["position"])
        waiting = [(batches[b][0], b) for b, h in held if batches[b][1] == realm and held[b, h]["state"] != "confirmed"]
        target = max(waiting, default=(None, None))[1]
        resumed = target is not None and any((target, r["file_hash"]) in held for r in mine)
        if not resumed:
            target = hashlib.sha256(f"batch|{realm}|{name}".encode()).hexdigest()
            batches[target] = (at, realm)
        went[realm, name] = (target, resumed)
        for r in mine:
            old = held.get((target, r["file_hash"]))
            place = sum(b == target for b, _ in held)
            if old is None:
                held[target, r["file_hash"]] = {"state": "pending", "position": place, "vendor_id": r["vendor_id"], "created_at": at, "updated_at": at}
            elif old["state"] != "confirmed":
                old.update(state="pending", vendor_id=r["vendor_id"], updated_at=at)
    return held, went


def test_many_sends_equal_one_after_another(spark):
    import random

    r = random.Random(12)
    batches = [(f"b{i}", f"t0{i}", f"r{i % 3}") for i in range(9)]
    held = [dict(id=f"e{i}-{h}", batch_id=f"b{i}", file_hash=f"h{h}", position=k, state=r.choice(["confirmed"] * 5 + ["failed", "sent"]), realm_id=f"r{i % 3}", vendor_id="0", request_id=f"k{i}-{h}")
            for i in range(9) for k, h in enumerate(r.sample(range(40), 4))]
    rows = []
    for realm in range(5):  # two realms have no batch yet
        for no in range(60):
            rows += [dict(realm_id=f"r{realm}", send_id=f"s{no}", send_no=no, sent_at=f"t1{no:02}", position=k, file_hash=f"h{h}", vendor_id=f"{no}-{k}") for k, h in enumerate(r.sample(range(40), r.randrange(1, 5)))]
    want, went = send_one_by_one(batches, [{**h, "created_at": "t0", "updated_at": "t0"} for h in held], rows)
    before = spark.createDataFrame(batches, "id string, created_at string, realm_id string")
    e = entries(spark, *held)
    sent = entries(spark, *[dict(file_hash=x["file_hash"], vendor_id=x["vendor_id"], position=x["position"], realm_id=x["realm_id"], remote_id=x["send_id"], created_at=x["sent_at"]) for x in rows])
    sent = sent.select("realm_id", F.col("remote_id").alias("send_id"), F.expr("int(substr(remote_id, 2))").cast("long").alias("send_no"), F.col("created_at").alias("sent_at"), "position", "file_hash", *posting.ENTRY_FIELDS)
    opened = sending.open_batches(sent, before, e)
    assert {(o.realm_id, o.send_id): (o.batch_id, o.resumed) for o in opened.collect()} == went
    assert {resumed for _, resumed in went.values()} == {True, False}
    after = sending.prepare_entries(sent, opened, e)
    got = {(x.batch_id, x.file_hash): x for x in after.collect()}
    assert set(got) == set(want)
    for key, entry in want.items():
        assert all(got[key][c] == entry[c] for c in ("state", "position", "vendor_id", "created_at", "updated_at")), key
        assert got[key].request_id == entry["request_id"] if "request_id" in entry else len(got[key].request_id) == 64
    # a second run of the same sends does nothing
    again = sending.open_batches(sent, sending.batches_after(before, opened), after, log=opened)
    assert again.count() == 0 and sending.changed_entries(sent, again, after).count() == 0
    assert sending.batches_after(before, opened).count() == 9 + sum(not resumed for _, resumed in went.values())


def test_a_send_with_a_violation_is_refused_whole(spark):
    rows = spark.sql("select 'r' as realm_id, s as send_id, 1 as position, f as file_hash, t as entry_type, cast(null as string) as paid_from_account_id from values ('a','x','bill'),('a','y','expense'),('b','x','bill') as v(s, f, t)")
    assert [x.send_id for x in sending.accepted(rows).collect()] == ["b"]


def test_fold_ignores_order_replay_and_late_events(spark):
    events = [("b", "h", 1, "pending", None), ("b", "h", 4, "confirmed", None), ("b", "h", 2, "sent", None), ("b", "h", 3, "failed", "x"), ("b", "h", 4, "confirmed", None), ("b", "h", 5, "failed", "late"), ("b", "g", 1, "sent", None), ("b", "g", 2, "failed", "y")]
    df = spark.createDataFrame(events, "batch_id string, file_hash string, seq bigint, kind string, error string").withColumn("event_ts", F.date_add(F.lit("2026-01-01").cast("date"), F.col("seq").cast("int"))).withColumn("remote_id", F.lit("r")).withColumn("sync_token", F.lit("0"))
    got = {r["file_hash"]: r for r in posting.fold_events(df).collect()}
    assert (got["h"]["state"], got["h"]["error"], str(got["h"]["sent_at"])) == ("confirmed", None, "2026-01-03")
    assert (got["g"]["state"], got["g"]["error"], got["g"]["remote_id"]) == ("failed", "y", None)


def test_snapshot_merge_deactivates(spark):
    cols = "realm_id string, entity_kind string, entity_id string, name string, active boolean, account_type string, account_sub_type string"
    old = spark.createDataFrame([("r", "vendor", "1", "A", True, None, None), ("r", "vendor", "2", "B", True, None, None), ("s", "vendor", "1", "C", True, None, None)], cols).withColumn("synced_at", F.lit("t0"))
    new = spark.createDataFrame([("r", "vendor", "1", "A2", True, None, None), ("r", "item", "9", "I", True, None, None)], cols)
    realms = spark.createDataFrame([("r",)], "realm_id string")
    got = sorted((r["realm_id"], r["entity_kind"], r["entity_id"], r["name"], r["active"], r["synced_at"]) for r in reference.merge_snapshot(old, new, realms, F.lit("t1")).collect())
    assert got == [("r", "item", "9", "I", True, "t1"), ("r", "vendor", "1", "A2", True, "t1"), ("r", "vendor", "2", "B", False, "t0"), ("s", "vendor", "1", "C", True, "t0")]


def test_remote_pages_end_at_the_first_short_page(spark, tmp_path):
    import json

    full = [{"Id": str(i), "DisplayName": f"V{i}", "Active": True} for i in range(1000)]
    pages = [full, [{"Id": "x", "CompanyName": "Short"}, {"Id": "", "DisplayName": "no id"}, {"Id": "y", "DisplayName": ""}], [{"Id": "late", "DisplayName": "late"}]]
    lines = [json.dumps({"realm_id": "r", "entity": "Vendor", "page_no": i, "QueryResponse": {"Vendor": p}}) for i, p in enumerate(pages)]
    (tmp_path / "pages.json").write_text("\n".join(lines))
    rows = reference.map_records(remote.remote_records(remote.read_pages(spark, str(tmp_path / "pages.json"))))
    assert rows.count() == 1001 and rows.filter("entity_id = 'x'").first()["name"] == "Short"


def test_a_pull_without_its_end_is_not_complete(spark):
    page = lambda realm, no, n: (realm, "Vendor", no, [{"Id": f"{no}-{i}", "DisplayName": "v"} for i in range(n)])
    rows = [page("whole", 0, 1000), page("whole", 1, 3), page("open", 0, 1000), page("gap", 0, 1000), page("gap", 2, 1)]
    rows += [page("many", i, 1000 if i < 230 else 0) for i in range(231)]
    pages = spark.createDataFrame(rows, "realm_id string, entity string, page_no int, records array<struct<Id: string, DisplayName: string>>")
    assert {r["realm_id"] for r in remote.complete_pulls(pages).collect()} == {"whole", "many"}
    kept = {r["realm_id"]: r["count"] for r in remote.complete_pages(pages).groupBy("realm_id").count().collect()}
    assert kept == {"whole": 2, "open": 1, "gap": 2, "many": 231}


def test_review_clears_are_kept_apart_from_untouched(spark):
    seeds = spark.sql("select 'h' as file_hash, 1 as position, 'f' as filename, 'loaded' as scan_status, 'bill' as entry_type, 'V' as vendor_id, 'auto' as vendor_tier, 'C' as category_account_id, 'auto' as category_tier, '10.00' as amount_text, '2026-01-01' as txn_date, '' as due_date, '' as ref_number, true as included")
    edit = spark.sql("select 'h' as file_hash, cast(null as string) as entry_type, cast(null as string) as vendor_id, true as vendor_touched, 'X' as category_account_id, false as category_touched, '35' as paid_from_account_id, cast(null as string) as amount_text, cast(null as string) as txn_date, cast(null as string) as due_date, cast(null as string) as ref_number, cast(null as boolean) as included")
    row = review.resolve_rows(seeds, edit).first()
    assert (row["vendor_id"], row["vendor_tier"], row["category_account_id"], row["category_tier"], row["paid_from_account_id"], row["amount_cents"]) == (None, None, "C", "auto", None, 1000)


def test_category_outcomes(spark):
    """Payment accounts, records of another realm, inactive ones and missing answers are told apart."""
    from billweave.operators import evaluate

    documents = spark.createDataFrame(
        [("r", "a", "office supplies"), ("r", "b", "one two three four five"), ("r", "c", None), ("r", "d", "  "), ("r", "e", "bank"), ("s", "f", "x"), ("r", "g", "gone"), ("r", "h", "no answer")],
        "realm_id string, file_hash string, phrase string",
    )
    answers = spark.createDataFrame(
        [("r", "a", "1", "auto"), ("r", "b", "1", "suggested"), ("r", "c", None, "none"), ("r", "d", None, "none"), ("r", "e", "2", "auto"), ("s", "f", "1", "suggested"), ("r", "g", "3", "auto"), ("r", "x", "9", "auto")],
        "realm_id string, file_hash string, category_selected_id string, category_confidence string",
    )
    reference = spark.createDataFrame(
        [("r", "account", "1", "Office", True, "Expense"), ("r", "account", "2", "Checking", True, "Bank"), ("r", "account", "3", "Old", False, "Expense")],
        "realm_id string, entity_kind string, entity_id string, name string, active boolean, account_type string",
    )
    got = evaluate.category_outcomes(documents, answers, reference).first()
    assert tuple(got) == (8, 6, 1, 5, 5 / 8, 0, 3)
    none = evaluate.category_outcomes(documents.limit(0), answers, reference).first()
    assert (none["documents"], none["resolved_share"]) == (0, None)
