"""Keyed state for continuous input: first copies, settling files, the fold of posting events and its batch counts.

What a key's state holds does not depend on the order in which its rows arrive or on how they
are cut into micro-batches: the first samples of a file by time, the events of an
entry by number. Each micro-batch emits a key's row as it stands; the newest counts.
With ``kept_ms`` the state of a key that gets no rows for so long ends; a stream with it runs on
until it is stopped, since time alone can be a reason for another micro-batch.
"""

from bisect import insort

from pyspark.sql import Column, DataFrame, GroupedData, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from billweave import fixed
from billweave.functions.text import packed, unpacked
from billweave.operators.ingest import DUPLICATE_IN_BATCH, LOADED
from billweave.operators.posting import batch_state

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}
# times are microseconds inside the state, so that they come back as they went in
_FOLDED = (
    "batch_id string, file_hash string, state string, sent_at bigint, confirmed_at bigint, remote_id string, "
    "sync_token string, error string, undone_at bigint, undo_reason string"
)
COUNTS = ("total", "confirmed", "failed", "undone")
#: groups of keys that share a call of a Python processor
BUCKETS = 1024
_STATES, _UNDOS = ("pending", "sent", "failed", "confirmed"), ("undone", "undo-refused")


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB, compressed; a restart needs the last micro-batches' versions, not those of the last hundred."""
    for key, value in _STATE.items():
        spark.conf.set(key, value)


class FirstCopyProcessor(StatefulProcessor):
    """The copy of a document that was listed first stays loaded, all others are duplicates.

    State is that one copy of each document that shares the key. A copy that turns up later but was listed earlier takes its
    place, and the one before is told again as a duplicate; the same file once more changes nothing.
    """

    def __init__(self, types, kept_ms=None):
        self.types, self.kept_ms = types, kept_ms

    def init(self, handle):
        self.first = handle.getValueState("first", _lists(self.types), self.kept_ms)

    def handleInputRows(self, key, rows, timer_values):
        before = {f[:2]: f[2:] for f in zip(*(self.first.get() or ()))}
        first = dict(before)
        for r in rows:
            document, file = (r.scan_id, r.hash), (r.position, r.filename, r.size_bytes)
            loaded = first.get(document)
            if loaded is None or file[:2] < loaded[:2]:
                first[document], file = file, loaded
            if file is not None and file[:2] != first[document][:2]:
                yield self._row(document, file, DUPLICATE_IN_BATCH)
        changed = [document for document, file in first.items() if file != before.get(document)]
        if changed:
            self.first.update(tuple(map(list, zip(*((*document, *file) for document, file in first.items())))))
        for document in changed:
            yield self._row(document, first[document], LOADED)

    @staticmethod
    def _row(document, file, status):
        return Row(scan_id=document[0], hash=document[1], position=file[0], filename=file[1], size_bytes=file[2], status=status)

    def close(self):
        pass


class SettleProcessor(StatefulProcessor):
    """A file is settled when two neighbouring samples of its first seven are equal; state is those of all files that share the key."""

    def __init__(self, path_type, kept_ms=None):
        self.path_type, self.kept_ms = path_type, kept_ms

    def init(self, handle):
        types = {"path": self.path_type, "at": "bigint", "size": "bigint", "mtime": "bigint"}
        self.first = handle.getValueState("first", _lists(types), self.kept_ms)

    def handleInputRows(self, key, rows, timer_values):
        first = {}
        for path, *sample in zip(*(self.first.get() or ())):
            first.setdefault(path, []).append(tuple(sample))
        told = set()
        for r in rows:
            told.add(r.path)
            samples = first.setdefault(r.path, [])
            insort(samples, (r.at, r.size_bytes, r.mtime), key=_time)
            del samples[fixed.SETTLE_MAX_RESAMPLES + 1 :]
        self.first.update(tuple(map(list, zip(*((path, *s) for path, samples in first.items() for s in samples)))))
        for path in told:
            samples = first[path]
            yield Row(path=path, settled=any(a[1:] == b[1:] for a, b in zip(samples, samples[1:])))

    def close(self):
        pass


def _time(sample):
    """Samples without a time come first, as Spark sorts them."""
    return sample[0] is not None, sample[0] or 0


def _lists(types: dict[str, str]) -> str:
    """State of several rows as one value: a list per column."""
    return ", ".join(f"{c} array<{t}>" for c, t in types.items())


class FoldProcessor(StatefulProcessor):
    """Current entry of a document. Nothing leaves ``confirmed``; a replayed event changes nothing."""

    def __init__(self, kept_ms=None):
        self.kept_ms = kept_ms

    def init(self, handle):
        self.events = handle.getMapState("events", "seq bigint", "kind string, at bigint, remote string, token string, error string", self.kept_ms)

    def handleInputRows(self, key, rows, timer_values):
        for e in rows:
            self.events.updateValue((e.seq,), (e.kind, e.at, e.remote_id, e.sync_token, e.error))
        entry = self._entry(key, sorted((seq[0], *event) for seq, event in self.events.iterator()))
        if entry is not None:
            yield entry

    @staticmethod
    def _entry(key, events):
        sealed = min((e[0] for e in events if e[1] == "confirmed"), default=None)
        steps = [e for e in events if e[1] in _STATES and (sealed is None or e[0] <= sealed)]
        undos = [e for e in events if e[1] in _UNDOS and sealed is not None and e[0] > sealed]
        if not steps and not undos:
            return None
        newest = {e[1]: e for e in [*steps, *undos]}  # in order of their numbers
        at = lambda kind: newest[kind][2] if kind in newest else None
        confirmed = newest.get("confirmed", (None,) * 6)
        return Row(
            batch_id=key[0],
            file_hash=key[1],
            state=steps[-1][1] if steps else None,
            sent_at=at("sent"),
            confirmed_at=at("confirmed"),
            remote_id=confirmed[3],
            sync_token=confirmed[4],
            error=steps[-1][5] if steps and steps[-1][1] == "failed" else None,
            undone_at=at("undone"),
            undo_reason=undos[-1][5] if undos and undos[-1][1] == "undo-refused" else None,
        )

    def close(self):
        pass


class CorrectionProcessor(FoldProcessor):
    """What an entry's change does to the counts of its batch: the difference to what it was counted as before.

    Differences may be added up in any order, so counts need no entry again. An event that changes nothing gives no row.
    """

    def init(self, handle):
        super().init(handle)
        self.counted = handle.getValueState("counted", ", ".join(f"{c} bigint" for c in COUNTS), self.kept_ms)

    def handleInputRows(self, key, rows, timer_values):
        now = (0,) * len(COUNTS)
        for entry in super().handleInputRows(key, rows, timer_values):
            confirmed = entry.state == "confirmed"
            now = tuple(map(int, (entry.state is not None, confirmed, entry.state == "failed", confirmed and entry.undone_at is not None)))
        before = self.counted.get() or (0,) * len(COUNTS)
        change = tuple(a - b for a, b in zip(now, before))
        if any(change):
            self.counted.update(now)
            yield Row(batch_id=key[0], **dict(zip(COUNTS, change)))


def first_copies(arrivals: DataFrame, kept_ms: int | None = None) -> DataFrame:
    """Streaming files (scan_id, hash, position, filename, size_bytes, status) with copies of loaded ones marked.

    Each micro-batch gives the files whose status is new or other than said before; files that are not loaded
    pass without state. ``position`` orders the files of a scan, names decide where it is equal.
    """
    use_rocksdb(arrivals.sparkSession)
    columns = ["scan_id", "hash", "position", "filename", "size_bytes", "status"]
    rows = arrivals.select(*columns)
    types = {c: rows.schema[c].dataType.simpleString() for c in columns}
    loaded = _keyed(rows.filter(F.col("status") == LOADED).drop("status"), ["scan_id", "hash"], kept_ms)
    held = {c: t for c, t in types.items() if c != "status"}
    told = ", ".join(f"{c} {t}" for c, t in types.items())
    marked = loaded.transformWithState(FirstCopyProcessor(held, kept_ms), told, "update", "ProcessingTime" if kept_ms else "None")
    return marked.unionByName(rows.filter(F.col("status") != LOADED))


def settle_stream(samples: DataFrame, kept_ms: int | None = None) -> DataFrame:
    """Streaming samples (path, size_bytes, mtime, sample_ts) -> (path, settled) after each micro-batch."""
    use_rocksdb(samples.sparkSession)
    path = samples.schema["path"].dataType.simpleString()
    timed = samples.select("path", "size_bytes", "mtime", F.unix_micros("sample_ts").alias("at"))  # all columns reach Python
    keyed = _keyed(timed, ["path"], kept_ms)
    return keyed.transformWithState(SettleProcessor(path, kept_ms), f"path {path}, settled boolean", "update", "ProcessingTime" if kept_ms else "None")


def _keyed(rows: DataFrame, key: list[str], kept_ms: int | None) -> GroupedData:
    """Rows by their key where its state ends by time, else by one of ``BUCKETS`` buckets of keys.

    A call of a Python processor costs milliseconds, mostly for the state, whatever it holds. So keys share calls and state,
    and calls no longer grow with the keys; in return a bucket's state is written whole when one of its keys changes.
    """
    if kept_ms:
        return rows.groupBy(*key)
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS))).groupBy("_bucket")


def fold_stream(events: DataFrame, kept_ms: int | None = None) -> DataFrame:
    """Streaming posting events -> the entry as it stands after each micro-batch.

    An entry's distinct events are its state either way. Where no state ends by time they are a built-in aggregate, which
    leaves Python out; with ``kept_ms`` every key is a call of ``FoldProcessor``.
    """
    use_rocksdb(events.sparkSession)
    timed = events.withColumn("at", F.unix_micros("event_ts"))
    if kept_ms:
        folded = timed.groupBy("batch_id", "file_hash").transformWithState(FoldProcessor(kept_ms), _FOLDED, "update", "ProcessingTime")
    else:
        gathered = _packed(timed).groupBy("batch_id", "file_hash").agg(F.array_sort(F.collect_set(F.struct("seq", "kind", "at", "remote_id", "sync_token", "error"))).alias("_events"))
        folded = _entries(gathered.withColumn("file_hash", unpacked(F.col("file_hash"))))
    return folded.withColumns({c: F.timestamp_micros(c) for c in ("sent_at", "confirmed_at", "undone_at")})


def _packed(events: DataFrame) -> DataFrame:
    """Events whose document's digest is bytes: it is in every shuffled row and in every key of the state."""
    return events.withColumn("file_hash", packed(F.col("file_hash")))


def _counting_events(events: Column) -> tuple[Column, Column]:
    """Of events in order of their numbers: those of the state, and those of an undo. Nothing leaves ``confirmed``."""
    sealed = F.array_position(F.transform(events, lambda e: e["kind"] == "confirmed"), F.lit(True)).cast("int")
    until = F.when(sealed > 0, F.slice(events, F.lit(1), sealed)).otherwise(events)
    after = F.when(sealed > 0, F.slice(events, sealed + 1, F.size(events))).otherwise(F.slice(events, 1, 0))
    return F.filter(until, lambda e: e["kind"].isin(*_STATES)), F.filter(after, lambda e: e["kind"].isin(*_UNDOS))


def _last(events: Column, *kinds: str) -> Column:
    """The last event, or the last of these kinds; null where there is none."""
    of_kind = F.filter(events, lambda e: e["kind"].isin(*kinds)) if kinds else events
    return F.get(of_kind, F.size(of_kind) - 1)


def _entries(gathered: DataFrame) -> DataFrame:
    """Entries of (batch_id, file_hash, _events), as ``FoldProcessor`` tells them."""
    steps, undos = _counting_events(F.col("_events"))
    parted = gathered.select("batch_id", "file_hash", steps.alias("_steps"), undos.alias("_undos"))
    last = _last(F.col("_steps"))
    confirmed = _last(F.col("_steps"), "confirmed")
    undo = _last(F.col("_undos"))
    return parted.filter((F.size("_steps") > 0) | (F.size("_undos") > 0)).select(
        "batch_id",
        "file_hash",
        last["kind"].alias("state"),
        _last(F.col("_steps"), "sent")["at"].alias("sent_at"),
        confirmed["at"].alias("confirmed_at"),
        confirmed["remote_id"].alias("remote_id"),
        confirmed["sync_token"].alias("sync_token"),
        F.when(last["kind"] == "failed", last["error"]).alias("error"),
        _last(F.col("_undos"), "undone")["at"].alias("undone_at"),
        F.when(undo["kind"] == "undo-refused", undo["error"]).alias("undo_reason"),
    )


def _counts_of(events: Column) -> list[Column]:
    """What an entry with these events counts as, in the order of ``COUNTS``."""
    steps, undos = _counting_events(events)
    state = _last(steps)["kind"]
    confirmed = F.coalesce(state == "confirmed", F.lit(False))
    failed = F.coalesce(state == "failed", F.lit(False))
    return [c.cast("bigint") for c in (state.isNotNull(), confirmed, failed, confirmed & _last(undos, "undone")["at"].isNotNull())]


def correction_stream(events: DataFrame, kept_ms: int | None = None) -> DataFrame:
    """Streaming posting events -> (batch_id, total, confirmed, failed, undone), each a difference to add.

    Write it in append mode with ``kept_ms``, else in update mode. Without, each event is kept once, with the time of the
    micro-batch it came in: those of this micro-batch's time are new, and the entry is counted with and without them.
    """
    use_rocksdb(events.sparkSession)
    timed = events.withColumn("at", F.unix_micros("event_ts"))
    if kept_ms:
        types = "batch_id string, " + ", ".join(f"{c} bigint" for c in COUNTS)
        return timed.groupBy("batch_id", "file_hash").transformWithState(CorrectionProcessor(kept_ms), types, "append", "ProcessingTime")
    once = _packed(timed).select("batch_id", "file_hash", "seq", "kind", "at").dropDuplicates(["batch_id", "file_hash", "seq"]).withColumn("came", F.current_timestamp())
    gathered = once.groupBy("batch_id", "file_hash").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "at", "came"))).alias("_events"))
    earlier = F.filter("_events", lambda e: e["came"] != F.current_timestamp())
    counted = gathered.select("batch_id", F.array(*_counts_of(F.col("_events"))).alias("_now"), F.array(*_counts_of(earlier)).alias("_before"))
    changes = counted.select("batch_id", *[(F.col("_now")[i] - F.col("_before")[i]).alias(c) for i, c in enumerate(COUNTS)])
    return changes.filter(" OR ".join(f"{c} <> 0" for c in COUNTS))


def batch_stream(corrections: DataFrame) -> DataFrame:
    """Streaming corrections -> a batch's counts and state after each micro-batch.

    Sums by built-in aggregates: each task adds up its own corrections first, so a batch with a third of all entries is no hot key.
    """
    use_rocksdb(corrections.sparkSession)
    counted = corrections.groupBy("batch_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return counted.withColumn("state", batch_state(F.col("total"), F.col("confirmed"), F.col("undone")))
