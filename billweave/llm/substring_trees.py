"""Removal of word windows that stand in an earlier document, by prefix-partitioned suffix trees.

Every window of ``window`` words has an anchor: the smallest fingerprint of four words in it.
Equal windows have it at the same place, so the trees need only the suffixes that start at
anchors (about one word in five). A suffix goes to the group of its prefix, four words; a
prefix that would fill a task (found by a hash sample of the documents) is made
longer, up to the whole surroundings of the anchor and the document. Each group
is one subtree: suffixes sorted by prefix, then by all words the anchor's windows touch.
Internal nodes at the depth of whole surroundings are repeats of a window's length or
more: what hangs below them from later documents than the first is covered. Below a
shallower internal node the windows are compared one by one, for the first documents only.
Nodes of prefixes that were made longer are put together again by sums over the groups.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.text import NOT_SPACE, Rolling, ranges, sliding_argmin, text_slices, word_hashes, word_spans
from billweave.session import cut_lineage

WINDOW = 13
PREFIX = 4
SAMPLE_ONE_IN = 64
BIG_GROUP = 200_000

_SUFFIX = "prefix long, around long, doc long, key int, at int, lo int, hi int"
_NODES = "kind int, prefix long, around long, doc long, key int, at int, lo int, hi int"
_COVERED, _OPEN, _LONG = range(3)


def _anchors(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray]:
    """Rolling fingerprints over words; for each anchor its place and the first and last window start that has it."""
    rolling = Rolling(hashes)
    valid = np.arange(len(hashes)) <= np.repeat(first[1:] - window, np.diff(first))
    none = np.empty(0, np.int64)
    if not valid.any():
        return rolling, none, none, none
    anchor = sliding_argmin(rolling.fixed(PREFIX), window - PREFIX + 1)
    start = np.flatnonzero(valid[: len(anchor)])
    anchor = anchor[start]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
    return rolling, anchor[new], start[new], start[np.append(new[1:], len(start)) - 1]


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    return word_hashes(data, starts, ends), first


def suffixes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per anchor of docs (doc, key, text); ``at``: its word, ``lo`` and ``hi``: how far before it its windows start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            hashes, words_at = _hashed(part.data, part.offsets)
            rolling, at, first, last = _anchors(hashes, words_at, window)
            row = np.searchsorted(words_at, at, "right") - 1
            lo, hi = at - last, at - first
            around = rolling.of(first, last + window) ^ (lo << 8 | hi).astype(np.uint64)
            columns = [rolling.of(at, at + PREFIX).view(np.int64), around.view(np.int64), part.rows.column("doc").to_numpy()[row], part.rows.column("key").to_numpy()[row]]
            columns += [x.astype(np.int32) for x in (at - words_at[row], lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _SUFFIX.split(", ")])

    return docs.mapInArrow(run, _SUFFIX)


def frequent_prefixes(docs: DataFrame, window: int, partitions: int, sample_one_in: int = SAMPLE_ONE_IN) -> list[int]:
    """Prefixes with so many suffixes that one would take a quarter of a task's mean share.

    Counted in a hash sample; at most four a task can be that frequent. A prefix that the
    sample misses stays short, which costs memory and changes no result.
    """
    sample = docs.where(F.pmod(F.xxhash64(F.lit("prefix"), "doc"), F.lit(sample_one_in)) == 0)
    counts = suffixes(sample, window).groupBy("prefix").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    return [r["prefix"] for r in counts.where(F.col("count") > max(200, total / (4 * partitions))).collect()]


def _subtrees(long_prefixes: np.ndarray):
    """All subtrees of one task, as runs of its sorted suffixes.

    Of a prefix that was made longer the task has a part; what is later than the earliest
    document of a node here is covered whatever the other parts hold, and only the rest goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SUFFIX.split(", ")]
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        column = {c: np.concatenate([p.column(c).to_numpy() for p in parts]) for c in names}
        order = np.lexsort((column["doc"], column["around"], column["prefix"]))
        column = {c: x[order] for c, x in column.items()}
        branch = np.ones(len(order), bool)
        branch[1:] = column["prefix"][1:] != column["prefix"][:-1]
        node = branch.copy()
        node[1:] |= column["around"][1:] != column["around"][:-1]
        number = np.cumsum(node) - 1
        earliest = column["doc"][node][number]
        several = np.bincount((np.cumsum(branch) - 1)[node])[np.cumsum(branch) - 1] > 1
        longer = np.isin(column["prefix"], long_prefixes)
        for kind, rows in ((_LONG, longer & (column["doc"] == earliest)), (_COVERED, column["doc"] > earliest), (_OPEN, ~longer & several & (column["doc"] == earliest))):
            rows = np.flatnonzero(rows)
            columns = [np.full(len(rows), kind, np.int32)] + [np.zeros(len(rows), np.int64) if kind == _COVERED and c in ("prefix", "around") else column[c][rows] for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _NODES.split(", ")])

    return run


def _joined_nodes(longer: DataFrame) -> DataFrame:
    """Nodes of long prefixes over all groups: earliest documents are found in the tasks before anything is shuffled."""
    nodes = longer.groupBy("prefix", "around").agg(F.min("doc").alias("_earliest"))
    several = nodes.groupBy("prefix").agg((F.count(F.lit(1)) > 1).alias("_several"))
    known = longer.join(nodes.join(several, "prefix"), ["prefix", "around"])
    later = F.col("doc") > F.col("_earliest")
    kind = F.when(later, _COVERED).when(F.col("_several"), _OPEN)
    return known.withColumn("kind", kind).where("kind is not null").select(*[c.split()[0] for c in _NODES.split(", ")])


# ---- windows below shallow nodes

_WINDOWS = "prefix long, doc long, key int, first int, prints binary"
_SPANS = "doc long, key int, start int, stop int"


def _open_windows(docs: DataFrame, listed: DataFrame, window: int) -> DataFrame:
    """Fingerprints of all windows of the listed anchors."""
    joined = docs.select("doc", "key", "text").join(listed.hint("shuffle_hash"), ["doc", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            hashes, words_at = _hashed(part.data, part.offsets)
            prints = Rolling(hashes ^ np.uint64(0x2545F4914F6CDD1D)).fixed(window) if len(hashes) >= window else np.empty(0, np.uint64)
            lists = part.rows.column("listed")
            own, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            prefix, at, lo, hi = [own.field(c).to_numpy() for c in ("prefix", "at", "lo", "hi")]
            first = words_at[row] + at - hi
            raw = [prints[a:b].tobytes() for a, b in zip(first.tolist(), (first + hi - lo + 1).tolist())]
            columns = [pa.array(prefix), pa.array(part.rows.column("doc").to_numpy()[row]), pa.array(part.rows.column("key").to_numpy()[row]), pa.array((at - hi).astype(np.int32)), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _WINDOWS.split(", ")])

    return joined.mapInArrow(run, _WINDOWS)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window in a batch: fingerprint within its prefix, row, start."""
    prints = batch.column("prints")
    offsets = np.frombuffer(prints.buffers()[1], np.int32)[prints.offset : prints.offset + len(prints) + 1].astype(np.int64)
    values = np.frombuffer(prints.buffers()[2][offsets[0] : offsets[-1]], np.uint64)
    n = np.diff(offsets) // 8
    row = np.repeat(np.arange(len(prints)), n)
    inside = np.arange(len(values)) - np.repeat((offsets[:-1] - offsets[0]) // 8, n)
    prefix = batch.column("prefix").to_numpy().view(np.uint64)
    return values ^ (prefix[row] * np.uint64(0x9E3779B97F4A7C15)), row, batch.column("first").to_numpy()[row] + inside


def _later_windows(windows: DataFrame, window: int) -> DataFrame:
    """Spans of windows that an earlier document has; a prefix's windows lie in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        unpacked = [_unpacked(b) for b in parts]
        shift = np.concatenate(([0], np.cumsum([b.num_rows for b in parts])))
        f, start = np.concatenate([u[0] for u in unpacked]), np.concatenate([u[2] for u in unpacked])
        ref = np.concatenate([u[1] + s for u, s in zip(unpacked, shift)])
        doc, key = [np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("doc", "key")]
        order = np.lexsort((doc[ref], f))
        new = np.ones(len(order), bool)
        new[1:] = f[order][1:] != f[order][:-1]
        earliest = np.empty(len(order), np.int64)
        earliest[order] = doc[ref[order]][new][np.cumsum(new) - 1]
        hit = np.flatnonzero(doc[ref] > earliest)
        if not len(hit):
            return
        ref, start = ref[hit], start[hit]
        new = np.flatnonzero(np.concatenate(([True], (ref[1:] != ref[:-1]) | (start[1:] != start[:-1] + 1))))
        last = np.append(new[1:], len(hit)) - 1
        columns = [doc[ref[new]], key[ref[new]], start[new].astype(np.int32), (start[last] + window).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _SPANS.split(", ")])

    return windows.repartition("prefix").mapInArrow(run, _SPANS)


def _later_windows_one_by_one(windows: DataFrame, window: int) -> DataFrame:
    """The same for prefixes with too many windows for a task: the earliest document of each comes from a map-side combined minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                f, row, start = _unpacked(batch)
                columns = [f.view(np.int64), batch.column("doc").to_numpy()[row], batch.column("key").to_numpy()[row], start.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["f", "doc", "key", "start"])

    every = windows.mapInArrow(run, "f long, doc long, key int, start int")
    earliest = every.groupBy("f").agg(F.min("doc").alias("_earliest"), F.max("doc").alias("_latest")).where("_earliest < _latest")
    return every.join(earliest, "f").where("doc > _earliest").select("doc", "key", "start", (F.col("start") + window).alias("stop"))


# ---- removal


def later_spans(docs: DataFrame, window: int, big_group: int, sample_one_in: int) -> tuple[DataFrame, DataFrame]:
    """Word spans of windows that an earlier document has, of docs (doc, key, text), and docs dealt by document.

    Both joins of a plan with the texts use their one exchange.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartition(partitions, "doc", "key")
    longer = frequent_prefixes(docs, window, partitions, sample_one_in)
    group = F.when(F.col("prefix").isin(longer), F.xxhash64("prefix", "around", "doc")).otherwise(F.col("prefix")) if longer else F.col("prefix")
    placed = suffixes(docs, window).repartition(partitions, group)
    nodes = cut_lineage(placed.mapInArrow(_subtrees(np.array(longer, np.int64)), _NODES))
    if longer:
        nodes = nodes.where(F.col("kind") != _LONG).unionByName(cut_lineage(_joined_nodes(nodes.where(F.col("kind") == _LONG))))
    spans = nodes.where(F.col("kind") == _COVERED).select("doc", "key", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + window).alias("stop"))
    open_ = nodes.where(F.col("kind") == _OPEN)
    big = [r["prefix"] for r in open_.groupBy("prefix").count().where(F.col("count") > big_group).limit(10_000).collect()]
    for chosen, compare in ((~F.col("prefix").isin(big), _later_windows), (F.col("prefix").isin(big), _later_windows_one_by_one)) if big else ((F.lit(True), _later_windows),):
        listed = open_.where(chosen).groupBy("doc", "key").agg(F.collect_list(F.struct("prefix", "at", "lo", "hi")).alias("listed"))
        spans = spans.unionByName(compare(_open_windows(dealt, listed, window), window))
    return spans, dealt


def _kept(part, window_spans) -> Iterator[tuple[int, int, bytes]]:
    """For each row of a slice: number of words, of removed ones, and the kept words joined by one space."""
    starts, ends, at = word_spans(part.data, part.offsets, NOT_SPACE)
    gone = np.zeros(len(starts) + 1, np.int64)
    n = np.diff(window_spans.offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), n)
    own = window_spans.flatten()
    np.add.at(gone, at[row] + own.field("start").to_numpy(), 1)
    np.add.at(gone, at[row] + own.field("stop").to_numpy(), -1)
    keep = np.cumsum(gone[:-1]) == 0
    kept_at = np.concatenate(([0], np.cumsum(keep)))[at]
    starts, ends = starts[keep], ends[keep]
    size = ends - starts + 1
    place = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(place[-1]), 32, np.uint8)
    out[ranges(place[:-1], place[1:] - 1)] = part.data[ranges(starts, ends)]
    for i in range(len(at) - 1):
        a, b = place[kept_at[i]], place[kept_at[i + 1]]
        yield int(at[i + 1] - at[i]), int(at[i + 1] - at[i] - (kept_at[i + 1] - kept_at[i])), out[a : max(a, b - 1)].tobytes()


def _cut(docs: DataFrame, *, doc_id: str, text: str, window: int, big_group: int, sample_one_in: int, digest: bool) -> DataFrame:
    keyed = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.pmod(F.xxhash64(F.col(text)), F.lit((1 << 31) - 1)).cast("int").alias("key"),
        F.col(text).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"),
    )
    spans, dealt = later_spans(keyed, window, big_group, sample_one_in)
    listed = spans.distinct().groupBy("doc", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    nothing = F.array().cast("array<struct<start:int,stop:int>>")
    joined = dealt.join(listed.hint("shuffle_hash"), ["doc", "key"], "left").select("row", "text", F.coalesce("spans", nothing).alias("spans"))
    kind = keyed.schema["row"].dataType.simpleString()
    added = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            out = [(n, m, hashlib.sha256(raw).hexdigest() if digest else None if null else raw.decode()) for (n, m, raw), null in zip(_kept(part, part.rows.column("spans")), part.null)]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([part.rows.column("row"), *columns], names=["row", "n_words", "n_removed", added])

    return joined.mapInArrow(run, f"row {kind}, n_words long, n_removed long, {added} string")


def removal_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, big_group: int = BIG_GROUP, sample_one_in: int = SAMPLE_ONE_IN) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, kept_sha256.

    A null text has no words. Rows with one id are one document's: none of them comes before
    another. A null id comes after all others. Windows never reach over the end of a text, and
    texts of fewer words than a window lose nothing.
    """
    out = _cut(docs.select(doc_id, text), doc_id=doc_id, text=text, window=window, big_group=big_group, sample_one_in=sample_one_in, digest=True)
    return out.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def without_later_windows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, big_group: int = BIG_GROUP, sample_one_in: int = SAMPLE_ONE_IN) -> DataFrame:
    """The documents with their texts reduced to the kept words, one space between; other columns as they were."""
    out = _cut(docs, doc_id=doc_id, text=text, window=window, big_group=big_group, sample_one_in=sample_one_in, digest=False)
    return out.select(*[(F.col("kept") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
