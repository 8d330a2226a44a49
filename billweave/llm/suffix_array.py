"""Removal of byte strings that occur again, by a distributed suffix array.

Every string of ``length`` bytes has an anchor: the smallest fingerprint of 16 bytes in its
first half. Equal strings have it at the same place, so it is enough to sort the
suffixes that start at anchors (about one in a hundred). A suffix is ordered by its
leading tokens, two fingerprints of its first bytes, then by a fingerprint of all bytes any of
the anchor's strings touches. Sampled splitters deal the suffixes over ranges of that order down to
document and place, so a suffix that a third of all rows share spreads over many ranges;
a range is sorted by multikey quicksort and neighbours are compared. What stands at the edges of a
range may go on in the next and is settled by adding up the edges.

Anchors with equal surroundings are repeats as a whole. Where only the leading tokens are equal
(where a repeat begins or ends, or copies differ), the strings around the anchor are compared one by one.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.text import Rolling, byte_values, ranges, sliding_argmin, text_slices
from billweave.session import cut_lineage

LENGTH = 400
_GRAM = 16
_SLICE_BYTES = 2 << 20
#: input bytes a partition; estimates from here on are Spark's way to say that it does not know
_PARTITION_BYTES, _UNKNOWN_BYTES = 16 << 20, 1 << 45
_SUFFIX = "t1 long, t2 long, u long, doc long, key int, at long, lo int, hi int"


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray]:
    """The rolling fingerprints, and for each anchor its place and the first and last string start that has it."""
    rolling = Rolling(byte_values(data))
    none = np.empty(0, np.int64)
    half = length // 2
    last = np.repeat(offsets[1:] - length, np.diff(offsets))
    valid = np.arange(len(data)) <= last
    if not valid.any():
        return rolling, none, none, none
    anchor = sliding_argmin(rolling.fixed(_GRAM), half - _GRAM + 1)
    start = np.flatnonzero(valid[: len(anchor)])
    anchor = anchor[start]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
    stop = np.append(new[1:], len(start)) - 1
    return rolling, anchor[new], start[new], start[stop]


def suffixes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per anchor of docs (doc, key, text): tokens, surroundings, document, place, reach of its strings before it."""
    tail = length - length // 2 + _GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", _SLICE_BYTES):
            rolling, at, first, last = _anchors(part.data, part.offsets, length)
            row = np.searchsorted(part.offsets, at, "right") - 1
            t1, t2 = rolling.of(at, at + tail // 3), rolling.of(at + tail // 3, at + tail)
            u = rolling.of(first, last + length) ^ ((at - first).astype(np.uint64) << np.uint64(20)) ^ (at - last).astype(np.uint64)
            columns = [pa.array(x.view(np.int64)) for x in (t1, t2, u)]
            columns += [pa.array(part.rows.column("doc").to_numpy()[row]), pa.array(part.rows.column("key").to_numpy()[row]), pa.array(at - part.offsets[row])]
            columns += [pa.array((at - x).astype(np.int32)) for x in (last, first)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SUFFIX.split(", ")])

    return docs.mapInArrow(run, _SUFFIX)


# ---- sorted ranges

_COVERED, _SINGLE, _SHARED, _EDGE = range(4)
_FOUND = "kind int, t1 long, t2 long, u long, doc long, key int, at long, lo int, hi int, classes long"


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the first key, ties by the next, and so on: each key is only looked at where all before it tie."""
    order = np.argsort(keys[0], kind="quicksort")
    new = np.ones(len(order), bool)
    values = keys[0][order]
    new[1:] = values[1:] != values[:-1]
    for key in keys[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        place = np.flatnonzero(tied)
        if not len(place):
            break
        run = np.cumsum(new)[place]
        order[place] = order[place][np.lexsort((key[order[place]], run))]
        values = key[order]
        new[1:] |= values[1:] != values[:-1]
    return order


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: what is covered, which classes share a group with others, and the classes of the groups at its edges.

    An edge's class is one row, its first, with the number of its rows here in place of ``classes``.
    """
    names = [c.split()[0] for c in _SUFFIX.split(", ")]
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    column = {c: np.concatenate([p.column(c).to_numpy() for p in parts]) for c in names}
    parts.clear()
    order = multikey_order([column[c] for c in ("t1", "t2", "u", "doc", "at")])
    for c in names:  # one column at a time is held twice
        column[c] = column[c][order]
    n = len(order)
    new_group = np.ones(n, bool)
    new_group[1:] = (column["t1"][1:] != column["t1"][:-1]) | (column["t2"][1:] != column["t2"][:-1])
    new_class = new_group.copy()
    new_class[1:] |= column["u"][1:] != column["u"][:-1]
    group, class_ = np.cumsum(new_group) - 1, np.cumsum(new_class) - 1
    size, classes = np.bincount(class_)[class_], np.bincount(group[new_class])[group]
    edge = (group == 0) | (group == group[-1])
    chosen = [
        (_EDGE, edge & new_class),
        (_COVERED, size > 1),
        (_SINGLE, ~edge & (size == 1) & (classes > 1)),
        (_SHARED, ~edge & (size > 1) & (classes > 1) & new_class),
    ]
    for kind, rows in chosen:
        rows = np.flatnonzero(rows)
        bare = kind == _COVERED  # only the place matters
        columns = [np.full(len(rows), kind, np.int32)] + [np.zeros(len(rows), np.int64) if bare and c in ("t1", "t2", "u") else column[c][rows] for c in names]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, (size if kind == _EDGE else classes)[rows]]], names=[c.split()[0] for c in _FOUND.split(", ")])


def _settled(edges: DataFrame) -> DataFrame:
    """Classes at the edges of ranges, added up over all ranges; of a class with several rows in a range these are covered already."""
    by_class = edges.groupBy("t1", "t2", "u").agg(F.sum("classes").alias("_n"), F.min(F.struct("doc", "key", "at")).alias("_first"))
    by_group = by_class.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("_classes"))
    known = by_class.join(by_group, ["t1", "t2"])
    rows = edges.withColumnRenamed("classes", "_here").join(known, ["t1", "t2", "u"]).withColumn("classes", F.col("_classes"))
    first = F.struct("doc", "key", "at") == F.col("_first")
    kinds = F.array(
        F.when((F.col("_n") > 1) & (F.col("_here") == 1), _COVERED).when((F.col("_n") == 1) & (F.col("classes") > 1), _SINGLE),
        F.when((F.col("_n") > 1) & (F.col("classes") > 1) & first, _SHARED),
    )
    return rows.withColumn("kind", F.explode(kinds)).where("kind is not null").select(*[c.split()[0] for c in _FOUND.split(", ")])


# ---- strings around anchors whose groups hold different surroundings

_AROUND = "t1 long, t2 long, doc long, key int, at long, lo int, hi int, single boolean, around binary"
_STRINGS = "f long, doc long, key int, start long, single boolean"
_SPANS = "doc long, key int, start long, stop long"
BIG_GROUP = 20_000
_MOST_STRINGS = 1 << 20


def _surroundings(docs: DataFrame, listed: DataFrame, length: int) -> DataFrame:
    """For documents with listed anchors the bytes their strings touch."""
    joined = docs.select("doc", "key", "text").join(listed.hint("shuffle_hash"), ["doc", "key"])

    names = [c.split()[0] for c in _AROUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", _SLICE_BYTES):
            lists = part.rows.column("listed")
            n, own = np.diff(lists.offsets.to_numpy()), lists.flatten()
            row = np.repeat(np.arange(len(n)), n)
            t1, t2, at, lo, hi, single = [own.field(c) for c in ("t1", "t2", "at", "lo", "hi", "single")]
            doc, key = [part.rows.column(c).take(pa.array(row)) for c in ("doc", "key")]
            start = part.offsets[row] + at.to_numpy() - hi.to_numpy()
            stop = part.offsets[row] + at.to_numpy() - lo.to_numpy() + length
            for a in range(0, len(row), 2_000):
                b = min(a + 2_000, len(row))
                offsets = np.concatenate(([0], np.cumsum(stop[a:b] - start[a:b]))).astype(np.int32)
                data = np.ascontiguousarray(part.data[ranges(start[a:b], stop[a:b])])
                around = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in (t1, t2, doc, key, at, lo, hi, single)], around], names=names)

    return joined.mapInArrow(run, _AROUND)


def _string_prints(batch: pa.RecordBatch, length: int):
    """For every string around every anchor of a batch: its fingerprint within its group, its anchor's row, its start."""
    around = batch.column("around")
    offsets = np.frombuffer(around.buffers()[1], np.int32)[around.offset : around.offset + len(around) + 1].astype(np.int64)
    data = np.frombuffer(around.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    rolling = Rolling(byte_values(data, seed=2))
    stops = offsets[1:] - length + 1
    place = ranges(offsets[:-1], stops)
    row = np.repeat(np.arange(len(around)), stops - offsets[:-1])
    inside = place - offsets[:-1][row]
    start = batch.column("at").to_numpy()[row] - batch.column("hi").to_numpy()[row] + inside
    group = batch.column("t1").to_numpy().view(np.uint64) ^ (batch.column("t2").to_numpy().view(np.uint64) >> np.uint64(7))
    f = rolling.of(place, place + length) ^ (group[row] * np.uint64(0x9E3779B97F4A7C15))
    return f, row, start


def _equal_strings(around: DataFrame, length: int) -> DataFrame:
    """Spans of single anchors' strings that another anchor of their group has; whole groups lie in one partition, one behind the other."""
    return around.repartition("t1", "t2").sortWithinPartitions("t1", "t2").mapInArrow(lambda batches: _matched(batches, length), _SPANS)


def _matched(batches: Iterator[pa.RecordBatch], length: int, most: int = _MOST_STRINGS) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, compared as soon as they have ``most`` strings: a task holds so many, or those of its largest group."""
    held, strings, limit = [], 0, most
    for batch in batches:
        for at in range(0, batch.num_rows, 4000):
            part = batch.slice(at, 4000)
            held.append(part)
            strings += _count_strings(part)
            if strings >= limit:
                t1, t2 = [np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("t1", "t2")]
                new = np.flatnonzero((t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])) + 1
                last = int(new[-1]) if len(new) else 0
                whole, rest = _split(held, last)
                if last:
                    yield _matched_groups(whole, length)
                held, strings = rest, sum(map(_count_strings, rest))
                limit = max(most, 2 * strings)
    if held:
        yield _matched_groups(held, length)


def _count_strings(part: pa.RecordBatch) -> int:
    return int((part.column("hi").to_numpy().astype(np.int64) - part.column("lo").to_numpy() + 1).sum())


def _split(parts: list[pa.RecordBatch], at: int) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
    """The first ``at`` rows, and the others."""
    before, after = [], []
    for part in parts:
        n = min(max(at, 0), part.num_rows)
        before += [part.slice(0, n)] if n else []
        after += [part.slice(n)] if n < part.num_rows else []
        at -= part.num_rows
    return before, after


def _matched_groups(parts: list[pa.RecordBatch], length: int) -> pa.RecordBatch:
    prints, per_row = [], []
    for part in parts:
        f, row, _ = _string_prints(part, length)
        prints.append(f)
        per_row.append(np.bincount(row, minlength=part.num_rows))
    f, n = np.concatenate(prints), np.concatenate(per_row)
    prints.clear()
    doc, key, at, hi = [np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("doc", "key", "at", "hi")]
    single = np.concatenate([p.column("single").to_numpy(zero_copy_only=False) for p in parts]).astype(bool)
    order = np.argsort(f)
    f = f[order]
    same = f[1:] == f[:-1]
    hit = np.zeros(len(order), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    hit = np.flatnonzero(hit & np.repeat(single, n))
    stops = np.cumsum(n)
    ref = np.searchsorted(stops, hit, "right")
    start = at[ref] - hi[ref] + hit - (stops - n)[ref]
    new = np.flatnonzero(np.concatenate(([True], (ref[1:] != ref[:-1]) | (start[1:] != start[:-1] + 1)))) if len(hit) else hit
    last = np.append(new[1:], len(hit)) - 1 if len(hit) else hit
    columns = [doc[ref[new]], key[ref[new]], start[new], start[last] + length]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _SPANS.split(", ")])


def _equal_strings_of_big_groups(around: DataFrame, length: int) -> DataFrame:
    """The same, string by string, for groups too large for a task: counts are added up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                f, row, start = _string_prints(part, length)
                columns = [pa.array(f.view(np.int64)), pa.array(part.column("doc").to_numpy()[row]), pa.array(part.column("key").to_numpy()[row]), pa.array(start), pa.array(part.column("single").to_numpy(zero_copy_only=False)[row])]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _STRINGS.split(", ")])

    strings = around.mapInArrow(run, _STRINGS)
    often = strings.groupBy("f").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("f")
    return strings.where("single").join(often, "f", "left_semi").select("doc", "key", "start", (F.col("start") + length).alias("stop"))


# ---- removal


def _partitions(docs: DataFrame) -> int:
    """As many as the session's, and more where the input would make them larger than a task should hold.

    A range of suffixes, and the lists of a partition's documents, are in memory as a whole.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < _UNKNOWN_BYTES else 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // _PARTITION_BYTES))


def repeated_spans(docs: DataFrame, length: int, big_group: int) -> tuple[DataFrame, DataFrame]:
    """Byte spans of strings that start more than once, of docs (doc, key, text), and docs dealt by document.

    Both ends of a plan that joins them use the one exchange of the texts; what joins them is dealt in as many partitions, once.
    """
    partitions = _partitions(docs)
    dealt = docs.repartition(partitions, "doc", "key")
    placed = suffixes(docs, length).repartitionByRange(partitions, "t1", "t2", "u", "doc", "at")
    found = cut_lineage(placed.mapInArrow(_compared, _FOUND))
    found = found.where(F.col("kind") != _EDGE).unionByName(cut_lineage(_settled(found.where(F.col("kind") == _EDGE))))
    covered = found.where(F.col("kind") == _COVERED).select("doc", "key", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + length).alias("stop"))
    spans = covered
    for big, compare in ((False, _equal_strings), (True, _equal_strings_of_big_groups)):
        own = found.where(F.col("kind").isin(_SINGLE, _SHARED) & ((F.col("classes") > big_group) == big))
        listed = own.repartition(partitions, "doc", "key").groupBy("doc", "key").agg(F.collect_list(F.struct("t1", "t2", "at", "lo", "hi", (F.col("kind") == _SINGLE).alias("single"))).alias("listed"))
        spans = spans.unionByName(compare(_surroundings(dealt, listed, length), length))
    return spans, dealt


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc (null becomes the largest long), key to tell rows of one id apart by their text, text, and the whole row."""
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("doc"),
        F.pmod(F.xxhash64(F.col(text)), F.lit((1 << 31) - 1)).cast("int").alias("key"),
        F.col(text).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"),
    )


def _cut(docs: DataFrame, *, doc_id: str, text: str, length: int, big_group: int, digest: bool) -> DataFrame:
    keyed = _keyed(docs, doc_id, text)
    spans, dealt = repeated_spans(keyed, length, big_group)
    listed = spans.repartition(_partitions(keyed), "doc", "key").groupBy("doc", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = dealt.join(listed.hint("shuffle_hash"), ["doc", "key"], "left")
    kind = keyed.schema["row"].dataType.simpleString()
    added = "kept_sha256 string" if digest else "kept string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            texts, spans_ = batch.column("text"), batch.column("spans")
            out: list[tuple] = []
            for i in range(batch.num_rows):
                buffer = texts[i].as_buffer()
                data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
                own = spans_[i]
                removed, pieces, kept = 0, 0, data
                if own.is_valid:
                    start, stop = [own.values.field(c).to_numpy() for c in ("start", "stop")]
                    order = np.argsort(start)
                    start, stop = start[order], np.maximum.accumulate(stop[order])
                    new = np.flatnonzero(np.concatenate(([True], start[1:] > stop[:-1])))
                    first, last = start[new], stop[np.append(new[1:], len(start)) - 1]
                    removed, pieces = int((last - first).sum()), len(new)
                    kept = np.concatenate([data[a:b] for a, b in zip(np.append(0, last), np.append(first, len(data)))])
                raw = kept.tobytes()
                final = hashlib.sha256(raw).hexdigest() if digest else (raw.decode(errors="ignore") if buffer is not None else None)
                out.append((len(data), removed, pieces, final))
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["row", "n_bytes", "n_removed", "n_spans", added.split()[0]])

    return joined.select("row", "text", "spans").mapInArrow(run, f"row {kind}, n_bytes long, n_removed long, n_spans long, {added}")


def removal_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, big_group: int = BIG_GROUP) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is an empty one; texts below ``length`` lose nothing. Rows are told apart by id
    and text, so a repeated row is a copy like any other: both go. Null ids are one more id.
    Strings never reach over the end of a text. ``length`` must be 64 or more.
    """
    out = _cut(docs.select(doc_id, text), doc_id=doc_id, text=text, length=length, big_group=big_group, digest=True)
    return out.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, big_group: int = BIG_GROUP) -> DataFrame:
    """The documents with repeated strings taken out of their texts; all other columns as they were.

    A character of which a cut takes some bytes goes as a whole. A null text stays null.
    """
    out = _cut(docs, doc_id=doc_id, text=text, length=length, big_group=big_group, digest=False)
    return out.select(*[(F.col("kept") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
