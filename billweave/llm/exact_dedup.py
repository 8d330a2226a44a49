"""Exact duplicates against a history: minimal perfect hashes over the digests that are known.

The history's distinct digests are dealt into buckets by their leading bytes. A bucket is one row of the index: a minimal perfect
hash and one slot per digest, which holds the whole digest, the locator of the row that stays (its id and
row number) and the size of its group. Incoming rows are added up per digest before they travel; each digest
looks into its bucket's slot and is known only if all its bytes stand there, as a perfect hash gives any stranger some
slot, too. Known digests are repeats of the history, strangers are groups of their own.

The hash: on each level every remaining digest draws a bit of a field twice as long as their number; a bit drawn once is its
digest's own, the others go on to the next level. A slot is the number of bits set before. About four bits a digest,
built and read by numpy on whole buckets.

Buckets hold about ``DIGESTS_A_BUCKET`` digests whatever the data: digests are distinct when they are dealt. Only digests travel, never
texts. Groups with more than one row in ``HOT`` of all are at most ``HOT`` and are joined to their rows by a broadcast.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.llm.text import mix
from billweave.session import cut_lineage

DIGESTS_A_BUCKET = 1 << 15
HOT = 256
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass
class PerfectHash:
    """A number below n for each of n distinct digests; any other digest gets one of them or -1."""

    sizes: list[int]
    bits: np.ndarray
    before: np.ndarray

    @classmethod
    def over(cls, words: np.ndarray) -> "PerfectHash":
        if len(np.unique(words, axis=0)) < len(words):
            raise ValueError("digests must be distinct")
        sizes, fields = [], []
        while len(words):
            size = 2 * len(words)
            at = _draw(words, len(sizes), size)
            count = np.bincount(at, minlength=size)
            sizes.append(size)
            fields.append(count == 1)
            words = words[count[at] > 1]
        return cls.of(sizes, np.concatenate(fields) if fields else np.zeros(0, bool))

    @classmethod
    def of(cls, sizes: list[int], bits: np.ndarray) -> "PerfectHash":
        return cls(sizes, bits, np.cumsum(bits) - bits)

    def slots(self, words: np.ndarray) -> np.ndarray:
        slot = np.full(len(words), -1, np.int64)
        open_, start = np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            at = start + _draw(words[open_], level, size)
            hit = self.bits[at]
            slot[open_[hit]] = self.before[at[hit]]
            open_, start = open_[~hit], start + size
        return slot


def _draw(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each digest falls on a level: all 32 bytes count."""
    mixed = np.full(len(words), (level + 1) * 0xA0761D6478BD642F % (1 << 64), np.uint64)
    for k in range(words.shape[1]):
        mixed = mix(mixed * _SPREAD[k] + words[:, k])
    return (mixed % np.uint64(size)).astype(np.int64)


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 4)


# ---- digests and their groups

_GROUP = "digest binary, keep_id long, keep_row long, size long"


def digest_rows(docs: DataFrame, historical: Column, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table of (doc_id, row, digest, historical): what everything else works on."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), digest.alias("digest"), F.coalesce(historical, F.lit(False)).alias("historical"))
    return cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest id, a row that has it (any row where no id is), and the number of rows."""
    row = F.coalesce(F.max_by("row", "doc_id"), F.min("row"))
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), row.alias("keep_row"), F.count(F.lit(1)).alias("size"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(buckets)).alias("bucket")


# ---- the index

INDEX = "bucket long, sizes array<long>, bits binary, digests binary, keep_id array<long>, keep_row array<long>, size array<long>"


def _build(bucket: pa.Table) -> pa.Table:
    words = _words(bucket["digest"])
    table = PerfectHash.over(words)
    order = np.argsort(table.slots(words))
    slots = bucket.take(pa.array(order))
    row = {
        "bucket": bucket["bucket"][0].as_py(),
        "sizes": table.sizes,
        "bits": np.packbits(table.bits).tobytes(),
        "digests": b"".join(slots["digest"].to_pylist()),
        **{name: slots[name].to_pylist() for name in ("keep_id", "keep_row", "size")},
    }
    return pa.Table.from_pylist([row], schema=_INDEX_ARROW)


_INDEX_ARROW = pa.schema(
    [
        ("bucket", pa.int64()),
        ("sizes", pa.list_(pa.int64())),
        ("bits", pa.binary()),
        ("digests", pa.binary()),
        *[(name, pa.list_(pa.int64())) for name in ("keep_id", "keep_row", "size")],
    ]
)


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket that has digests, out of groups with distinct digests."""
    dealt = groups.select(_bucket(buckets), "digest", "keep_id", "keep_row", "size")
    return dealt.groupBy("bucket").applyInArrow(_build, INDEX)


_FOUND = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("size", pa.int64()), ("known", pa.bool_())])


def _look_up(groups: pa.Table, index: pa.Table) -> pa.Table:
    """Groups of one bucket with the slots of the bucket: known ones joined with theirs, strangers, and slots nobody asked for."""
    if not index.num_rows:
        return groups.select(_FOUND.names[:4]).append_column("known", pa.array(np.zeros(groups.num_rows, bool))).cast(_FOUND)
    entry = index.slice(0, 1)
    stored = entry["digests"][0].as_py()
    sizes = entry["sizes"][0].as_py()
    held = {name: entry[name].combine_chunks().flatten() for name in ("keep_id", "keep_row", "size")}
    count = len(stored) // 32
    words = _words(groups["digest"]) if groups.num_rows else np.empty((0, 4), np.uint64)
    table = PerfectHash.of(sizes, np.unpackbits(np.frombuffer(entry["bits"][0].as_py(), np.uint8), count=sum(sizes)).astype(bool))
    slot = table.slots(words)
    slot_words = np.frombuffer(stored, ">u8").astype(np.uint64).reshape(-1, 4)
    known = (slot >= 0) & (slot_words[slot] == words).all(axis=1)

    asked = np.full(count, -1, np.int64)
    asked[slot[known]] = np.flatnonzero(known)
    theirs = pa.array(np.maximum(asked, 0), mask=asked < 0)
    new = {name: groups[name].combine_chunks().take(theirs) for name in held}
    # an id beats none, the larger one the smaller
    pick = pc.and_(pc.is_valid(new["keep_id"]), pc.fill_null(pc.greater(new["keep_id"], held["keep_id"]), True))
    total = held["size"].to_numpy(zero_copy_only=False) + new["size"].fill_null(0).to_numpy(zero_copy_only=False)
    raw = np.frombuffer(stored, np.uint8)
    slots = pa.table(
        [
            pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), count, [None, pa.py_buffer(raw)]).cast(pa.binary()),
            pc.if_else(pick, new["keep_id"], held["keep_id"]),
            pc.if_else(pick, new["keep_row"], held["keep_row"]),
            pa.array(total),
            pa.array(np.ones(count, bool)),
        ],
        schema=_FOUND,
    )
    strangers = groups.filter(pa.array(~known)).select(_FOUND.names[:4])
    strangers = strangers.append_column("known", pa.array(np.zeros(strangers.num_rows, bool))).cast(_FOUND)
    return pa.concat_tables([slots, strangers])


def look_up(groups: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """All groups of history and incoming rows together: digest, keep_id, keep_row, size, known (the history has it)."""
    dealt = groups.select(_bucket(buckets), "digest", "keep_id", "keep_row", "size")
    return dealt.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_look_up, f"{_GROUP}, known boolean")


# ---- documents


def by_hash(key: str = "doc_id") -> Column:
    """Every second id, by checksum: which rows of one table count as its history. Rows without id are incoming."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0


def exact_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", historical: Column | None = None, digests_a_bucket: int = DIGESTS_A_BUCKET) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, historical, known.

    Texts are equal if all their bytes are; null counts as empty. Of equal texts the row with the largest id stays, one row only where several
    have it; rows without id stay only among themselves. ``historical`` says which rows are the history (``by_hash``); which do
    changes how a group is found, not the result. ``known``: the text is in the history. Ids are integers or null. An empty
    table gives an empty one; other columns play no part.
    """
    rows = digest_rows(docs, by_hash(key) if historical is None else historical, key=key, text=text)
    total = rows.count()
    buckets = max(1, -(-total // digests_a_bucket))
    index = cut_lineage(build_index(groups_of(rows.where("historical")), buckets))
    groups = cut_lineage(look_up(groups_of(rows.where("NOT historical")), index, buckets))

    repeated = groups.where(F.col("size") > 1).select(F.col("digest"), "keep_id", "keep_row", F.col("size").alias("group_size"), "known")
    is_hot = F.col("group_size") * HOT > total
    hot = F.broadcast(repeated.where(is_hot))  # fewer than HOT rows, as sizes add up to at most the total
    common = rows.join(hot, "digest")
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(repeated.where(~is_hot), "digest", "left")
    alone = F.col("group_size").isNull()
    return common.unionByName(rest).select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "historical",
        F.coalesce("known", "historical").alias("known"),
    )
