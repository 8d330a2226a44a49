"""Folder listings as a Spark data source, for batches and streams.

Spark's own file sources hide names that start with a dot or an underscore and follow links; the
intake rules need both, and they need to know more of a file than its bytes. One row is one entry of
a folder, without its subfolders' entries. Bytes are read last and only where the rules want them:
never of placeholders, links, files that are not on disk or still being written, or of types nobody reads.

The folder has to be mounted on every executor. Each task lists the names and looks closer at its own
share of them, so no listing passes through the driver and a folder of any size is dealt over tasks.
"""

import hashlib
import os
import stat
import sys
import time
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from billweave import fixed

SCHEMA = (
    "scan_id string, position string, filename string, is_file boolean, is_symlink boolean, size_bytes bigint, mtime timestamp, "
    "blocks bigint, attributes bigint, platform string, settled boolean, hash string"
)

#: entries sampled together before their second look, and rows of one Arrow batch
ENTRIES_A_LOOK = 1_000
_PIECE = 1 << 20


class Share(InputPartition):
    """One of ``value`` equal shares of the names; with a span of change times (from, to] in nanoseconds for streams."""

    def __init__(self, share: int, shares: int, changed: tuple[int, int] | None = None):
        super().__init__(shares)
        self.share, self.changed = share, changed


def _entries(path: str, subfolders: bool) -> Iterator[tuple[str, str, str]]:
    """(scan, folder, name) of a folder, or of each of its direct subfolders."""
    if not subfolders:
        with os.scandir(path) as found:
            yield from ((path, path, e.name) for e in found)
        return
    with os.scandir(path) as found:
        folders = [e.name for e in found if e.is_dir(follow_symlinks=False)]
    for folder in folders:
        inside = os.path.join(path, folder)
        with os.scandir(inside) as found:
            yield from ((folder, inside, e.name) for e in found)


def _look(path: str) -> os.stat_result | None:
    """Facts about the entry itself; null for one that has gone or may not be looked at."""
    try:
        return os.lstat(path)
    except OSError:
        return None


def _same(a: os.stat_result | None, b: os.stat_result | None) -> bool:
    return a is not None and b is not None and (a.st_size, a.st_mtime_ns) == (b.st_size, b.st_mtime_ns)


def _bytes_wanted(folder: str, name: str, facts: os.stat_result, platform: str) -> bool:
    """Is this a file the intake would read: a plain file of a supported type whose bytes are here?"""
    if not stat.S_ISREG(facts.st_mode) or name.startswith(".") or os.path.splitext(name)[1].lower() not in fixed.SUPPORTED_EXTENSIONS:
        return False
    if platform == "darwin":
        away = facts.st_size > 0 and getattr(facts, "st_blocks", 1) == 0
        return not away and not os.path.lexists(os.path.join(folder, f".{name}{fixed.PLACEHOLDER_SUFFIX}"))
    return platform != "win32" or not getattr(facts, "st_file_attributes", 0) & fixed.OFFLINE_ATTRIBUTE_MASK


def _digest(path: str) -> str | None:
    """SHA-256 of the bytes, read piece by piece; null when they cannot be read."""
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as file:
            while piece := file.read(_PIECE):
                digest.update(piece)
    except OSError:
        return None
    return digest.hexdigest()


class _Listing:
    """What the batch and the stream reader share: options, shares, and the rows of a share."""

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("folder listings need a path")
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.subfolders = options.get("subfolders", "false").lower() == "true"
        self.shares = max(1, int(options.get("shares", "8")))
        self.platform = options.get("platform", sys.platform)
        self.settle = max(0, int(options.get("settle_ms", "0"))) / 1000

    def shares_of(self, changed: tuple[int, int] | None = None) -> list[Share]:
        return [Share(n, self.shares, changed) for n in range(self.shares)]

    def _mine(self, part: Share) -> Iterator[tuple[str, str, str, os.stat_result | None]]:
        for scan, folder, name in _entries(self.path, self.subfolders):
            if zlib.crc32(os.fsencode(os.path.join(scan, name))) % part.value != part.share:
                continue
            facts = _look(os.path.join(folder, name))
            if part.changed is None or (facts is not None and part.changed[0] < facts.st_ctime_ns <= part.changed[1]):
                yield scan, folder, name, facts

    def _settled(self, looked: list[tuple]) -> list[bool]:
        """Two looks in a row that agree, within the first one and six more; all entries wait together."""
        facts = [f for *_, f in looked]
        settled = [False] * len(looked)
        for _ in range(fixed.SETTLE_MAX_RESAMPLES):
            open_ones = [i for i, done in enumerate(settled) if not done and facts[i] is not None]
            if not open_ones:
                break
            time.sleep(self.settle)
            for i in open_ones:
                again = _look(os.path.join(looked[i][1], looked[i][2]))
                settled[i], facts[i] = _same(facts[i], again), again
        return settled

    def rows(self, part: Share) -> Iterator[pa.RecordBatch]:
        mine = self._mine(part)
        while looked := list(islice(mine, ENTRIES_A_LOOK)):
            columns: dict[str, list] = {field.split()[0]: [] for field in SCHEMA.split(", ")}
            for (scan, folder, name, facts), settled in zip(looked, self._settled(looked)):
                shown = os.fsencode(name).decode("utf-8", "replace")
                there = facts is not None
                wanted = settled and there and _bytes_wanted(folder, name, facts, self.platform)
                row = (
                    scan, shown, shown, there and stat.S_ISREG(facts.st_mode), there and stat.S_ISLNK(facts.st_mode),
                    facts.st_size if there else None, facts.st_mtime_ns // 1000 if there else None,
                    getattr(facts, "st_blocks", None), getattr(facts, "st_file_attributes", 0) if there else None,
                    self.platform, settled, _digest(os.path.join(folder, name)) if wanted else None,
                )
                for column, value in zip(columns.values(), row):
                    column.append(value)
            yield pa.RecordBatch.from_pydict(columns, schema=_ARROW)


_ARROW = pa.schema([
    ("scan_id", pa.string()), ("position", pa.string()), ("filename", pa.string()), ("is_file", pa.bool_()), ("is_symlink", pa.bool_()),
    ("size_bytes", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC")), ("blocks", pa.int64()), ("attributes", pa.int64()),
    ("platform", pa.string()), ("settled", pa.bool_()), ("hash", pa.string()),
])


class _Batch(DataSourceReader):
    def __init__(self, listing: _Listing):
        self.listing = listing

    def partitions(self) -> list[Share]:
        return self.listing.shares_of()

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.listing.rows(partition)


class _Stream(DataSourceStreamReader):
    """Entries by the time of their last change, which putting a file into the folder sets.

    A micro-batch is a span of change times that ends ``delay_ms`` ago, so a repeated one finds the
    same files. A file that changes again comes again.
    """

    def __init__(self, listing: _Listing, delay_ms: int):
        self.listing, self.delay = listing, delay_ms * 1_000_000

    def initialOffset(self) -> dict:
        return {"changed": 0}

    def latestOffset(self) -> dict:
        return {"changed": time.time_ns() - self.delay}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.listing.shares_of((start["changed"], end["changed"])) if end["changed"] > start["changed"] else []

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.listing.rows(partition)


class FolderListing(DataSource):
    """``spark.read.format("folder_listing").option("path", ...)``, and the same for ``readStream``.

    Options: ``path``; ``subfolders`` (each direct subfolder is a listing of its own, named by it);
    ``shares`` (tasks, 8); ``platform`` whose rules about missing bytes hold (this machine's);
    ``settle_ms`` between two looks at an entry (0); ``delay_ms`` (streams, 1,000): how old a change
    has to be, at least what clocks and folder listings of the executors may lag behind.
    An empty folder has no rows, a missing one is an error, and an entry that goes while it is looked at has null facts.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(_Listing(self.options))

    def streamReader(self, schema) -> _Stream:
        return _Stream(_Listing(self.options), int(self.options.get("delay_ms", "1000")))


def _options(spark: SparkSession, options: dict) -> dict[str, str]:
    spark.dataSource.register(FolderListing)
    return {"shares": str(4 * spark.sparkContext.defaultParallelism), **{k: str(v) for k, v in options.items()}}


def read_folder(spark: SparkSession, path: str, **options) -> DataFrame:
    """A folder as the listing ``ingest.scan`` takes; names are in byte order."""
    return spark.read.format("folder_listing").options(**_options(spark, options)).load(path)


def stream_folder(spark: SparkSession, path: str, **options) -> DataFrame:
    """Entries as they are put into the folder or change."""
    return spark.readStream.format("folder_listing").options(**_options(spark, options)).load(path)
