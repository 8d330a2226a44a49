"""Benchmark decontamination with one FM-index per training shard.

A shard is a slice of documents inside a task. Its text is the sequence of word ids over
the phrases' own vocabulary: words no phrase holds cannot be part of a match, so they
become breaks, and stretches between breaks that are shorter than the shortest phrase are
left out. The Burrows-Wheeler transform of what remains is kept as a wavelet matrix; all
phrases are searched backwards at once, and occurrences are located by walking to sampled
suffix positions. The occurrences of a document merge into removal spans.

No shuffle: phrases go to the tasks in blocks of bounded size (``block_words``), a larger
benchmark is searched block by block and the spans of the blocks are merged per document.

Words: ``[0-9a-z]`` after lower-casing A-Z, and every byte from 0x80 on.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.llm.text import LOWER, covered, ranges, text_slices, word_hashes, word_spans

WINDOW = 13
BLOCK_WORDS = 1_000_000
SAMPLE_EVERY = 8

_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _hashed_words(data: np.ndarray, offsets: np.ndarray):
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, _IN_WORD)
    return word_hashes(data, starts, ends), first


# ---- the index


class WaveletMatrix:
    """Rank of any symbol at any position, by one bit vector a level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for bit in reversed(range(bits)):
            ones = (symbols >> bit) & 1
            before = np.concatenate(([0], np.cumsum(ones)))
            self.levels.append((bit, before, len(symbols) - int(before[-1])))
            symbols = np.concatenate((symbols[ones == 0], symbols[ones == 1]))

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the position."""
        start = np.zeros_like(position)
        for bit, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            position = np.where(one, zeros + before[position], position - before[position])
            start = np.where(one, zeros + before[start], start - before[start])
        return position - start

    def at(self, position: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(position)
        for bit, before, zeros in self.levels:
            one = before[position + 1] - before[position]
            symbol |= one << bit
            position = np.where(one == 1, zeros + before[position], position - before[position])
        return symbol


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ends as soon as all suffixes differ."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    while True:
        following = np.full(n, -1, np.int64)
        following[:-step] = rank[step:]
        order = np.lexsort((following, rank))
        a, b = rank[order], following[order]
        new = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


class FMIndex:
    """Backward search and location over a sequence of small integers; 0 ends the sequence."""

    def __init__(self, symbols: np.ndarray, sample_every: int = SAMPLE_EVERY):
        text = np.concatenate((symbols + 1, [0]))
        order = suffix_order(text)
        last = text[order - 1]
        self.size = len(text)
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 2))))
        self.wavelet = WaveletMatrix(last, max(1, int(text.max()).bit_length()))
        sampled = order % sample_every == 0
        self.sampled = sampled
        self.sampled_before = np.concatenate(([0], np.cumsum(sampled)))
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of patterns of one length; the range of suffixes that start with each."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        for column in reversed(range(patterns.shape[1])):
            symbol = np.minimum(patterns[:, column] + 1, len(self.counts) - 3)
            known = symbol == patterns[:, column] + 1
            low = self.counts[symbol] + self.wavelet.rank(symbol, low)
            high = np.where(known, self.counts[symbol] + self.wavelet.rank(symbol, high), low)
            high = np.maximum(high, low)
        return low, high

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Where the suffixes of these ranks start."""
        found = np.empty(len(suffixes), np.int64)
        open_, rank, steps = np.arange(len(suffixes)), suffixes.copy(), 0
        while len(open_):
            hit = self.sampled[rank]
            found[open_[hit]] = self.samples[self.sampled_before[rank[hit]]] + steps
            open_, rank, steps = open_[~hit], rank[~hit], steps + 1
            if len(open_):
                symbol = self.wavelet.at(rank)
                rank = self.counts[symbol] + self.wavelet.rank(symbol, rank)
        return found


# ---- phrases


@dataclass
class Phrases:
    """The phrases of one block: vocabulary (sorted hashes), and by length the distinct id rows with their items."""

    vocabulary: np.ndarray
    by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    shortest: int


def phrases_of(items: list[tuple[int | None, str | None]], window: int) -> Phrases | None:
    """Every window of every item; an item of fewer words is one window, one without words is none."""
    encoded = [(-1 if i is None else k, (text or "").encode()) for k, (i, text) in enumerate(items)]
    if not encoded:
        return None
    offsets = np.concatenate(([0], np.cumsum([len(b) for _, b in encoded]))).astype(np.int64)
    hashes, first = _hashed_words(np.frombuffer(b"".join(b for _, b in encoded), np.uint8), offsets)
    if not len(hashes):
        return None
    vocabulary, ids = np.unique(hashes, return_inverse=True)
    rows: dict[int, list] = {}
    for k, (item, _) in enumerate(encoded):
        own = ids[first[k] : first[k + 1]]
        if len(own):
            width = min(window, len(own))
            rows.setdefault(width, []).append((np.lib.stride_tricks.sliding_window_view(own, width), item))
    by_length = []
    for width, parts in sorted(rows.items()):
        every = np.concatenate([p for p, _ in parts])
        owner = np.concatenate([np.full(len(p), item) for p, item in parts])
        distinct, which = np.unique(every, axis=0, return_inverse=True)
        which = which.reshape(-1)
        order = np.argsort(which, kind="stable")
        by_length.append((distinct, owner[order], np.searchsorted(which[order], np.arange(len(distinct) + 1))))
    return Phrases(vocabulary, by_length, min(rows))


def search_shard(hashes: np.ndarray, first: np.ndarray, phrases: Phrases):
    """Occurrences in a shard: word ranges, and (row, item) pairs."""
    place = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[place] == hashes
    opens, closes = known.copy(), known.copy()
    opens[1:] &= ~known[:-1]
    closes[:-1] &= ~known[1:]
    filled = first[:-1] < first[1:]
    opens[first[:-1][filled]] = known[first[:-1][filled]]
    closes[first[1:][filled] - 1] = known[first[1:][filled] - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    enough = stops - starts >= phrases.shortest
    starts, stops = starts[enough], stops[enough]
    nothing = np.empty(0, np.int64)
    if not len(starts):
        return nothing, nothing, nothing, nothing
    # each stretch is followed by a break, here the symbol 0; words are 1 and up
    lengths = stops - starts
    origin = ranges(starts, stops + 1)
    breaks = np.cumsum(lengths + 1) - 1
    symbols = place[np.minimum(origin, len(place) - 1)].astype(np.int64) + 1
    symbols[breaks] = 0
    index = FMIndex(symbols)
    begin, end, items = [], [], []
    for rows, owners, owner_at in phrases.by_length:
        low, high = index.search(rows.astype(np.int64) + 1)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        at = origin[index.locate(ranges(low[hit], high[hit]))]
        which = np.repeat(hit, high[hit] - low[hit])
        begin.append(at)
        end.append(at + rows.shape[1])
        n = owner_at[which + 1] - owner_at[which]
        items.append(np.stack((np.repeat(at, n), owners[ranges(owner_at[which], owner_at[which + 1])])))
    if not begin:
        return nothing, nothing, nothing, nothing
    word, item = np.concatenate(items, axis=1)
    row = np.searchsorted(first, word, "right") - 1
    pair = np.unique(np.stack((row, item)), axis=1)
    return np.concatenate(begin), np.concatenate(end), pair[0], pair[1]


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_words`` words; one block at a time is on the driver."""
    held, words = [], 0
    for row in benchmark.select(F.col(item_id), F.col(text)).toLocalIterator():
        held.append((row[0], row[1]))
        words += len(row[1] or "") // 4 + 1
        if words >= block_words:
            yield held
            held, words = [], 0
    if held:
        yield held



def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Documents with four more columns: ``_n_words``, ``_n_hit``, ``_spans`` and ``_items``.

    ``_spans``: merged word ranges [start, stop) inside an occurrence; ``_items``: ids (as
    strings, sorted, distinct) of the items with an occurrence. Other columns pass through; where the documents have a column of
    one of these names, it is replaced (``decontaminated`` keeps it). Null or empty text: no words. A null item_id counts for
    spans and is not listed. Empty benchmark: no hits. Repeated rows are judged each.
    """
    names = [c for c in docs.columns if c not in ("_n_words", "_n_hit", "_spans", "_items")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    added = {"_n_words": "long", "_spans": "array<struct<start:long,stop:long>>", "_items": "array<string>"}
    schema = docs.withColumns({name: F.lit(None).cast(kind) for name, kind in added.items()}).schema
    out = docs
    blocks = 0
    for block in _blocks(benchmark, item_id, item_text, block_words):
        labels = [None if i is None else str(i) for i, _ in block]
        phrases = phrases_of(block, window)
        if phrases is None:
            continue
        out = _search_block(out, schema, phrases, labels, text, first=blocks == 0)
        blocks += 1
    if not blocks:
        out = _search_block(out, schema, None, [], text, first=True)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.withColumn("_n_hit", hit)


def _search_block(docs: DataFrame, schema, phrases: Phrases | None, labels: list, text: str, first: bool) -> DataFrame:
    """One pass of the documents over one block; from the second on it adds to what is there."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text):
            hashes, at = _hashed_words(part.data, part.offsets)
            n = len(part.null)
            own = [([], []) for _ in range(n)]
            items = [set() for _ in range(n)]
            if not first:
                for k, (spans, listed) in enumerate(zip(part.rows.column("_spans").to_pylist(), part.rows.column("_items").to_pylist())):
                    own[k] = ([s["start"] for s in spans], [s["stop"] for s in spans])
                    items[k] = set(listed)
            if phrases is not None and len(hashes):
                begin, end, row, item = search_shard(hashes, at, phrases)
                if len(begin):
                    inside = covered(len(hashes), begin, end)
                    edge = inside.copy()
                    edge[1:] ^= inside[:-1]
                    heads = at[:-1][at[:-1] < at[1:]]
                    edge[heads] = inside[heads]
                    close = inside.copy()
                    close[:-1] &= ~inside[1:]
                    tails = at[1:][at[:-1] < at[1:]] - 1
                    close[tails] = inside[tails]
                    opens, closes = np.flatnonzero(edge & inside), np.flatnonzero(close) + 1
                    which = np.searchsorted(at, opens, "right") - 1
                    for k, a, b in zip(which.tolist(), (opens - at[which]).tolist(), (closes - at[which]).tolist()):
                        own[k][0].append(a)
                        own[k][1].append(b)
                    for k, i in zip(row.tolist(), item.tolist()):
                        if i >= 0:
                            items[k].add(labels[i])
            spans = [_merged(*x) for x in own]
            kept = [part.rows.column(c) for c in part.rows.schema.names if c not in ("_n_words", "_spans", "_items")]
            names = [c for c in part.rows.schema.names if c not in ("_n_words", "_spans", "_items")]
            yield pa.RecordBatch.from_arrays(
                [
                    *kept,
                    pa.array(np.diff(at)),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                names=[*names, "_n_words", "_spans", "_items"],
            )

    return docs.mapInArrow(shards, schema)


def _merged(starts: list[int], stops: list[int]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(zip(starts, stops)):
        if out and a <= out[-1]["stop"]:
            out[-1]["stop"] = max(b, out[-1]["stop"])
        else:
            out.append({"start": a, "stop": b})
    return out


def is_contaminated() -> Column:
    """At least a twentieth of the words lie inside occurrences."""
    return (F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = contaminated_spans(docs.select("doc_id", "text"), benchmark, **options)
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
        F.col("_spans").alias("spans"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, unchanged, whatever their columns are called."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = contaminated_spans(docs.toDF(*names), benchmark, text=names[docs.columns.index(text)], **options)
    return found.where(~is_contaminated()).select(*names).toDF(*docs.columns)
