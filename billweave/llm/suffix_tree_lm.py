"""Scoring texts with a probabilistic suffix tree over words.

A token is a word or the end of a text. The tree has two layers. The upper one is a small tree
over classes of words that stands where words are too rare; its alphabet is bounded: the words that make
up at least ``SYMBOL_SHARE`` of all tokens, the end, and for all other words one symbol per
ending (last two bytes) with such a share, the rest of them together. Contexts are the last
few symbols. A context is a candidate with at least ``CONTEXT_SHARE`` of all positions and
retained where its next-symbol counts diverge enough from those of the longest retained context
inside it; distributions are smoothed towards that one (Witten-Bell). A token is
scored in the state of the longest retained suffix of what stands before it, and a
word behind a symbol of several words by its share of the symbol, with discounted counts: what
is taken off is the probability of a word not met in training.

The lower layer grows with the corpus. Its contexts are the last one to ``MAX_DEPTH`` words as
they are, the beginning included; a context is a candidate when it was met ``LEAST_COUNT`` times,
and retained by the same divergence test against the longest one inside it (for a
single word: its class).

Upper alphabet and contexts are bounded by the shares whatever the size of the corpus, so that tree
travels to tasks by value. Word counts and lower contexts are not bounded. Texts are cut into words
once and kept as slices; a slice asks the buckets that add up the words for the counts of its own. Then
every place behind a word that may be a context goes to the bucket of that word, with the words before
it as far as they may make a longer one. A bucket so holds whole subtrees of contexts, with everything
that follows them: it learns them and scores the places in one go, and sums come back per slice and row.
A context met four times as often as a bucket has places on average (``BUCKET_PLACES``) would not fit one (there are
at most tokens / 4 BUCKET_PLACES a depth): what follows it is counted in buckets of its own, its figures are added up over
them, and its places go on to the buckets of the contexts one word longer.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.llm.text import LOWER, NOT_SPACE, Rolling, Slice, mix, text_slices, word_hashes, word_spans
from billweave.session import cut_lineage

FOLDS, HELD_OUT_FOLD = 7, 2
MAX_DEPTH = 4
SYMBOL_SHARE = 1e-3
CONTEXT_SHARE = 1e-3
BUCKET_PLACES = 1_000_000
_COMMON = 4
_SLICE_WORDS, _PIECE_WORDS, _AT_ONCE = 2_500_000, 500_000, 1 << 17
_READ_BYTES = 1 << 20
LEAST_COUNT = 20
DIVERGENCE = 20.0
DISCOUNT = 0.75
_BASE = 4096
_ENDINGS = 1 << 16


def held_out(doc_id: Column) -> Column:
    """Texts that are scored and not learned from; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def _words(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending of every word (A-Z lowered), and the rows' offsets in them."""
    data = LOWER[part.data]
    starts, ends, at = word_spans(data, part.offsets, NOT_SPACE)
    last = data[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return word_hashes(data, starts, ends), before * 256 + last, at


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value, byte by byte of their numbers: high bytes are mostly zero."""
    body = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in map(np.ascontiguousarray, arrays))
    return np.array([len(body), *map(len, arrays)], np.int64).tobytes() + _zstd().compress(body, asbytes=True)


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    total, *lengths = np.frombuffer(data, np.int64, 1 + len(kinds)).tolist()
    body = np.frombuffer(_zstd().decompress(memoryview(data)[8 * (1 + len(kinds)) :], decompressed_size=total, asbytes=True), np.uint8)
    out, at = [], 0
    for kind, length in zip(kinds, lengths):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(body[at : at + length * size].reshape(size, length).T).reshape(-1).view(kind))
        at += length * size
    return out


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


_SLICES = "slice long, tokens long, ends long, words binary, figures binary, texts binary"
_FIGURES = (np.uint16, np.uint32)
_TEXTS = (np.uint32, np.int64, np.int64, np.uint8, np.uint8)


def tokenised(docs: DataFrame) -> DataFrame:
    """One row per slice of doc_id, text and held_out: training tokens and texts, distinct words by hash, their endings and training counts, texts as ranks of words by count."""

    def row(slice_id: int, parts: list[tuple]) -> pa.RecordBatch:
        hashes, endings, n, which, n_words, doc, null, out = zip(*parts)
        keys, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        place = place.reshape(-1)
        count = np.bincount(place, weights=np.concatenate(n), minlength=len(keys)).astype(np.uint32)
        rank = np.empty(len(keys), np.uint32)
        rank[_by_count(count)] = np.arange(len(keys))
        own = np.split(rank[place], np.cumsum([len(h) for h in hashes])[:-1])
        texts = _packed(np.concatenate([r[w] for r, w in zip(own, which)]), *map(np.concatenate, (n_words, doc, null, out)))
        ends = int((np.concatenate(out) == 0).sum())
        return _batch([(slice_id, int(count.sum()) + ends, ends, _packed(keys), _packed(np.concatenate(endings)[first], count), texts)], _SLICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, number, parts, held = TaskContext.get().partitionId(), 0, [], 0
        for part in text_slices(batches, "text", _READ_BYTES):
            hashes, endings, at = _words(part)
            keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            which = which.reshape(-1).astype(np.uint32)
            out = part.rows.column("held_out").to_numpy(zero_copy_only=False)
            n = np.bincount(which[~np.repeat(out, np.diff(at))], minlength=len(keys))
            doc = part.rows.column("doc_id").cast(pa.int64())
            ids, null = doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False)
            parts.append((keys, endings[first].astype(np.uint16), n, which, np.diff(at).astype(np.int64), ids, null.astype(np.uint8), out.astype(np.uint8)))
            held += len(hashes)
            if held >= _SLICE_WORDS:
                yield row(part_id << 32 | number << 16, parts)
                number, parts, held = number + 1, [], 0
        if parts:
            yield row(part_id << 32 | number << 16, parts)

    return docs.mapInArrow(run, _SLICES)


def _by_count(n: np.ndarray) -> np.ndarray:
    """A slice's words, those met most often first."""
    return np.argsort(-n.astype(np.int64), kind="stable")


_ASKED = "bucket int, slice long, piece int, data binary"
_TOLD = "kind int, bucket int, slice long, piece int, depth int, data binary"
_FACTS, _ANSWER = range(2)


def _edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes: a bucket is a range of them."""
    held = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(held, np.arange(buckets + 1).astype(np.uint64))


def _by_bucket(slice_id: int, piece: int, hashes: np.ndarray, others: list[np.ndarray], buckets: int) -> list[tuple]:
    edges = _edges(hashes, buckets)
    return [(b, slice_id, piece, _packed(*(c[edges[b] : edges[b + 1]] for c in (hashes, *others)))) for b in np.flatnonzero(np.diff(edges)).tolist()]


def _merged(blobs: pa.Table, kinds: tuple) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all blobs, and where each blob begins in them."""
    parts = [_unpacked(data, *kinds) for data in blobs.column("data").to_pylist()]
    return [np.concatenate(c) for c in zip(*parts)], np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))


def _answers(blobs: pa.Table, depth: int, edges: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    bucket, ids, pieces = blobs.column("bucket")[0].as_py(), blobs.column("slice").to_pylist(), blobs.column("piece").to_pylist()
    return [(_ANSWER, bucket, s, k, depth, _packed(*(c[a:b] for c in columns))) for s, k, a, b in zip(ids, pieces, edges[:-1], edges[1:])]


#: numbers of words: none, the beginning, the end; then a bucket's by how often they were met, so that small ones are frequent
_NONE_ID, _BEGIN_ID, _END_ID, _FIRST_ID = range(4)


def word_totals(slices: DataFrame, buckets: int) -> DataFrame:
    """Words with a number and their counts in all training texts, and for each slice those of its own words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_id, words, figures in zip(*(batch.column(c).to_pylist() for c in ("slice", "words", "figures"))):
                yield _batch(_by_bucket(slice_id, 0, *_unpacked(words, np.uint64), _unpacked(figures, *_FIGURES), buckets), _ASKED)

    def tell(blobs: pa.Table) -> pa.Table:
        (hashes, endings, n), edges = _merged(blobs, (np.uint64, *_FIGURES))
        bucket = blobs.column("bucket")[0].as_py()
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        which = which.reshape(-1)
        total = np.bincount(which, weights=n, minlength=len(keys)).astype(np.int64)
        ids = np.empty(len(keys), np.uint32)
        ids[np.argsort(-total, kind="stable")] = np.arange(len(keys)) * buckets + bucket + _FIRST_ID
        facts = (_FACTS, bucket, -1, 0, 0, _packed(keys, endings[first], total, ids))
        return pa.Table.from_batches([_batch([facts, *_answers(blobs, 0, edges, total[which], ids[which])], _TOLD)])

    return slices.select("slice", "words", "figures").mapInArrow(ask, _ASKED).groupBy("bucket").applyInArrow(tell, _TOLD)


_WORD = (np.uint64, np.uint16, np.int64, np.uint32)


def _words_of(totals: DataFrame) -> DataFrame:
    """hash, ending, count in training texts (0 for words of held-out texts only), id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                keys, endings, total, ids = _unpacked(data, *_WORD)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(endings.astype(np.int32)), pa.array(total), pa.array(ids.astype(np.int64))], names=["hash", "ending", "count", "id"])

    return totals.where((F.col("kind") == _FACTS) & (F.col("depth") == 0)).select("data").mapInArrow(run, "hash long, ending int, count long, id long")


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, ending, count in training texts (0 for words of held-out texts only); from doc_id, text and held_out."""
    return _words_of(word_totals(tokenised(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))).drop("id")


# ---- the tree


@dataclass
class Alphabet:
    """Symbols: frequent words, endings of the others, others at all, end of text; the beginning is only ever a context."""

    words: np.ndarray
    of_ending: np.ndarray
    size: int

    @property
    def end(self) -> int:
        return self.size - 1

    @property
    def begin(self) -> int:
        return self.size

    def encode(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        index, there = member(self.words, hashes)
        return np.where(there, index, self.of_ending[endings]).astype(np.uint16)


def member(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each value among sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    index = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return index, keys[index] == values


def alphabet_of(words: DataFrame, tokens: int, share: float) -> Alphabet:
    """Chosen from the table of word counts; at most 1 / share words and as many endings reach the driver."""
    least = max(2.0, share * tokens)
    frequent = words.where(F.col("count") >= least).select("hash").toArrow().column("hash").to_numpy().astype(np.int64).view(np.uint64)
    others = words.where((F.col("count") < least) & (F.col("count") > 0)).groupBy("ending").agg(F.sum("count").alias("n")).where(F.col("n") >= least)
    endings = np.sort(others.select("ending").toArrow().column("ending").to_numpy())
    of_ending = np.full(_ENDINGS, len(frequent) + len(endings), np.int64)
    of_ending[endings] = len(frequent) + np.arange(len(endings))
    return Alphabet(np.sort(frequent), of_ending, len(frequent) + len(endings) + 2)


def encoded(docs: DataFrame, alphabet: Alphabet) -> DataFrame:
    """One row per slice: its training texts as symbols, beginning and end included, one after another."""
    return _encoded(tokenised(docs), alphabet)


def _encoded(slices: DataFrame, alphabet: Alphabet) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for symbols in _sequences(batch, alphabet):
                yield pa.RecordBatch.from_arrays([pa.array([symbols.tobytes()], pa.binary())], names=["symbols"])

    return slices.select("words", "figures", "texts").mapInArrow(encode, "symbols binary")


def _sequences(batch: pa.RecordBatch, alphabet: Alphabet) -> Iterator[np.ndarray]:
    """Training texts as symbols, of encoded rows or of slices."""
    if "symbols" in batch.schema.names:
        yield from (np.frombuffer(row.as_buffer(), np.uint16) for row in batch.column("symbols"))
        return
    for words, figures, texts in zip(*(batch.column(c).to_pylist() for c in ("words", "figures", "texts"))):
        (hashes,), (endings, count) = _unpacked(words, np.uint64), _unpacked(figures, *_FIGURES)
        which, n, _, _, out = _unpacked(texts, *_TEXTS)
        symbols, _ = framed(alphabet.encode(hashes, endings)[_by_count(count)][which], np.concatenate(([0], np.cumsum(n))), alphabet)
        yield symbols[np.repeat(out == 0, n + 2)]


def framed(symbols: np.ndarray, at: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Each row's symbols between a beginning and an end; and where the words went."""
    rows = np.arange(len(at) - 1)
    out = np.full(len(symbols) + 2 * len(rows), alphabet.begin, np.uint16)
    place = np.arange(len(symbols)) + np.repeat(2 * rows + 1, np.diff(at))
    out[place] = symbols
    out[at[1:] + 2 * rows + 1] = alphabet.end
    return out, place


def _codes(symbols: np.ndarray, depth: int, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Places with ``depth`` symbols of their own text before them, and these as a number, the nearest lowest."""
    since = np.arange(len(symbols)) - np.maximum.accumulate(np.where(symbols == alphabet.begin, np.arange(len(symbols)), 0))
    place = np.flatnonzero((since >= max(depth, 1)) & (symbols != alphabet.begin))
    code = np.zeros(len(place), np.int64)
    for j in range(depth, 0, -1):
        code = code * _BASE + symbols[place - j]
    return place, code


def _level(sequences: DataFrame, depth: int, candidates: np.ndarray, alphabet: Alphabet) -> pa.Table:
    """context, symbol, count of the candidates of one depth: at most candidates x symbols rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for symbols in _sequences(batch, alphabet):
                symbols = symbols.astype(np.int64)
                place, code = _codes(symbols, depth, alphabet)
                index, there = member(candidates, code)
                pair = index[there] * alphabet.size + symbols[place[there]]
                if len(candidates) * alphabet.size <= 1 << 22:
                    n = np.bincount(pair)
                    pair = np.flatnonzero(n)
                    n = n[pair]
                else:
                    pair, n = np.unique(pair, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(candidates[pair // alphabet.size]), pa.array(pair % alphabet.size), pa.array(n)], names=["context", "symbol", "count"])

    return sequences.mapInArrow(count, "context long, symbol long, count long").groupBy("context", "symbol").agg(F.sum("count").alias("count")).toArrow()


@dataclass
class SuffixTree:
    """``child[node, symbol]``: the context one symbol longer, or -1; ``state``: the retained node a context stands for; ``log_p[state, symbol]``."""

    child: np.ndarray
    state: np.ndarray
    log_p: np.ndarray
    depth: int

    def score(self, symbols: np.ndarray, place: np.ndarray, begin: int, depth: int | None = None) -> np.ndarray:
        """log10 probability of the symbols at these places, each in its longest retained state (of at most ``depth`` symbols)."""
        parts = [self._score(symbols, place[i : i + _AT_ONCE], begin, depth) for i in range(0, len(place), _AT_ONCE)]
        return np.concatenate(parts) if parts else np.empty(0)

    def _score(self, symbols: np.ndarray, place: np.ndarray, begin: int, depth: int | None) -> np.ndarray:
        node = np.zeros(len(place), np.int64)
        open_ = np.arange(len(place))
        for j in range(1, (self.depth if depth is None else min(depth, self.depth)) + 1):
            before = symbols[place[open_] - j]
            next_ = self.child[node[open_], before]
            open_, next_, before = open_[next_ >= 0], next_[next_ >= 0], before[next_ >= 0]
            node[open_] = next_
            open_ = open_[before != begin]
            if not len(open_):
                break
        return self.log_p[self.state[node], symbols[place]].astype(float)


def learn_tree(sequences: DataFrame, alphabet: Alphabet, *, max_depth: int = MAX_DEPTH, share: float = CONTEXT_SHARE, divergence: float = DIVERGENCE) -> SuffixTree:
    """Grow the tree a depth at a time; counts of one depth name the candidates of the next."""
    size = alphabet.size
    children, state, rows = [np.full((1, size + 1), -1, np.int32)], [0], []
    contexts: dict[int, int] = {}
    nodes, candidates, least, reached = 1, np.zeros(1, np.int64), 0.0, 0
    previous: dict[int, int] = {0: 0}
    for depth in range(max_depth + 1):
        table = _level(sequences, depth, candidates, alphabet)
        code, symbol, count = [table.column(c).to_numpy().astype(np.int64) for c in ("context", "symbol", "count")]
        own = np.unique(code)
        counts = np.zeros((len(own), size))
        counts[np.searchsorted(own, code), symbol] = count
        if depth == 0:
            total = counts.sum()
            least = max(2.0, share * total)
            kinds = max(1, np.count_nonzero(counts))
            rows.append(((counts[0] if len(own) else np.zeros(size)) + kinds / size) / (total + kinds))
        here: dict[int, int] = {}
        for k, c in enumerate(own.tolist() if depth else []):
            inner = previous[c % _BASE ** (depth - 1)]
            base = state[inner]
            n, seen = counts[k].sum(), counts[k] > 0
            node = nodes
            nodes += 1
            here[c] = node
            children.append(np.full((1, size + 1), -1, np.int32))
            children[inner][0, c // _BASE ** (depth - 1)] = node
            gain = (counts[k][seen] * np.log(counts[k][seen] / n / rows[base][seen])).sum()
            if gain >= divergence:
                kinds = np.count_nonzero(seen)
                state.append(len(rows))
                rows.append((counts[k] + kinds * rows[base]) / (n + kinds))
            else:
                state.append(base)
            reached = depth
        if depth:
            previous = here
        # the next depth's contexts: this depth's context with the symbol that follows it, where that is frequent enough
        follow = (count >= least) & (symbol != alphabet.end)
        candidates = np.unique(code[follow] * _BASE + symbol[follow]) if depth else np.unique(np.append(symbol[follow], alphabet.begin))
        if depth:
            candidates = candidates[[int(c % _BASE**depth) in previous for c in candidates]]
        if not len(own) or not len(candidates):
            break
    return SuffixTree(np.concatenate(children), np.array(state), np.log10(np.stack(rows)).astype(np.float32), reached)


# ---- contexts of words


def _runs(words: np.ndarray, rolling: Rolling, place: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words that end before each place; a single word has its own."""
    return words[place - 1] if length == 1 else rolling.of(place - length, place)


@dataclass
class Shares:
    """What words have of their symbol: training counts and kinds of each symbol.

    A symbol of one word has share one. In a symbol of several, ``DISCOUNT`` is taken off each
    count, and what that gives is the probability of a word of this symbol not met before.
    """

    alphabet: Alphabet
    n: np.ndarray
    kinds: np.ndarray

    def log_p(self, symbol: np.ndarray, count: np.ndarray) -> np.ndarray:
        all_, new = np.maximum(self.n[symbol], 1), DISCOUNT * np.maximum(self.kinds[symbol], 1)
        return np.log10(np.where(symbol < len(self.alphabet.words), 1.0, np.where(count > 0, (count - DISCOUNT) / all_, np.where(self.n[symbol] > 0, new / all_, 1.0))))


def shares_of(words: DataFrame, alphabet: Alphabet) -> Shares:
    """From the table of word counts or what buckets told of words; one row per symbol reaches the driver."""

    def own_columns(batch: pa.RecordBatch) -> Iterator[tuple]:
        if "data" in batch.schema.names:
            yield from (_unpacked(data, *_WORD)[:3] for data in batch.column("data").to_pylist())
        else:
            yield batch.column("hash").to_numpy().view(np.uint64), batch.column("ending").to_numpy(), batch.column("count").to_numpy()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, endings, count in (columns for batch in batches for columns in own_columns(batch)):
            symbol = alphabet.encode(keys, endings).astype(np.int64)[count > 0]
            n, kinds = np.bincount(symbol, weights=count[count > 0]).astype(np.int64), np.bincount(symbol)
            own = np.flatnonzero(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own]), pa.array(kinds[own])], names=["symbol", "n", "kinds"])

    facts = words.mapInArrow(place, "symbol long, n long, kinds long").groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).toArrow()
    n, kinds = np.zeros(alphabet.size + 1), np.zeros(alphabet.size + 1)
    n[facts.column("symbol").to_numpy()] = facts.column("n").to_numpy()
    kinds[facts.column("symbol").to_numpy()] = facts.column("kinds").to_numpy()
    return Shares(alphabet, n, kinds)


def word_values(words: DataFrame, alphabet: Alphabet, below: int) -> DataFrame:
    """hash, count, base, log_p, known: the unigram value of each word, and its share of its symbol."""
    shares = shares_of(words, alphabet)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.column("count").to_numpy()
            symbol = alphabet.encode(batch.column("hash").to_numpy().view(np.uint64), batch.column("ending").to_numpy())
            columns = [batch.column("hash"), batch.column("count"), pa.array(np.log10((count + 1) / below)), pa.array(shares.log_p(symbol, count)), pa.array((count > 0).astype(float))]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "count", "base", "log_p", "known"])

    return words.mapInArrow(value, "hash long, count long, base double, log_p double, known double")


@dataclass
class Common:
    """Contexts of one length that are met too often for a bucket, by hash: last word, training count, kinds of words behind, whether retained."""

    keys: np.ndarray
    last: np.ndarray
    n: np.ndarray
    kinds: np.ndarray
    kept: np.ndarray


@dataclass
class Model:
    """What a task needs of the corpus to read a slice; none of it grows with it but ``commons``, of at most tokens / places a depth.

    ``symbol_of``: the numbers of the words that are symbols, sorted, and the symbols.
    """

    alphabet: Alphabet
    symbol_of: np.ndarray
    tree: SuffixTree
    shares: Shares
    commons: list[Common] | None
    ends: int
    below: int
    buckets: int
    max_depth: int
    least_count: int
    divergence: float


class Dictionary:
    """A slice's words by rank: number, training count in all texts, symbol; and the answers to its pieces."""

    def __init__(self, own: pa.Table, told: pa.Table, model: Model):
        self.model = model
        self.slice_id = own.column("slice")[0].as_py()
        self.told = sorted(zip(*(told.column(c).to_pylist() for c in ("depth", "piece", "bucket", "data"))))
        endings, own_count = _unpacked(own.column("figures")[0].as_py(), *_FIGURES)
        self.texts = _unpacked(own.column("texts")[0].as_py(), *_TEXTS)
        order = _by_count(own_count)
        count, ids = self.answers(0, 0, np.int64, np.uint32)
        self.count, self.ids = count[order], ids[order]
        index, there = member(model.symbol_of[0], self.ids)
        self.symbol = model.alphabet.of_ending[endings[order]].astype(np.uint16)
        self.symbol[there] = model.symbol_of[1][index[there]]
        self.share = model.shares.log_p(self.symbol, self.count)

    def answers(self, depth: int, piece: int, *kinds: type) -> list[np.ndarray]:
        """The buckets' answers about sorted hashes, one after another."""
        parts = [_unpacked(data, *kinds) for d, k, _, data in self.told if (d, k) == (depth, piece)]
        return [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, k) for k in kinds]

    def pieces(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Texts of about ``_PIECE_WORDS`` words in all, as a slice's figures take more room than its words."""
        which, n_words, *rows = self.texts
        at = np.concatenate(([0], np.cumsum(n_words)))
        start = number = 0
        while start < len(n_words):
            stop = min(max(int(np.searchsorted(at, at[start] + _PIECE_WORDS, "right")) - 1, start + 1), len(n_words))
            yield number, [which[at[start] : at[stop]], n_words[start:stop], *(c[start:stop] for c in rows)]
            start, number = stop, number + 1


class Read:
    """A piece of a slice with the figures of its words, each place as far as common contexts settle it."""

    def __init__(self, of: Dictionary, piece: int, texts: list[np.ndarray]):
        self.model = model = of.model
        self.slice_id, self.piece = of.slice_id, piece
        which, self.n_words, self.doc, self.null, self.out = texts
        alphabet, at = model.alphabet, np.concatenate(([0], np.cumsum(self.n_words)))
        count, ids, symbol = of.count, of.ids, of.symbol
        self.symbols, placed = framed(symbol[which], at, alphabet)
        self.row = np.repeat(np.arange(len(self.n_words), dtype=np.uint32), self.n_words + 2)
        self.number = np.where(self.symbols == alphabet.begin, np.uint32(_BEGIN_ID), np.uint32(_END_ID))
        self.number[placed] = ids[which]
        self.since = (np.arange(len(self.symbols)) - np.repeat(at[:-1] + 2 * np.arange(len(self.n_words)), self.n_words + 2)).astype(np.int32)
        #: only runs that common contexts are part of need a hash
        self.words = mix(self.number.astype(np.uint64)) if model.commons is not None else None
        self.rolling = Rolling(self.words) if model.commons is not None else None
        self.met = np.zeros(len(self.symbols), np.int64)
        self.met[placed] = count[which]
        self.met[self.symbols == alphabet.begin] = model.ends
        text = self.row[placed]
        self.base = np.bincount(text, weights=np.log10((count + 1) / model.below)[which], minlength=len(self.n_words))
        self.known = np.bincount(text, weights=(count > 0)[which], minlength=len(self.n_words))
        self.place = np.flatnonzero(self.symbols != alphabet.begin)
        of_word = np.zeros(len(self.symbols))
        of_word[placed] = of.share[which]
        of_word = of_word[self.place]
        self.by_class = model.tree.score(self.symbols, self.place, alphabet.begin) + of_word
        self.p = model.tree.score(self.symbols, self.place, alphabet.begin, 1) + of_word
        #: the length of the shortest context that is not common
        self.start = np.ones(len(self.place), np.int8)
        for depth, common in enumerate(model.commons or [], 1):
            at, index = self.behind(depth, common.keys)
            grams, which = np.unique(self.gram(depth, at), return_inverse=True)
            n, kinds = common.n[index], common.kinds[index]
            own_p = np.log10((of.answers(depth, piece, np.int64)[0][which.reshape(-1)] + kinds * 10.0 ** self.p[at]) / (n + kinds))
            self.p[at] = np.where(common.kept[index], own_p, self.p[at])
            self.start[at] = depth + 1

    def behind(self, depth: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places behind one of these contexts, as indexes of ``place``, and which."""
        at = np.flatnonzero((self.start == depth) & (self.since[self.place] >= depth))
        index, there = member(keys, self.context(depth, at))
        return at[there], index[there]

    def context(self, depth: int, at: np.ndarray) -> np.ndarray:
        return _runs(self.words, self.rolling, self.place[at], depth)

    def gram(self, depth: int, at: np.ndarray) -> np.ndarray:
        return _runs(self.words, self.rolling, self.place[at] + 1, depth + 1)


# ---- contexts too common for a bucket

_GRAMS = (np.uint64, np.uint32, np.uint32, np.float64, np.uint32)


def _grams(read: Read, depth: int, keys: np.ndarray) -> list[tuple]:
    """What follows these contexts in a slice, by bucket of context and word: hash, word, context, log10 probability inside, training count."""
    at, index = read.behind(depth, keys)
    grams, first, which = np.unique(read.gram(depth, at), return_index=True, return_inverse=True)
    n = np.bincount(which.reshape(-1), weights=read.out[read.row[read.place[at]]] == 0, minlength=len(grams))
    word = read.number[read.place[at[first]]]
    return _by_bucket(read.slice_id, read.piece, grams, [word, index[first].astype(np.uint32), read.p[at[first]], n.astype(np.uint32)], read.model.buckets)


def _gram_totals(asked: DataFrame, depth: int, places: int) -> DataFrame:
    """Counts for each slice; the figures of the contexts as far as a bucket has them; and the grams that are common contexts of the next depth."""

    def tell(blobs: pa.Table) -> pa.Table:
        (grams, word, context, p, n), edges = _merged(blobs, _GRAMS)
        keys, first, which = np.unique(grams, return_index=True, return_inverse=True)
        total = np.bincount(which.reshape(-1), weights=n, minlength=len(keys)).astype(np.int64)
        met = np.flatnonzero(total > 0)
        own, index = np.unique(context[first[met]], return_inverse=True)
        count, inner = total[met].astype(float), p[first[met]]
        sums = [np.bincount(index.reshape(-1), weights=w, minlength=len(own)) for w in (count, np.ones(len(met)), count * (np.log(count) - inner * np.log(10)))]
        often = (total >= places) & (word[first] != _END_ID)
        facts = _packed(own.astype(np.int64), *sums, keys[often], word[first][often].astype(np.uint64), total[often])
        return pa.Table.from_batches([_batch([(_FACTS, blobs.column("bucket")[0].as_py(), -1, 0, depth, facts), *_answers(blobs, depth, edges, total[which.reshape(-1)])], _TOLD)])

    return asked.groupBy("bucket").applyInArrow(tell, _TOLD)


_FACT = "hash long, last long, n double, kinds double, gain double"


def _gram_facts(told: DataFrame) -> DataFrame:
    """Figures of contexts (``hash``: which) without ``last``, and of common grams with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                own, n, kinds, gain, keys, last, total = _unpacked(data, np.int64, np.float64, np.float64, np.float64, np.uint64, np.uint64, np.int64)
                rows = list(zip(own.tolist(), [None] * len(own), n.tolist(), kinds.tolist(), gain.tolist()))
                rows += zip(keys.view(np.int64).tolist(), last.view(np.int64).tolist(), total.astype(float).tolist(), [0.0] * len(keys), [0.0] * len(keys))
                yield _batch(rows, _FACT)

    facts = told.where(F.col("kind") == _FACTS).select("data").mapInArrow(run, _FACT)
    return facts.groupBy("hash", "last").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds"), F.sum("gain").alias("gain"))


def _commons(slices: DataFrame, told: DataFrame, words: DataFrame, model: Model, places: int) -> tuple[list[Common], DataFrame]:
    """The contexts met at least ``places`` times, a depth at a time, and all answers to the slices."""
    found = words.where(F.col("count") >= places).select("id").toArrow().column("id").to_numpy().astype(np.uint64)
    last = np.append(found, np.uint64(_BEGIN_ID)) if model.ends >= places else found
    last = last[np.argsort(mix(last))]
    keys, commons = mix(last), []
    for depth in range(1, model.max_depth + 1):
        if not len(keys):
            break
        asked = _of_slices(slices, told, replace(model, commons=list(commons)), lambda read, depth=depth, keys=keys: _grams(read, depth, keys), _ASKED)
        told = told.union(cut_lineage(_gram_totals(asked, depth, places)))
        facts = _gram_facts(told.where(F.col("depth") == depth)).toArrow()
        of, after, n, kinds, gain = [facts.column(c).to_numpy() for c in ("hash", "last", "n", "kinds", "gain")]
        new = facts.column("last").is_valid().to_numpy()
        order = of[~new]
        figures = np.zeros((3, len(keys)))
        figures[:, order] = np.stack([n, kinds, gain])[:, ~new]
        total, kinds, gain = figures
        kept = (total >= model.least_count) & (gain - total * np.log(np.maximum(total, 1)) >= model.divergence)
        commons.append(Common(keys, last, total, kinds, kept))
        keys = of[new].astype(np.int64).view(np.uint64)
        last = after[new].astype(np.int64).view(np.uint64)
        keys, last = keys[np.argsort(keys)], last[np.argsort(keys)]
    return commons, told


def _of_slices(slices: DataFrame, told: DataFrame, model: Model, run: Callable[[Read], list[tuple]], schema: str) -> DataFrame:
    """What ``run`` makes of each slice with the answers to it."""

    def read(own: pa.Table, answers: pa.Table) -> pa.Table:
        of = Dictionary(own, answers, model)
        return pa.Table.from_batches([_batch([], schema), *(_batch(run(Read(of, number, texts)), schema) for number, texts in of.pieces())])

    answers = told.where(F.col("kind") == _ANSWER).select("slice", "piece", "depth", "bucket", "data")
    return slices.select("slice", "figures", "texts").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(read, schema)


# ---- subtrees in buckets

_POSTED = "bucket int, slice long, kind int, data binary"
_HEADER, _PLACES = range(2)


_COMMON_ROOT = np.uint64(1 << 63)
_BLOB = (np.uint64, np.uint32, np.uint16, np.uint32, np.uint32, np.uint16, np.int64, np.uint32, np.uint32, np.float32, np.float32, np.uint32)


def _post(read: Read, opened: np.ndarray, asking: np.ndarray | None = None) -> list[tuple]:
    """A slice's places to the buckets of their shortest contexts that are not common, and once its rows with what is known.

    A word opens the lower layer where it ends a retained context; ``opened`` are the common ones that do.
    With ``asking``, only places behind these words are posted, to learn whether such contexts end with them.
    """
    model, place, start = read.model, read.place, read.start
    before = read.number[place - 1]
    common = start > 1
    lower = common & member(opened if asking is None else asking, before)[1]
    value = np.where(lower, read.p, read.by_class)
    go = (lower | ~common if asking is None else lower) & (start <= model.max_depth) & (read.since[place] >= start)
    go[go] = read.met[place[go] - start[go]] >= model.least_count
    go = np.flatnonzero(go)
    # a word's number is the root of its subtree; a longer one, behind common contexts, is a hash
    root = before[go].astype(np.uint64)
    for depth in np.unique(start[go][common[go]]).tolist():
        own = start[go] == depth
        root[own] = read.context(depth, go[own]) | _COMMON_ROOT
    # the words further back, as far as each may be part of a context
    further = np.full((max(model.max_depth - 1, 0), len(go)), _NONE_ID, np.uint32)
    open_ = np.arange(len(go))
    for k in range(model.max_depth - 1):
        length = start[go[open_]] + k + 1
        open_ = open_[(length <= model.max_depth) & (read.since[place[go[open_]]] >= length)]
        back = place[go[open_]] - start[go[open_]] - k - 1
        open_, back = open_[read.met[back] >= model.least_count], back[read.met[back] >= model.least_count]
        further[k, open_] = read.number[back]
    order = np.lexsort((*further[:1], mix(root)))
    root, go, further = root[order], go[order], further[:, order]
    edges = _edges(mix(root), model.buckets)
    at = place[go]
    rows = read.row[at] << np.uint32(1) | read.out[read.row[at]]
    out = []
    if asking is None:
        sums = np.bincount(read.row[place], weights=value, minlength=len(read.n_words))
        header = _packed(read.doc, read.null, read.out, read.n_words, read.known.astype(np.int64), read.base, sums)
        out.append(((read.slice_id >> 16) % model.buckets, read.slice_id + read.piece, _HEADER, header))
    for bucket in np.flatnonzero(np.diff(edges)).tolist():
        own = slice(edges[bucket], edges[bucket + 1])
        here, roots = at[own], root[own]
        new = np.flatnonzero(np.concatenate(([True], roots[1:] != roots[:-1])))
        words, first, index = np.unique(read.number[here], return_index=True, return_inverse=True)
        apart = roots >= _COMMON_ROOT
        data = _packed(
            roots[new],
            np.diff(np.append(new, len(roots))).astype(np.uint32),
            read.symbols[here[new] - 1],
            read.number[here[new] - 1] if asking is not None else np.empty(0, np.uint32),
            np.diff(words, prepend=np.uint32(0)),
            read.symbols[here[first]],
            read.met[here[first]],
            index.reshape(-1).astype(np.uint32),
            further[:, own].reshape(-1),
            read.p[go[own]][apart].astype(np.float32),
            (read.p[go[own]] - value[go[own]]).astype(np.float32),
            rows[own],
        )
        out.append((bucket, read.slice_id + read.piece, _PLACES, data))
    return out


def _subtrees(blobs: list[bytes], model: Model) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The contexts below a bucket's roots learned, and its places scored.

    Each blob's rows; for every place the gain over what its slice has summed; and the last words (where
    posted) of roots below which a context is retained.
    """
    parts = [[] for _ in range(8)]
    first_state = model.tree.state[np.maximum(model.tree.child[0], 0)]
    for data in blobs:
        roots, times, symbol, last, words, of_word, count, index, further, apart, step, rows = _unpacked(data, *_BLOB)
        share = model.shares.log_p(of_word, count)
        p = model.tree.log_p[np.repeat(first_state[symbol], times), of_word[index]] + share[index]
        p[np.repeat(roots >= _COMMON_ROOT, times)] = apart
        for part, column in zip(parts, (roots, times, last, np.cumsum(words, dtype=np.uint32)[index], further.reshape(-1, len(rows)), p, step, rows)):
            part.append(column)
    rows_of = [x >> np.uint32(1) for x in parts[7]]
    train = np.concatenate([x & np.uint32(1) for x in parts.pop()]) == 0
    step, given = np.concatenate(parts.pop()), np.concatenate(parts.pop())
    further, word = np.concatenate(parts.pop(), axis=1), np.concatenate(parts.pop())
    lasts, times, roots = np.concatenate(parts.pop()), np.concatenate(parts.pop()), np.concatenate(parts.pop())
    roots, first, root = np.unique(roots, return_index=True, return_inverse=True)
    root = np.repeat(root.reshape(-1).astype(np.int32), times)
    p, opens = given.copy(), np.zeros(len(roots), bool)
    # subtrees know nothing of each other: some at a time
    size = np.bincount(root, minlength=len(roots))
    turn = ((np.cumsum(size) - size) // (4 * _AT_ONCE)).astype(np.int32)
    turns = turn[root]
    for number in np.unique(turn).tolist():
        own = np.flatnonzero(turns == number)
        p[own], kept = _learned(root[own], word[own], further[:, own], train[own], p[own], model)
        opens[root[own[kept]]] = True
    return rows_of, np.where(opens[root], p - given + step, 0.0), np.unique(lasts[first[opens]]) if len(lasts) else lasts


def _learned(root: np.ndarray, word: np.ndarray, further: np.ndarray, train: np.ndarray, p: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of the word at each place by the retained contexts before it, and the places behind one."""
    kept_places = np.zeros(len(root), bool)
    live, size, shift = np.arange(len(root)), int(root.max()) + 1, 1 << 32
    context = root.astype(np.int64)
    for depth in range(model.max_depth):
        if depth:
            there = further[depth - 1][live] != _NONE_ID
            live, context = live[there], context[there]
            own, context = np.unique(context * shift + further[depth - 1][live], return_inverse=True)
            context, size = context.reshape(-1), len(own)
        n = np.bincount(context[train[live]], minlength=size)
        often = n[context] >= model.least_count
        live, context = live[often], context[often]
        if not len(live):
            break
        gram, which = np.unique(context * shift + word[live], return_inverse=True)
        which, of = which.reshape(-1), gram // shift
        count = np.bincount(which[train[live]], minlength=len(gram))
        inner = np.zeros(len(gram))
        inner[which] = p[live]
        met = count > 0
        kinds = np.bincount(of[met], minlength=size)
        gain = np.bincount(of[met], weights=count[met] * (np.log(count[met] / n[of[met]]) - inner[met] * np.log(10)), minlength=size)
        kept = (n >= model.least_count) & (gain >= model.divergence)
        own = np.log10((count + kinds[of] * 10.0**inner) / (n[of] + kinds[of]))
        p[live] = np.where(kept[of], own, inner)[which]
        kept_places[live[kept[context]]] = True
    return p, kept_places


def _scored(posted: DataFrame, model: Model) -> DataFrame:
    """For each slice its header, and from every bucket sums by row."""

    def run(blobs: pa.Table) -> pa.Table:
        ids, kinds, datas = [blobs.column(c).to_pylist() for c in ("slice", "kind", "data")]
        out = [(s, k, d) for s, k, d in zip(ids, kinds, datas) if k == _HEADER]
        ids = [s for s, k in zip(ids, kinds) if k == _PLACES]
        if ids:
            rows, gain, _ = _subtrees([d for k, d in zip(kinds, datas) if k == _PLACES], model)
            at = 0
            for s, own in zip(ids, rows):
                sums = np.bincount(own, weights=gain[at : at + len(own)])
                at += len(own)
                there = np.flatnonzero(sums)
                if len(there):
                    out.append((s, _PLACES, _packed(there.astype(np.uint32), sums[there])))
        return pa.Table.from_batches([_batch(out, "slice long, kind int, data binary")])

    return posted.groupBy("bucket").applyInArrow(run, "slice long, kind int, data binary")


def _opening(posted: DataFrame, model: Model) -> np.ndarray:
    """The last words of retained contexts in what was posted for asked words; these are common, so few."""

    def run(blobs: pa.Table) -> pa.Table:
        _, _, lasts = _subtrees(blobs.column("data").to_pylist(), model)
        return pa.table({"last": lasts.astype(np.int64)})

    return posted.groupBy("bucket").applyInArrow(run, "last long").distinct().toArrow().column("last").to_numpy().astype(np.uint64)


def _summed(answers: pa.Table) -> pa.Table:
    """One slice: its rows with the sums of all buckets."""
    kinds, datas = answers.column("kind").to_pylist(), answers.column("data").to_pylist()
    doc, null, out, words, known, base, sums = _unpacked(datas[kinds.index(_HEADER)], np.int64, np.uint8, np.uint8, np.int64, np.int64, np.float64, np.float64)
    for kind, data in zip(kinds, datas):
        if kind == _PLACES:
            rows, own = _unpacked(data, np.uint32, np.float64)
            sums[rows] += own
    return pa.table(
        [pa.array(doc, mask=null.astype(bool)), pa.array(out.astype(bool)), *map(pa.array, (words, known, base, sums))],
        names=["doc_id", "held_out", "n_words", "n_known", "base", "log_p"],
    )


def score_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_depth: int = MAX_DEPTH, symbol_share: float = SYMBOL_SHARE, context_share: float = CONTEXT_SHARE, divergence: float = DIVERGENCE, least_count: int = LEAST_COUNT, buckets: int | None = None, bucket_places: int = BUCKET_PLACES
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the add-one unigram log10 probability, ``score`` that of the suffix tree,
    in which all words of one symbol that were not met in training are one event.
    A null or empty text is just the end. Repeated rows are counted and scored each. Ids are
    integers or null. Without training texts all symbols are equally likely.
    ``buckets``: unless given, the shuffle partitions of the session, or as many as hold ``bucket_places`` places
    each on average if that is more; a context met four times as often is counted apart. Results do not depend on either.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), held_out(F.col(doc_id)).alias("held_out"))
    slices = cut_lineage(tokenised(picked))
    facts = slices.agg(F.sum("tokens").alias("tokens"), F.sum("ends").alias("ends")).first()
    tokens, ends = facts["tokens"] or 0, facts["ends"] or 0
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // bucket_places))
    told = cut_lineage(word_totals(slices, buckets))
    words = _words_of(told)
    below = tokens + words.where("count > 0").count() + (1 if ends else 0) + 1
    alphabet = alphabet_of(words, tokens, symbol_share)
    tree = learn_tree(slices.select("words", "figures", "texts"), alphabet, max_depth=max_depth, share=context_share, divergence=divergence)
    frequent = words.where(F.col("count") >= max(2.0, symbol_share * tokens)).select("hash", "id").toArrow()
    ids = frequent.column("id").to_numpy().astype(np.uint32)
    symbols, _ = member(alphabet.words, frequent.column("hash").to_numpy().astype(np.int64).view(np.uint64))
    order = np.argsort(ids)
    model = Model(alphabet, np.stack((ids[order], symbols[order].astype(np.uint32))), tree, shares_of(told.where(F.col("kind") == _FACTS).select("data"), alphabet), [], ends, below, buckets, max_depth, least_count, divergence)
    commons, told = _commons(slices, told, words, model, _COMMON * bucket_places)
    model = replace(model, commons=commons or None)
    opened = np.unique(np.concatenate([np.empty(0, np.uint64), *(c.last[c.kept] for c in commons)]))
    asking = np.setdiff1d(commons[0].last, opened) if commons else opened
    if len(asking):
        opened = np.union1d(opened, _opening(_of_slices(slices, told, model, lambda read: _post(read, opened, asking), _POSTED), model))
    posted = _of_slices(slices, told, model, lambda read: _post(read, opened), _POSTED)
    summed = _scored(posted, model).groupBy("slice").applyInArrow(_summed, "doc_id long, held_out boolean, n_words long, n_known long, base double, log_p double")
    return summed.select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + (1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10((ends + 1) / below))).alias("base_score"),
        F.col("log_p").alias("score"),
    )
