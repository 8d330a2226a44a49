"""Packing of token sequences under several limits at once.

Vector bin packing with the dot-product heuristic: the open sequence has room left in
tokens, segments and loss-bearing tokens; of the waiting examples that fit in every limit, the
one with the largest product of its demand and that room goes in. When nothing fits whole,
the example with the largest product is cut to what is left, and its rest waits on. Each
sequence begins with the example that has waited longest, so small ones do not pile up.

A task packs its own rows (at most ``pool`` wait at a time) and leaves at most a few
sequences unfilled, so there is no shuffle and no group that grows with the data.

Loss-bearing tokens of an example are its last ones, as the answer of an instruction is.
"""

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.text import Rolling, mix, ranges, text_slices

MAX_TOKENS = 4096
MAX_SEGMENTS = 256
POOL = 512
END_ID = 2
TOKENIZER = "word_bpe_49k.json"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"

# ---- words of a lower-case BPE tokenizer, each encoded once a task

_KNOWN = 0x180
_OTHER, _SPACE, _LETTER, _DIGIT, _UNSAFE = range(5)


@functools.cache
def _character_classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of the characters whose normal form is plain; any other sends its text the long way."""
    import unicodedata

    kind = np.full(_KNOWN, _OTHER, np.uint8)
    lower = np.arange(_KNOWN, dtype=np.uint32)
    for c in range(_KNOWN):
        name, small = unicodedata.category(chr(c)), chr(c).lower()
        if chr(c) in " \t\n\r":
            kind[c] = _SPACE
        elif name[0] in "CZ" or len(small) != 1 or ord(small) >= _KNOWN or c in (0x149, 0x17F):
            kind[c] = _UNSAFE
        elif name[0] in "LN":
            kind[c] = _LETTER if name[0] == "L" else _DIGIT
        if len(small) == 1:
            lower[c] = ord(small)
    return kind, lower


class WordTokenizer:
    """Token ids equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Words never touch each other in this kind of tokenizer (white space is dropped), so each
    distinct word is encoded once. Texts with characters outside the plain Latin ranges, or
    with a marker of special tokens, are encoded whole by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        spec["normalizer"] = None
        spec["added_tokens"] = []
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.words = Tokenizer.from_str(json.dumps(spec))
        suffix = spec["model"]["end_of_word_suffix"]
        self.closes = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.closes[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.place = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the rows' offsets in them."""
        n = len(offsets) - 1
        points = np.frombuffer(bytes(data).decode().encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        kinds, lower = _character_classes()
        small = points < _KNOWN
        kind = np.where(small, kinds[np.minimum(points, _KNOWN - 1)], _UNSAFE)
        odd = kind == _UNSAFE
        odd[:-1] |= (points[:-1] == 60) & (points[1:] == 124)
        unsafe = np.diff(np.concatenate(([0], np.cumsum(odd)))[at]) > 0
        points = lower[np.minimum(points, _KNOWN - 1)]
        if unsafe.any():
            kind = np.where(np.repeat(unsafe, np.diff(at)), _SPACE, kind)
        starts, ends = self._words(points, kind, at)
        ids, bounds = self._encode_words(points, starts, ends)
        row_at = bounds[np.searchsorted(starts, at)]
        if not unsafe.any():
            return ids, row_at
        parts = [ids[row_at[i] : row_at[i + 1]] for i in range(n)]
        for i in np.flatnonzero(unsafe):
            text = bytes(data[offsets[i] : offsets[i + 1]]).decode()
            parts[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    @staticmethod
    def _words(points: np.ndarray, kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters, single digits, runs of anything else but space; 's and its like are words of their own."""
        if not len(points):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        begins = np.empty(len(points), bool)
        begins[0] = True
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins[at[:-1][at[:-1] < len(points)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(points))
        word = kind[starts] != _SPACE
        starts, ends = starts[word], ends[word]
        quote = np.flatnonzero((points[starts[:-1]] == 39) & (ends[:-1] - starts[:-1] == 1) & (starts[1:] == ends[:-1]) & (kind[starts[1:]] == _LETTER))
        if len(quote):
            quote = quote[~np.isin(starts[quote + 1], at)]
        if len(quote):
            a = points[starts[quote + 1]]
            b = np.where(ends[quote + 1] - starts[quote + 1] > 1, points[np.minimum(starts[quote + 1] + 1, len(points) - 1)], 0)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            taken = np.where(one, 1, np.where(two, 2, 0))
            ends[quote] += taken
            starts[quote + 1] += taken
            word = starts < ends
            starts, ends = starts[word], ends[word]
        return starts, ends

    def _encode_words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        hashes = Rolling(mix(points.astype(np.uint64) + np.uint64(0x51ED27))).of(starts, ends)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        new = np.append(self.keys, np.uint64(0))[np.minimum(place, len(self.keys))] != keys
        new |= place == len(self.keys)
        if new.any():
            if len(self.ids) > 8_000_000:  # bounded memory: forget and begin anew
                self.clear()
                new[:] = True
            fresh = first[new]
            spaced = np.append(points, np.uint32(32))
            where = ranges(starts[fresh], ends[fresh] + 1)
            gaps = np.cumsum(ends[fresh] - starts[fresh] + 1) - 1
            where[gaps] = len(points)
            text = spaced[where].astype("<u4").tobytes().decode("utf-32-le")
            ids = np.array(self.words.encode(text, add_special_tokens=False).ids, np.uint32)
            bounds = np.flatnonzero(self.closes[ids]) + 1
            if len(bounds) != len(fresh):
                raise ValueError("words and word ends of the tokenizer differ")
            number = len(self.bounds) - 1 + np.arange(len(fresh))
            self.bounds = np.concatenate((self.bounds, bounds + len(self.ids)))
            self.ids = np.concatenate((self.ids, ids))
            merged = np.concatenate((self.keys, keys[new]))
            order = np.argsort(merged, kind="stable")
            self.place = np.concatenate((self.place, number))[order]
            self.keys = merged[order]
            place = np.searchsorted(self.keys, keys)
        number = self.place[place][which.reshape(-1)]
        a, b = self.bounds[number], self.bounds[number + 1]
        return self.ids[ranges(a, b)], np.concatenate(([0], np.cumsum(b - a)))


# ---- packing


class Packer:
    """Packs examples as they come; ``pieces`` yields what is placed, a closed sequence at a time."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, pool: int):
        self.limit = np.array([max_tokens, max_segments, max_loss], float)
        self.pool, self.waiting, self.examples = pool, 0, []
        self.demand = np.zeros((pool, 3))
        self.room, self.placed = self.limit.copy(), []

    def add(self, example, tokens: int, loss: int) -> Iterator[list]:
        """``loss`` of the ``tokens`` bear loss, the last ones. Yields closed sequences of (example, start, length, loss)."""
        while self.waiting == self.pool:
            yield from self.advance()
        self.demand[self.waiting] = tokens, 1, loss
        self.examples.append([example, 0, tokens, loss])
        self.waiting += 1

    def finish(self) -> Iterator[list]:
        while self.waiting:
            yield from self.advance()
        if self.placed:
            yield self._close()

    def _close(self) -> list:
        placed, self.room, self.placed = self.placed, self.limit.copy(), []
        return placed

    def _place(self, k: int, count: int, room: np.ndarray) -> tuple:
        """Put the next ``count`` tokens of a waiting example into the open sequence."""
        example, start, tokens, loss = self.examples[k]
        bearing = max(0, count - (tokens - loss))
        room -= (count, 1, bearing)
        if count == tokens:
            del self.examples[k]
            self.demand[k : self.waiting - 1] = self.demand[k + 1 : self.waiting]
            self.waiting -= 1
        else:
            self.examples[k] = [example, start + count, tokens - count, loss - bearing]
            self.demand[k] = tokens - count, 1, loss - bearing
        return example, start, count, bearing

    def advance(self) -> Iterator[list]:
        """Place one waiting example, or what fits of it; close the sequence where nothing more goes in."""
        demand = self.demand[: self.waiting]
        if self.placed:
            fits = (demand <= self.room).all(axis=1)
            product = (demand / self.limit) @ (self.room / self.limit)
            k = int((np.where(fits, product, -1.0) if fits.any() else product).argmax())
        else:
            k = 0  # the one that has waited longest
        count = self._room_for(k)
        if count < 1:  # its next token bears loss and no more of those go in: one whose next tokens bear none
            free = np.flatnonzero(demand[:, 0] - demand[:, 2] >= 1)
            if not len(free):
                yield self._close()
                return
            k = int(free[0])
            count = self._room_for(k)
        self.placed.append(self._place(k, count, self.room))
        if self.room[0] < 1 or self.room[1] < 1:
            yield self._close()

    def _room_for(self, k: int) -> int:
        tokens, loss = self.examples[k][2:]
        return int(min(tokens, self.room[0], tokens - loss + self.room[2]))


def _rows(packed: Iterator[list], part: int, flush: int = 2000) -> Iterator[pa.RecordBatch]:
    columns: list[list] = [[] for _ in range(8)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    sequence = part << 32
    for placed in packed:
        offset = 0
        for (doc, ids), start, count, bearing in placed:
            crc = zlib.crc32(ids[start : start + count].astype("<u4").tobytes())
            for column, value in zip(columns, (doc, start, count, crc, len(ids), sequence, offset, bearing)):
                column.append(value)
            offset += count
        sequence += 1
        if len(columns[0]) >= flush:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
            columns = [[] for _ in range(8)]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack_examples(examples: DataFrame, *, doc_id: str = "doc_id", ids: str = "ids", loss_tokens: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, pool: int = POOL) -> DataFrame:
    """Pieces of token sequences that are already there; ``loss_tokens`` (null: all) counts from the end.

    An example without tokens, or null, has no piece. Ids may repeat or be null.
    """
    picked = examples.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids"), (F.col(loss_tokens).cast("long") if loss_tokens else F.lit(None).cast("long")).alias("loss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(max_tokens, max_segments, max_loss or max_tokens, pool)

        def packed():
            for batch in batches:
                for doc, own, loss in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("loss").to_pylist()):
                    if own.is_valid and len(own):
                        n = len(own)
                        yield from packer.add((doc, own.values.to_numpy(zero_copy_only=False)), n, n if loss is None else max(0, min(n, loss)))
            yield from packer.finish()

        yield from _rows(packed(), TaskContext.get().partitionId())

    return picked.mapInArrow(run, SCHEMA)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, pool: int = POOL) -> DataFrame:
    """Pieces of all documents: text to ids, then the end id; every token bears loss.

    One row per piece: where it starts in its document, its length and checksum, and the
    sequence and offset it lies at. A null text is an empty one (just the end id). Repeated
    rows are packed each. Other columns play no part. Long documents are cut into as many
    pieces as it takes.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        packer = Packer(max_tokens, max_segments, max_loss or max_tokens, pool)

        def packed():
            for part in text_slices(batches, "text", 4 << 20):
                ids, at = tokenizer.encode(part.data, part.offsets)
                for i, doc in enumerate(part.rows.column("doc_id").to_pylist()):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id))
                    yield from packer.add((doc, own), len(own), len(own))
            yield from packer.finish()

        yield from _rows(packed(), TaskContext.get().partitionId())

    return picked.mapInArrow(run, SCHEMA)
