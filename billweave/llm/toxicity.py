"""Toxicity by a learned lexicon, misspellings included, scored in context windows.

Learning (labels of the training fold only, at most about ``SAMPLE_ROWS`` of them): words and
word stems whose document counts tell toxic from clean documents make the lexicon; how much
a misspelled or quoted hit counts is learned from documents that have only such hits.
Scoring: a word is matched by running its Levenshtein automaton along the lexicon's trie,
so each distinct word walks only the branches within the allowed distance. Hits add up inside a
window of ``WINDOW`` words, quoted ones with less weight, and the highest window becomes a
probability by a two-parameter logistic curve.

The lexicon is at most ``MAX_TERMS`` entries, so it travels to tasks by value; documents are
scored where they are read, without a shuffle.
"""

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.llm.text import LOWER, Slice, text_slices, word_hashes, word_spans
from billweave.session import cut_lineage

SAMPLE_ROWS = 20_000
MAX_TERMS = 2_000
WINDOW = 12
THRESHOLD = 0.7
FOLDS, HELD_OUT_FOLD = 3, 1
STEM_LENGTHS = (4, 5, 6)
STEM_CONTINUATIONS = 5
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_EVIDENCE, LEAST_STEM_EVIDENCE = 5, 0.01, 2.5, 1.5
HIGHEST_WEIGHT = 6.0
UNSEEN_MISSPELLING, UNSEEN_QUOTED = 0.6, 0.5

_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}
_CLOSING = {a.encode(): b.encode() for a, b in _QUOTES.items()}
_MARKS = re.compile(b"|".join([b"\n", *sorted({*_CLOSING, *_CLOSING.values()})]))


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never read; a null id is in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


# ---- lexicon trie and Levenshtein automata


def allowed_distance(length: int, stem: bool) -> int:
    if stem:
        return 1 if length >= 6 else 0
    return 0 if length < 5 else 1 if length < 9 else 2


@dataclass
class Term:
    text: str
    stem: bool
    weight: float
    misspelled: float = 0.0


class Trie:
    """Nodes as dictionaries; a node lists the terms that end there.

    ``pieces`` keeps the walks few: k edits leave one of k + 1 pieces of a term whole, moved by
    k places at most, so a word can only be near the terms of which it has a piece.
    """

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.paths: list[list[int]] = []
        self.pieces: dict[tuple[int, int], dict[str, list[int]]] = {}
        for number, term in enumerate(terms):
            node, path = 0, []
            for letter in term.text:
                node = self.children[node].setdefault(letter, len(self.children))
                if node == len(self.ends):
                    self.children.append({})
                    self.ends.append([])
                path.append(node)
            self.ends[node].append(number)
            self.paths.append(path)
            k = allowed_distance(len(term.text), term.stem)
            size = len(term.text) // (k + 1)
            for n in range(k + 1):
                piece = term.text[n * size : (n + 1) * size if n < k else None]
                for at in {max(0, n * size + shift) for shift in (range(-k, k + 1) if n else (0,))}:
                    self.pieces.setdefault((at, at + len(piece)), {}).setdefault(piece, []).append(number)

    def near(self, word: str) -> set[int]:
        """Terms of which the word has a piece where it could be; every term within its distance is among them."""
        out = set()
        for (a, b), known in self.pieces.items():
            for number in known.get(word[a:b], ()):
                term = self.terms[number]
                if term.stem or abs(len(term.text) - len(word)) <= allowed_distance(len(term.text), False):
                    out.add(number)
        return out

    def matches(self, word: str) -> list[tuple[int, int]]:
        """(term, distance) of every term within its distance of the word, or of a beginning of it for stems.

        The word's Levenshtein automaton runs along the trie's branches: its state holds, for
        places of the word that are in reach, the fewest edits that lead there.
        """
        wanted = self.near(word)
        if not wanted:
            return []
        branches = {node for number in wanted for node in self.paths[number]}
        k = max(allowed_distance(len(self.terms[number].text), self.terms[number].stem) for number in wanted)
        n, found = len(word), []
        stack = [(0, {i: i for i in range(min(n, k) + 1)})]
        while stack:
            node, state = stack.pop()
            for number in self.ends[node]:
                term = self.terms[number]
                reached = min(state.values()) if term.stem else state.get(n, k + 1)
                if number in wanted and reached <= allowed_distance(len(term.text), term.stem):
                    found.append((number, reached))
            for letter, child in self.children[node].items():
                if child not in branches:
                    continue
                new: dict[int, int] = {}
                for i in range(min(state), min(n, max(state) + 1 + k) + 1):
                    best = state.get(i, k) + 1
                    if i and i - 1 in state:
                        best = min(best, state[i - 1] + (word[i - 1] != letter))
                    if i - 1 in new:
                        best = min(best, new[i - 1] + 1)
                    if best <= k:
                        new[i] = best
                if new:
                    stack.append((child, new))
        return found


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    quoted: float = UNSEEN_QUOTED
    intercept: float = 0.0
    slope: float = 0.0
    window: int = WINDOW


class Matcher:
    """Best (term, distance) of a word, remembered by the word's hash; forgets all at ``limit``."""

    def __init__(self, terms: list[Term], limit: int = 1_000_000):
        self.terms, self.trie, self.limit = terms, Trie(terms), limit
        self.known: dict[int, tuple[int, int] | None] = {}

    def best(self, hashes: np.ndarray, words: list[bytes]) -> list[tuple[int, int] | None]:
        if len(self.known) > self.limit:
            self.known.clear()
        out = []
        for h, raw in zip(hashes.tolist(), words):
            if h not in self.known:
                word = raw.decode(errors="replace").lower()
                found = self.trie.matches(word)
                self.known[h] = min(found, key=lambda f: (f[1], -self.terms[f[0]].weight, f[0]), default=None)
            out.append(self.known[h])
        return out


def _distinct_words(part: Slice):
    """Words of a slice, A-Z lowered: row starts, hash-sorted distinct words, and each word's place among them."""
    data = LOWER[part.data]
    starts, ends, at = word_spans(data, part.offsets, _IN_WORD)
    hashes = word_hashes(data, starts, ends)
    keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = bytes(data)
    return starts, ends, at, keys, [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], which.reshape(-1)


def quotations(text: bytes) -> tuple[list[int], list[int]]:
    """Where quotations begin (behind the opening mark) and end (at its closing one); a mark that is not closed on its line opens none."""
    begins, ends, closing, begin = [], [], None, 0
    for mark in _MARKS.finditer(text):
        if mark[0] == b"\n":
            closing = None
        elif closing is None:
            closing, begin = _CLOSING.get(mark[0]), mark.end()
        elif mark[0] == closing:
            begins.append(begin)
            ends.append(mark.start())
            closing = None
    return begins, ends


def hits_of(part: Slice, matcher: Matcher) -> list[list[tuple[int, int, int, bool]]]:
    """For each row its hits: word number, term, distance, quoted."""
    starts, ends, at, keys, words, which = _distinct_words(part)
    rows: list[list] = [[] for _ in range(len(part.null))]
    if not len(keys):
        return rows
    best = matcher.best(keys, words)
    is_hit = np.array([b is not None for b in best])[which]
    of_row, begins, ends_at = -1, [], []
    for w in np.flatnonzero(is_hit).tolist():
        row = int(np.searchsorted(at, w, "right")) - 1
        if row != of_row:
            of_row, (begins, ends_at) = row, quotations(part.data[part.offsets[row] : part.offsets[row + 1]].tobytes())
        term, distance = best[which[w]]
        start = int(starts[w] - part.offsets[row])
        span = bisect_right(begins, start) - 1
        rows[row].append((w - int(at[row]), term, distance, span >= 0 and start <= ends_at[span]))
    return rows


def window_score(hits: list[tuple[int, int, int, bool]], model: Model) -> float:
    """The highest sum of hit weights within a window of words."""
    weights = []
    for _, term, distance, quoted in hits:
        t = model.terms[term]
        weights.append((t.weight if distance == 0 else t.misspelled) * (model.quoted if quoted else 1.0))
    best, total, left = 0.0, 0.0, 0
    for right, hit in enumerate(hits):
        total += weights[right]
        while hit[0] - hits[left][0] >= model.window:
            total -= weights[left]
            left += 1
        best = max(best, total)
    return best


# ---- learning


def _evidence(toxic: float, clean: float, all_toxic: float, all_clean: float) -> tuple[float, float]:
    """Log ratio of the document shares, and the same less 1.5 standard errors."""
    ratio = math.log(((toxic + 0.5) / (all_toxic + 1)) / ((clean + 0.5) / (all_clean + 1)))
    return ratio, ratio - 1.5 * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, toxic of about ``sample_rows`` labelled documents of the training folds, chosen by a hash of the id.

    Of several labels of a document the highest counts; a null label is none. The ids are
    few by construction, so they are broadcast and no text is shuffled.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total = known.count()
    if total > sample_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(total)) < sample_rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")


def _word_counts(sample: DataFrame) -> DataFrame:
    """term, toxic and clean: in how many documents each word stands; counted in the task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            _, _, at, _, words, which = _distinct_words(part)
            toxic = part.rows.column("toxic").to_numpy().astype(bool)
            # once a document: distinct (row, word) pairs
            row = np.repeat(np.arange(len(toxic)), np.diff(at))
            pair = np.unique(row * max(1, len(words)) + which)
            word, label = pair % max(1, len(words)), toxic[pair // max(1, len(words))]
            numbers = [np.bincount(word[label == side], minlength=len(words)) for side in (True, False)]
            texts = [w.decode(errors="replace").lower() for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *[pa.array(n.astype(np.int64)) for n in numbers]], names=["term", "toxic", "clean"])

    counted = sample.mapInArrow(count, "term string, toxic long, clean long").where(F.length("term").between(3, 30))
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _contexts(sample: DataFrame, words: list[str]) -> dict[str, int]:
    """Behind how many different words each of a few words stands in toxic documents: copies of one text count once."""
    wanted = {w.encode(): w for w in words}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            _, _, at, keys, distinct, which = _distinct_words(part)
            chosen = np.array([w.decode(errors="replace").lower().encode() in wanted for w in distinct], bool)
            toxic = np.repeat(part.rows.column("toxic").to_numpy().astype(bool), np.diff(at))
            place = np.flatnonzero(chosen[which] & toxic) if len(keys) else np.empty(0, np.int64)
            before = np.where(np.isin(place, at), np.uint64(0), keys[which[np.maximum(place - 1, 0)]]) if len(place) else np.empty(0, np.uint64)
            found = {(distinct[which[p]].decode(errors="replace").lower(), b) for p, b in zip(place.tolist(), before.astype(np.int64).tolist())}
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([b for _, b in found], pa.int64())], names=["term", "before"])

    met = sample.mapInArrow(pairs, "term string, before long").groupBy("term").agg(F.countDistinct("before").alias("n"))
    return {r["term"]: r["n"] for r in met.collect()}


def learn_lexicon(sample: DataFrame) -> list[Term]:
    """Words and stems with enough evidence, a lower bound of their log ratio; at most ``MAX_TERMS`` of each.

    A word's evidence counts documents, but no more toxic ones than it has different words
    before it. A stem's evidence counts the different words that begin with it.
    """
    seen = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not seen.get(1) or not seen.get(0):
        return []
    counts = cut_lineage(_word_counts(sample))

    def strongest(table: DataFrame, all_toxic: int, all_clean: int, least: float, evidence: float) -> list:
        share = lambda c, n: (F.col(c) + 0.5) / F.lit(n + 1.0)
        lower = F.log(share("toxic", all_toxic) / share("clean", all_clean)) - 1.5 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
        good = table.where(F.col("toxic") >= least).withColumn("lower", lower).where(F.col("lower") >= evidence)
        return good.orderBy(F.desc("lower"), "term").limit(MAX_TERMS).collect()

    types = counts.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("clean") > 0).alias("clean")).first()
    heads = counts.select(F.explode(F.array(*[F.when(F.length("term") >= n, F.left("term", F.lit(n))) for n in STEM_LENGTHS])).alias("stem"), "toxic", "clean")
    by_stem = heads.where("stem is not null").groupBy(F.col("stem").alias("term")).agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("clean") > 0).alias("clean"), F.sum("toxic").alias("_met"))
    by_stem = by_stem.where(F.col("_met") >= max(LEAST_DOCUMENTS, LEAST_SHARE * seen[1]))
    stems = {r["term"]: r for r in strongest(by_stem, types["toxic"], types["clean"], STEM_CONTINUATIONS, LEAST_STEM_EVIDENCE)}
    # a longer stem with nearly as many words says the same more precisely; of what is left the shorter covers the longer
    stems = {s: r for s, r in stems.items() if not any(t != s and t.startswith(s) and q["toxic"] >= 0.9 * r["toxic"] for t, q in stems.items())}
    stems = {s: r for s, r in stems.items() if not any(t != s and s.startswith(t) for t in stems)}
    words = strongest(counts, seen[1], seen[0], max(LEAST_DOCUMENTS, LEAST_SHARE * seen[1]), LEAST_EVIDENCE)
    words = [r for r in words if not any(r["term"].startswith(s) for s in stems)]
    contexts = _contexts(sample, [r["term"] for r in words]) if words else {}
    out = [Term(s, True, min(HIGHEST_WEIGHT, _evidence(r["toxic"], r["clean"], types["toxic"], types["clean"])[0])) for s, r in stems.items()]
    for r in words:
        independent = min(r["toxic"], contexts.get(r["term"], 0))
        ratio, lower = _evidence(independent, r["clean"], seen[1], seen[0])
        if independent >= max(LEAST_DOCUMENTS, LEAST_SHARE * seen[1]) and lower >= LEAST_EVIDENCE:
            out.append(Term(r["term"], False, min(HIGHEST_WEIGHT, ratio)))
    return sorted(out, key=lambda t: (not t.stem, t.text))


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, window: int = WINDOW) -> Model:
    """Fit the model. Without labels of both kinds the lexicon is empty and every score is the same."""
    sample = cut_lineage(training_sample(docs, labels, sample_rows))
    model = Model(learn_lexicon(sample), window=window)
    seen = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = seen.get(1, 0), seen.get(0, 0)
    if model.terms:
        terms = model.terms

        def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Documents without a plain hit: which terms were met misspelled, which hits were only quoted."""
            matcher = Matcher(terms)
            for part in text_slices(batches, "text"):
                out = []
                for hits, label in zip(hits_of(part, matcher), part.rows.column("toxic").to_pylist()):
                    if hits and all(h[2] > 0 for h in hits):
                        out += [(h, label) for h in {h[1] for h in hits}]
                    elif hits and all(h[3] or h[2] > 0 for h in hits):
                        out.append((-1, label))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["term", "toxic"])

        met = {(r["term"], r["toxic"]): r["count"] for r in sample.mapInArrow(evidence, "term long, toxic long").groupBy("term", "toxic").count().collect()}
        for number, term in enumerate(terms):
            a, b = met.get((number, 1), 0), met.get((number, 0), 0)
            ratio = _evidence(a, b, toxic, clean)[0] if a + b else UNSEEN_MISSPELLING * term.weight
            term.misspelled = max(0.0, min(ratio, UNSEEN_MISSPELLING * term.weight))
        a, b = met.get((-1, 1), 0), met.get((-1, 0), 0)
        if a + b >= 10:
            model.quoted = max(0.05, min(1.0, _evidence(a, b, toxic, clean)[0] / HIGHEST_WEIGHT))
    model.intercept, model.slope = _calibrate(_raw_counts(sample, model))
    return model


def _raw_counts(sample: DataFrame, model: Model) -> list[tuple[float, int, int]]:
    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for part in text_slices(batches, "text"):
            # quarters up to a bound: few distinct values, however many documents
            value = [min(40.0, round(4 * window_score(h, model)) / 4) for h in hits_of(part, matcher)]
            yield pa.RecordBatch.from_arrays([pa.array(value, pa.float64()), part.rows.column("toxic").cast(pa.int64())], names=["raw", "toxic"])

    return [(r["raw"], r["toxic"], r["count"]) for r in sample.mapInArrow(raw, "raw double, toxic long").groupBy("raw", "toxic").count().collect()]


def _calibrate(counts: list[tuple[float, int, int]]) -> tuple[float, float]:
    """A logistic curve over the raw score by Newton steps; a small penalty keeps separable data finite."""
    x = np.array([c[0] for c in counts], float)
    y = np.array([c[1] for c in counts], float)
    n = np.array([c[2] for c in counts], float)
    if not len(x):
        return 0.0, 0.0
    theta = np.zeros(2)
    design = np.stack((np.ones_like(x), x), axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 0.05 * theta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(max(0.0, theta[1]))


# ---- scoring


def _scored(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """The documents' columns by number (c0, c1, ...), whatever they are called, with score (0 to 1) and n_hits; a null text is an empty one."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    numbered, body = docs.toDF(*names), names[docs.columns.index(text)]
    schema = numbered.withColumns({"score": F.lit(0.0), "n_hits": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for part in text_slices(batches, body):
            hits = hits_of(part, matcher)
            score = [1 / (1 + math.exp(-max(-30.0, min(30.0, model.intercept + model.slope * window_score(h, model))))) for h in hits]
            added = [pa.array(score, pa.float64()), pa.array([len(h) for h in hits], pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.rows.columns, *added], names=[*names, "score", "n_hits"])

    return numbered.mapInArrow(run, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_hits. Repeated rows are scored each."""
    model = learn(docs, labels, sample_rows=sample_rows)
    scored = _scored(docs.select("doc_id", "text"), model, "text").withColumnRenamed("c0", "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that score below the threshold, unchanged."""
    model = learn(docs, labels, sample_rows=sample_rows)
    return _scored(docs, model, "text").where(F.col("score") < threshold).drop("score", "n_hits").toDF(*docs.columns)
