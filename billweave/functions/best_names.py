"""The options a name may have among its best, out of a block of options, without scoring every pair.

A pair's words and letters bound its score from above. The most promising options of a name are scored first; what the
k-th best of them reaches is what all others have to be able to reach. Bounds are taken for a whole block at once, exact
scores for what is left only, so the result holds every option with a score of the k-th best or more.
"""

import numpy as np
import pyarrow as pa

from billweave import fixed
from billweave.functions.names import _jaro_winkler_many

_FIRST = 12
_NAMES_AT_ONCE = 64
# letters and digits are counted apart, the blank and anything else as one more
_KINDS = 37
_KIND = np.full(129, _KINDS - 1)
_KIND[ord("a") : ord("z") + 1] = np.arange(26)
_KIND[ord("0") : ord("9") + 1] = np.arange(26, 36)
#: scores are rounded to four decimals, so this much below a score may still come out as it
_ROUNDING = 6e-5


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each name its length, how often it has each kind of letter, and its first letters."""
    codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(n) for n in names], np.int64)
    rows = np.repeat(np.arange(len(names)), sizes)
    counts = np.bincount(rows * _KINDS + _KIND[np.minimum(codes, 128)], minlength=len(names) * _KINDS).reshape(-1, _KINDS)
    first = np.zeros((len(names), fixed.WINKLER_PREFIX), np.uint32)
    starts = np.cumsum(sizes) - sizes
    for i in range(fixed.WINKLER_PREFIX):
        has = sizes > i
        first[has, i] = codes[starts[has] + i]
    return sizes, counts.astype(np.int32), first


class Options:
    """A block of distinct option names with the places of their words."""

    def __init__(self, names: list[str], words: pa.ListArray):
        self.names = names
        self.sizes, self.counts, self.first = _letters(names)
        lists = words.to_pylist()
        self.words = lists
        self.n_words = np.array([len(w) for w in lists], np.int64)
        ids: dict[str, int] = {}
        flat = np.array([ids.setdefault(w, len(ids)) for own in lists for w in own], np.int64)
        rows = np.repeat(np.arange(len(lists)), self.n_words)
        order = np.argsort(flat, kind="stable")
        self.rows, self.ids = rows[order], ids
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(flat, minlength=len(ids)))))

    def reach(self, weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """The options that have one of these words, and the sum of their words' weights."""
        total = np.zeros(len(self.names))
        for word, weight in weights.items():
            at = self.ids.get(word)
            if at is not None:  # a name has a word once, so no row is named twice here
                total[self.rows[self.starts[at] : self.starts[at + 1]]] += weight
        found = np.flatnonzero(total)
        return found, total[found]


def _blend(words: np.ndarray, letters: np.ndarray) -> np.ndarray:
    return np.clip(fixed.TOKEN_WEIGHT * words + fixed.CHARACTER_WEIGHT * letters, 0.0, 1.0)


class _Name:
    """One asked name: its options with an upper bound of the score, the rounded scores of those that were scored."""

    def __init__(self, name, words, near, options):
        self.name, self.n_words, self.options = name, len(words), options
        # heaviest first; of equally heavy pairs the one whose two texts, sorted, come first
        self.near = sorted((-p["weight"], min(p["word"], p["similar"]), max(p["word"], p["similar"]), p["word"], p["similar"]) for p in near)
        weights: dict[str, float] = {}
        for p in near:
            weights[p["similar"]] = max(weights.get(p["similar"], 0.0), p["weight"])
        self.rows, total = options.reach(weights)
        # two words each weigh at most what the heavier would alone, and a word is in one pair only
        no = options.n_words[self.rows]
        self.overlap = 2 * np.minimum(total, np.minimum(self.n_words, no)) / (self.n_words + no)
        size, self.counts, first = _letters([name])
        self.size, lo = size[0], options.sizes[self.rows]
        same = (options.first[self.rows] == first[0]) & (np.arange(fixed.WINKLER_PREFIX)[None, :] < np.minimum(lo, self.size)[:, None])
        self.prefix = np.cumprod(same, axis=1).sum(axis=1)
        self.bound = _blend(self.overlap, self._letters_at_most(np.minimum(lo, self.size), lo, self.prefix))
        self.scored: dict[int, float] = {}

    def _letters_at_most(self, common, lo, prefix):
        jaro = (common / self.size + common / lo + 1) / 3
        return jaro + prefix * fixed.WINKLER_SCALE * (1 - jaro)

    def promising(self) -> np.ndarray:
        able = np.flatnonzero(self.bound >= fixed.CANDIDATE_FLOOR - _ROUNDING)
        return able if len(able) <= _FIRST else able[np.argpartition(-self.bound[able], _FIRST)[:_FIRST]]

    def needed(self, k: int) -> float:
        best = sorted(self.scored.values(), reverse=True)
        return max(fixed.CANDIDATE_FLOOR, best[k - 1]) if len(best) >= k else fixed.CANDIDATE_FLOOR

    def left(self, needed: float) -> np.ndarray:
        """What can still reach it, looked at closer: by the letters both have, whatever their order."""
        able = np.flatnonzero(self.bound >= needed - _ROUNDING)
        able = able[[int(i) not in self.scored for i in able]] if len(able) else able
        rows = self.rows[able]
        common = np.minimum(self.options.counts[rows], self.counts[0]).sum(axis=1)
        letters = self._letters_at_most(common, self.options.sizes[rows], self.prefix[able])
        return able[_blend(self.overlap[able], letters) >= needed - _ROUNDING]

    def words_at(self, i: int) -> float:
        """The exact word overlap: pairs are made heaviest first, each word once."""
        own, mine, theirs, total = set(self.options.words[self.rows[i]]), set(), set(), 0.0
        for order, _, _, word, similar in self.near:
            if similar in own and word not in mine and similar not in theirs:
                total -= order
                mine.add(word)
                theirs.add(similar)
        return 2.0 * total / (self.n_words + len(own))


def _score(names: list[_Name], chosen: list[np.ndarray]) -> None:
    pairs = [(n, int(i), n.options.names[n.rows[i]]) for n, some in zip(names, chosen) for i in some]
    if not pairs:
        return
    words = np.array([n.words_at(i) for n, i, _ in pairs])
    score = _blend(words, _jaro_winkler_many([n.name for n, _, _ in pairs], [option for _, _, option in pairs]))
    rounded = np.floor(np.where([n.name == option for n, _, option in pairs], 1.0, score) * 10000 + 0.5) / 10000
    for (n, i, _), s in zip(pairs, rounded):
        n.scored[i] = float(s)


def best_pairs(asked: pa.Table, offered: pa.Table, k: int) -> tuple[list[str], list[str], list[float]]:
    """Names, options and rounded scores: for each name of ``asked`` (query_norm, q_words, near) all options of ``offered``

    (option_norm, o_words) that have a similar word, a score of the floor or more, and one of the k-th best option or more.
    """
    options = Options(offered.column("option_norm").to_pylist(), offered.column("o_words").combine_chunks())
    found: tuple[list, list, list] = ([], [], [])
    for at in range(0, asked.num_rows, _NAMES_AT_ONCE):
        names = [_Name(r["query_norm"], r["q_words"], r["near"], options) for r in asked.slice(at, _NAMES_AT_ONCE).to_pylist()]
        _score(names, [n.promising() for n in names])
        _score(names, [n.left(n.needed(k)) for n in names])
        for n in names:
            needed = n.needed(k)
            for i, s in n.scored.items():
                if s >= needed:
                    for column, value in zip(found, (n.name, options.names[n.rows[i]], s)):
                        column.append(value)
    return found
