"""Reading level of texts from the grades at which their words are acquired.

A word's grade is the point of the scale by which a set share of its use in the graded samples is
reached, each level weighed alike. The few samples know only some of the words in use: the grades of
others are told from their length and affixes, by a ridge regression on the known words whose results
are stretched to the spread of the known grades. A text's mark is a quantile of its words' grades, by
occurrence; its level is where the mark falls between cut points. Which quantile is used and where the
cut points lie is calibrated on the samples, each marked with grades from which its own words were
taken out. A level is sure where the samples know enough of a text's words to tell that it is in
their language; other texts have an estimate with a lower confidence.

Fitting is done on the driver over a bounded table of samples (`max_samples`); scoring is row-local,
whole Arrow batches at once, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrow import map_texts

QUANTILES = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8)
#: A word counts as acquired at the grade by which this share of its use is reached.
ACQUIRED = 0.3
#: A text's level is sure if it has this many words and the samples know this share of them.
LEAST_WORDS, LEAST_SHARE = 5, 0.1
#: Longer words are guessed as words of this length.
LONGEST = 16
#: Weight of the penalty when unknown words' grades are fitted.
RIDGE = 5.0
#: Runs of letters, with what apostrophes join.
_BREAK = r"[^\p{L}'’]+"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(ends of the texts' runs, code of each word, words by code); code of empty strings included."""
    split = pc.split_pattern_regex(pc.utf8_lower(texts), _BREAK)
    ends = split.offsets.to_numpy()
    coded = split.flatten().dictionary_encode()
    return ends - ends[0], coded.indices.to_numpy(zero_copy_only=False), [w.strip("'’") for w in coded.dictionary.to_pylist()]


def _traits(word: str) -> tuple[str, ...]:
    """What the grade of an unknown word is told from, besides its length."""
    return (f"{word[:2]}-", f"-{word[-2:]}", f"-{word[-3:]}")


@dataclass(frozen=True)
class Guess:
    """Grades of unknown words: a sum over their traits, taken from where it lies among `told` to the same place
    among `spread`."""

    base: float
    slope: float
    parts: dict[str, float]
    told: np.ndarray
    spread: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        sums = [self.base + self.slope * min(len(w), LONGEST) + sum(self.parts.get(t, 0.0) for t in _traits(w)) for w in words]
        return np.interp(np.array(sums, float), self.told, self.spread)


@dataclass(frozen=True)
class Levels:
    """A fitted scale."""

    grades: dict[str, float]
    quantile: float
    cuts: tuple[float, ...]
    lowest: int
    guess: Guess

    def marks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mark, share of known words, number of words) of each text; the mark is nan where it has none."""
        ends, codes, words = _words(pa.array(texts, pa.large_string()))
        known = np.array([self.grades.get(w, np.nan) for w in words] or [np.nan])
        new = [i for i, w in enumerate(words) if w and w not in self.grades]
        grade = known.copy()
        grade[new] = self.guess.words([words[i] for i in new])
        text, grade, known = np.repeat(np.arange(len(texts)), np.diff(ends)), grade[codes], known[codes]
        real = ~np.isnan(grade)
        n = np.bincount(text[real], minlength=len(texts))
        share = np.bincount(text[~np.isnan(known)], minlength=len(texts)) / np.maximum(n, 1)
        ordered = grade[real][np.lexsort((grade[real], text[real]))]
        at = np.concatenate(([0], np.cumsum(n)))[:-1] + np.floor(self.quantile * np.maximum(n - 1, 0)).astype(int)
        out = np.full(len(texts), np.nan)
        out[n > 0] = ordered[at[n > 0]]
        return out, share, n

    def levels(self, texts: list[str]) -> list[tuple[int | None, float | None, int | None, float | None]]:
        """(level, mark, estimate, confidence) of each text. Level and mark are null where they aren't sure; the
        estimate is null without a word. The confidence is the share of known words, less for few words."""
        marks, share, n = self.marks(texts)
        level = self.lowest + np.searchsorted(np.array(self.cuts), marks, side="right")
        sure = (n >= LEAST_WORDS) & (share >= LEAST_SHARE)
        confidence = share * np.minimum(1.0, n / LEAST_WORDS)
        return [
            (None,) * 4 if np.isnan(m) else ((int(v), round(float(m), 6)) if s else (None, None)) + (int(v), round(float(c), 6))
            for v, m, s, c in zip(level, marks, sure, confidence)
        ]


def _grades(has: np.ndarray, sizes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Grade of each word (row) from the number of texts of each level (column) it occurs in: the point
    on the scale by which `ACQUIRED` of its occurrences, levels weighed alike, are reached."""
    rate = has / np.maximum(sizes, 1)
    total = rate.sum(1, keepdims=True)
    reached = np.cumsum(rate / np.where(total > 0, total, 1), 1)
    at = (reached < ACQUIRED).sum(1).clip(max=len(scale) - 1)
    rows = np.arange(len(has))
    before = np.where(at > 0, reached[rows, at - 1], 0.0)
    part = (ACQUIRED - before) / np.maximum(reached[rows, at] - before, 1e-12)
    below = np.where(at > 0, scale[at - 1], scale[0] - 1)
    return np.where(total[:, 0] > 0, below + part * (scale[at] - below), np.nan)


def fit(samples: list[tuple[str, int]]) -> Levels:
    """The scale of graded samples. Quantile: the one whose marks keep the levels furthest apart, each
    sample marked without itself. Cut points: halfway between the medians of neighbouring levels."""
    samples = [(t, v) for t, v in samples if t and v is not None]
    if len({v for _, v in samples}) < 2:
        raise ValueError("samples of at least two levels are needed")
    scale = np.array(sorted({v for _, v in samples}), float)
    level = np.searchsorted(scale, [v for _, v in samples])
    ends, codes, words = _words(pa.array([t for t, _ in samples], pa.large_string()))
    runs = [codes[a:b] for a, b in zip(ends[:-1], ends[1:])]
    has = np.zeros((len(words), len(scale)))
    for run, v in zip(runs, level):
        has[np.unique(run), v] += 1
    sizes = np.bincount(level, minlength=len(scale)).astype(float)
    marks = np.full((len(samples), len(QUANTILES)), np.nan)
    for i, (run, v) in enumerate(zip(runs, level)):
        own, less = has[run].copy(), sizes.copy()
        own[:, v] -= 1
        less[v] -= 1
        grade = _grades(own, less, scale) if len(run) else np.array([])
        grade = np.sort(grade[~np.isnan(grade)])
        if len(grade):
            marks[i] = [grade[int(q * (len(grade) - 1))] for q in QUANTILES]
    best, cuts = -np.inf, None
    for j, q in enumerate(QUANTILES):
        middle = np.array([np.nanmedian(marks[level == v, j]) for v in range(len(scale))])
        here = (middle[1:] + middle[:-1]) / 2
        right = np.nanmean(np.searchsorted(here, marks[:, j], side="right") == level)
        room = min(np.nanquantile(marks[level == v + 1, j], 0.1) - np.nanquantile(marks[level == v, j], 0.9) for v in range(len(scale) - 1))
        if (np.diff(middle) > 0).all() and (score := right + 0.1 * room) > best:
            best, quantile, cuts = score, q, tuple(float(x) for x in here)
    if cuts is None:
        raise ValueError("the samples don't tell their levels apart")
    grades = {w: float(g) for w, g in zip(words, _grades(has, sizes, scale)) if w}
    return Levels(grades, quantile, cuts, int(scale[0]), _guess(grades))


def _guess(grades: dict[str, float]) -> Guess:
    """How unknown words are graded. What the known words' traits tell of each of them is taken without the word
    itself (leave-one-out), as unknown words are never in the fit."""
    words = sorted(grades)
    traits = [_traits(w) for w in words]
    column = {t: i + 2 for i, t in enumerate(sorted({t for ts in traits for t in ts}))}
    x = np.zeros((len(words), len(column) + 2))
    x[:, 0] = 1
    x[:, 1] = [min(len(w), LONGEST) for w in words]
    for row, ts in zip(x, traits):
        row[[column[t] for t in ts]] = 1
    y = np.array([grades[w] for w in words])
    # the penalised normal equations, the constant free; with fewer words than columns they are solved on the words' side
    centre, middle = x[:, 1:].mean(0), y.mean()
    z = x[:, 1:] - centre
    kernel = z @ z.T
    solved = np.linalg.solve(kernel + RIDGE * np.eye(len(words)), np.column_stack([y - middle, kernel]))
    weight, hat = z.T @ solved[:, 0], np.diag(solved[:, 1:]) + 1 / len(words)
    alone = y - (y - middle - z @ weight) / np.maximum(1 - hat, 1e-6)
    return Guess(float(middle - centre @ weight), float(weight[0]), {t: float(weight[i - 1]) for t, i in column.items()}, np.sort(alone), np.sort(y))


def reading_levels(texts: DataFrame, samples: DataFrame, key: str = "rid", text: str = "post", max_samples: int = 20_000) -> DataFrame:
    """(key, level, mark, estimate, confidence) of each input row, on the scale of `samples` (text, level).

    Level and mark are null for null, empty and very short texts and for those next to none of whose
    words the samples know (other languages, symbols). The estimate is the level where there is one and
    else told in the same way with a low confidence (0 to 1); it is null only for texts without a word.
    `max_samples` bounds the table that is fitted on; a larger one is refused. Levels are taken to
    be consecutive whole numbers.
    """
    rows = samples.select("text", "level").dropna().limit(max_samples + 1).collect()
    if len(rows) > max_samples:
        raise ValueError(f"more than {max_samples} graded samples")
    scale = fit([(r[0], r[1]) for r in rows])

    def make():
        def work(rows):
            for (k, _), row in zip(rows, scale.levels([t or "" for _, t in rows])):
                yield k, *row

        return work

    kind = texts.schema[key].dataType.simpleString()
    return map_texts(texts.select(key, text), make, f"{key} {kind}, level int, mark double, estimate int, confidence double")
