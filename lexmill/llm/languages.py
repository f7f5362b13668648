"""Languages of texts and of their parts, with a string kernel.

The kernel of two strings is the cosine of their sets of character n-grams, lengths blended. It is
approximated by Nyström landmarks, on which a one-versus-rest kernel ridge regression is solved. As
the kernel is an inner product of presence vectors, landmarks and weights fold into one matrix of
n-gram bucket by language: batches of sentences are scored by a product of their presence vectors
with it. N-grams are told apart by a hash of 16 bits, so some share a bucket. A Viterbi pass over a text's sentences, with a price on changing language, gives the
stretches; a language belongs to a text if it has two whole sentences in a row, or is its main one.

The model is fitted on the driver on a bounded sample: about `per_language` labelled rows of each
language, picked by hash, and `per_fit` of their different sentences, drawn by a seeded generator. Both
bounds are parameters and concern the fit alone. Labels may be wrong, so sentences that the first fit contradicts
are taken out before the second. Romanised Russian and texts without their accents are made from the
sample's own sentences. Scoring is row-local over whole texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts

# Names and codes of the languages; how Russian is written in Latin letters.
NAMES = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "spanisch"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "it": ("it", "ita", "italian", "italiano", "italienisch"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "niederländisch", "flemish", "vlaams"),
    "ru": ("ru", "rus", "russian", "русский", "russkiy", "russisch"),
}
ROMAN = dict(
    zip(
        "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
        "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" "),
    )
)
LANGUAGES = tuple(NAMES)
BUCKETS, LENGTHS, LANDMARKS, RIDGE = 1 << 16, (1, 2, 3, 4), 768, 0.3
#: A sentence is told if it has this many letters and its best score is this high; price of a change.
LEAST_LETTERS, LEAST_SCORE, CHANGE = 4, 0.2, 3.0
#: A text with fewer letters has no language.
TEXT_LETTERS = 10

_GONE = re.compile(r"https?://\S+|www\.\S+|\S+@\S+|<[^<>]{1,200}>|&[a-z]{2,8};|\[\[|\]\]|\{\{[^{}]*\}\}|\\[a-zA-Z]+|`[^`\n]*`|[@#]\w+")
_SIGN = re.compile(r"[@#<&{\[\\`/]|www")
_SENTENCE = re.compile(r"[^.!?…\n]+(?:[.!?…]+[\"”»’)]*(?=\s|$)|[.!?…]+(?=\S)[^.!?…\n]*)*[.!?…]*[\"”»’)]*\n?|[.!?…\n]+")
_LETTERS = 10

_GONE = re.compile(r"https?://\S+|www\.\S+|\S+@\S+|<[^<>]{1,200}>|&[a-z]{2,8};|\[\[|\]\]|\{\{[^{}]*\}\}|\\[a-zA-Z]+|`[^`\n]*`|[@#]\w+")
_SIGN = re.compile(r"[@#<&{\[\\`/]|www")
_SENTENCE = re.compile(r"[^.!?…\n]+(?:[.!?…]+[\"”»’)]*(?=\s|$)|[.!?…]+(?=\S)[^.!?…\n]*)*[.!?…]*[\"”»’)]*\n?|[.!?…\n]+")
_WHOLE = re.compile(r"[^|<>]*\w\s[^|<>]*\w[\"”»’)]*[.!?…]+[\"”»’)]*\s*$|[^|<>{}=]*$")
_WORD, _MARKS = re.compile(r"\w"), frozenset("|<>")
_LETTERS = re.compile(rf"(?:[^\W\d_][\W\d_]*+){{{TEXT_LETTERS}}}")


def label_language(label: Column) -> Column:
    """The two-letter code a label names in whatever spelling, null if none of the known languages."""
    plain = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    base = F.regexp_replace(plain, r"[-_ (].*$", "")
    codes = F.create_map(*(F.lit(x) for c, names in NAMES.items() for n in names for x in (n, c)))
    return F.coalesce(F.try_element_at(codes, plain), F.try_element_at(codes, base))


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of a text's sentences and lines, in order."""
    return [m.span() for m in _SENTENCE.finditer(text) if not m[0].isspace()]


def letters(texts: list[str]) -> list[str]:
    """Sentences as the kernel sees them: lower-case words with a space around each."""
    bare = pa.array([_GONE.sub(" ", t) if _SIGN.search(t) else t for t in texts], pa.large_string())
    words = pc.replace_substring_regex(pc.utf8_normalize(pc.utf8_lower(bare), "NFC"), r"[^\pL]+", " ")
    return [f" {w} " for w in pc.ascii_trim(words, " ").to_pylist()]


def whole(text: str) -> bool:
    """Whether a span is a sentence rather than a scrap: two words or more that end as a sentence does, or
    five words or more; no markup."""
    if not _MARKS.isdisjoint(text):
        return False
    words = text.split()
    if text.rstrip().rstrip("\"”»’)").endswith((".", "!", "?", "…")):
        return len(list(islice((w for w in words if _WORD.search(w)), 2))) == 2
    return len(words) >= 5 and "{" not in text and "}" not in text and "=" not in text


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ends, buckets): the buckets of the n-grams present in each text, each once. At most 65536 texts."""
    buffer = "".join(texts)
    codes = np.frombuffer(buffer.encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32), [len(t) for t in texts])
    keys, rolled = [], np.full(len(codes), 0x811C9DC5, np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if len(codes) < n:
            break
        rolled = (rolled[: len(codes) - n + 1] * np.uint32(0x01000193)) ^ (codes[n - 1 :] * np.uint32(0x9E3779B1))
        if n in LENGTHS:
            first = owner[: len(codes) - n + 1]
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            keys.append(((first << np.uint32(16)) | (mixed >> np.uint32(16)))[first == owner[n - 1 :]])
    found = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.uint32)
    if len(found):
        found = found[np.concatenate(([True], found[1:] != found[:-1]))]
    size = np.bincount(found >> np.uint32(16), minlength=len(texts))
    return np.concatenate(([0], np.cumsum(size))), (found & np.uint32(BUCKETS - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Weights of each n-gram bucket for each language, and the steepness that makes scores chances."""

    weights: np.ndarray
    steepness: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Regression scores, a row per text and a column per language."""
        out = np.zeros((len(texts), len(LANGUAGES)), np.float32)
        for at in range(0, len(texts), 1000):
            ends, found = presence(texts[at : at + 1000])
            held = np.flatnonzero(np.diff(ends))  # reduceat has no empty runs
            if len(held):
                out[at + held] = np.add.reduceat(self.weights[found], ends[held], axis=0) / np.sqrt(np.diff(ends)[held])[:, None]
        return out


def _solve(texts: list[str], labels: np.ndarray, rng: np.random.Generator) -> Model:
    """Nyström kernel ridge regression, folded into bucket weights."""
    ends, found = presence(texts)
    sizes = np.sqrt(np.maximum(np.diff(ends), 1))
    each = max(1, LANDMARKS // len(set(labels.tolist())))
    picks = np.concatenate([rng.permutation(np.flatnonzero(labels == c))[:each] for c in sorted(set(labels.tolist()))])
    table = np.zeros((BUCKETS, len(picks)), np.float32)
    for j, i in enumerate(picks):
        table[found[ends[i] : ends[i + 1]], j] = 1 / sizes[i]
    kernel = np.stack([table[found[a:b]].sum(0) / s for a, b, s in zip(ends[:-1], ends[1:], sizes.astype(np.float32))])
    values, vectors = np.linalg.eigh(kernel[picks].astype(np.float64))
    keep = values > 1e-6 * values[-1]
    basis = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    features = kernel @ basis
    del kernel
    aims = (labels[:, None] == np.arange(len(LANGUAGES))).astype(np.float32)
    weight = 1 / np.bincount(labels, minlength=len(LANGUAGES))[labels]
    weight *= len(labels) / weight.sum()
    inner = features.T * weight.astype(np.float32)
    solved = np.linalg.solve((inner @ features).astype(np.float64) + RIDGE * np.eye(features.shape[1]), inner @ aims)
    return Model(table @ (basis @ solved).astype(np.float32), 1.0)


def variants(text: str, language: str) -> list[str]:
    """Other spellings of a sentence: romanised, without accents, umlauts as two letters."""
    out = []
    if language == "ru":
        out.append(" " + "".join(ROMAN.get(c, c) for c in text).strip() + " ")
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).replace("ß", "ss")
    if language != "ru" and bare != text:
        out.append(bare)
    if language == "de" and bare != text:
        out.append(text.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss"))
    return out


def fit(rows: list[tuple[str, str]], seed: int = 7, per_fit: int = 1500) -> Model:
    """A model of labelled texts (text, two-letter code), fitted on `per_fit` different sentences of each
    language at most."""
    cut = [(text[a:b], code) for text, code in rows if code in NAMES for a, b in sentences(text)]
    votes: dict[str, Counter] = {}
    for s, (_, code) in zip(letters([t for t, _ in cut]), cut):
        if len(s) >= 12:
            votes.setdefault(s, Counter())[LANGUAGES.index(code)] += 1
    if not votes:
        raise ValueError("no labelled text to fit on")
    # a sentence that recurs under several labels has the one most texts give it
    texts, labels = list(votes), np.array([max(v, key=lambda c: (v[c], -c)) for v in votes.values()])
    rng = np.random.default_rng(seed)
    few = np.concatenate([rng.permutation(np.flatnonzero(labels == c))[:per_fit] for c in sorted(set(labels.tolist()))])
    texts, labels = [texts[i] for i in few], labels[few]
    first = _solve(texts, labels, rng)
    agree = first.scores(texts).argmax(1) == labels
    made = [(s, c) for s, c, ok in zip(texts, labels, agree) if ok]
    made += [(v, c) for s, c in made for v in variants(s, LANGUAGES[c])]
    texts, labels = [s for s, _ in made], np.array([c for _, c in made])
    model = _solve(texts, labels, rng)
    scores = model.scores(texts)
    steep = [2.0, 4.0, 6.0, 8.0, 12.0, 16.0]
    loss = [np.mean(np.log(np.exp(k * scores).sum(1)) - k * scores[np.arange(len(labels)), labels]) for k in steep]
    return Model(model.weights, steep[int(np.argmin(loss))])


def segments(model: Model, texts: list[str | None]) -> list[list[tuple[int, int, str, float, int, bool]]]:
    """The single-language stretches of each text: (start, end, language, confidence, letters, several), the
    last telling whether there are two whole sentences or more.

    Sentences that can't be told (few letters, noise) go with the stretch they stand in. A text of
    fewer than `TEXT_LETTERS` letters has none.
    """
    spans = [sentences(t) if t and _LETTERS.search(t) else [] for t in texts]
    known: dict[str, int] = {}
    flat = [[known.setdefault(t[a:b], len(known)) for a, b in own] for t, own in zip(texts, spans)]
    seen = letters(list(known))
    scores = model.scores(seen)
    size = np.array([len(s.replace(" ", "")) for s in seen] or [0])
    told = (size >= LEAST_LETTERS) & (scores.max(1, initial=-1) >= LEAST_SCORE)
    chance = model.steepness * scores
    chance = chance - np.log(np.exp(chance).sum(1, keepdims=True)) if len(chance) else chance
    best, sure, tell = chance.argmax(1).tolist() if len(chance) else [], np.exp(chance), told.tolist()
    out = []
    for t, own, ids in zip(texts, spans, flat):
        kept = [(i, s) for i, s in zip(ids, own) if tell[i]]
        path = _path(chance, [i for i, _ in kept], best)
        runs, at = [], 0
        while at < len(path):
            c, end = path[at], at + 1
            while end < len(path) and path[end] == c:
                end += 1
            part = [i for i, _ in kept[at:end]]
            n = size[part]
            some = 0
            for _, (a, b) in kept[at:end]:
                some += whole(t[a:b])
                if some == 2:
                    break
            runs.append((kept[at][1][0], kept[end - 1][1][1], LANGUAGES[c], round(float(sure[part, c] @ n / n.sum()), 4), int(n.sum()), some == 2))
            at = end
        out.append(runs)
    return out


def _path(chance: np.ndarray, ids: list[int], best: list[int]) -> list[int]:
    """The likeliest languages of sentences in a row, at the price `CHANGE` for every change."""
    if not ids or all(best[i] == best[ids[0]] for i in ids):
        return [best[i] for i in ids]
    score, back = chance[ids[0]], []
    for i in ids[1:]:
        top = int(score.argmax())
        change = score[top] - CHANGE > score
        back.append(np.where(change, top, np.arange(len(LANGUAGES))))
        score = np.where(change, score[top] - CHANGE, score) + chance[i]
    path = [int(score.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def text_languages(runs: list[tuple]) -> list[tuple[str, float]]:
    """(language, confidence) of a text with these stretches: its main language, by letters, and every
    other with at least two whole sentences in a row that is likelier than not."""
    size: dict[str, int] = {}
    sure: dict[str, float] = {}
    for _, _, c, p, n, _ in runs:
        size[c] = size.get(c, 0) + n
        sure[c] = sure.get(c, 0.0) + p * n
    if not size:
        return []
    main = max(size, key=lambda c: (size[c], c))
    firm = {c for _, _, c, p, _, several in runs if several and p >= 0.5}
    return sorted((c, round(sure[c] / size[c], 4)) for c in firm | ({main} if main in firm or not firm else set()))


def labelled_sample(docs: DataFrame, key: str, text: str, label: str, per_language: int) -> list[tuple[str, str]]:
    """About `per_language` rows of each labelled language, those whose keys have the smallest hashes."""
    named = docs.select(key, F.col(text).alias("t"), label_language(F.col(label)).alias("code")).where("code is not null and t is not null")
    counts = {r[0]: r[1] for r in named.groupBy("code").count().collect()}
    draw = (F.xxhash64(F.col(key).cast("string")) / F.lit(2.0**64) + 0.5).alias("draw")
    if not counts:
        return []
    shares = F.create_map(*(F.lit(x) for c, n in sorted(counts.items()) for x in (c, min(1.0, per_language / n))))
    share = F.try_element_at(shares, F.col("code"))
    return [(r[0], r[1]) for r in named.where(draw < share).orderBy(draw).limit(2 * per_language * len(LANGUAGES)).select("t", "code").collect()]


def language_segments(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = 300, per_fit: int = 1500) -> DataFrame:
    """(key, start_pos, end_pos, lang, confidence) of every single-language stretch; positions are
    1-based code points, the end inclusive. Null texts and those with few letters have none."""
    model = fit(labelled_sample(docs, key, text, label, per_language), per_fit=per_fit)

    def make():
        def work(rows):
            for (k, _), runs in zip(rows, segments(model, [t for _, t in rows])):
                for a, b, c, p, _, _ in runs:
                    yield k, a + 1, b, c, p

        return work

    kind = docs.schema[key].dataType.simpleString()
    return map_texts(docs.select(key, text), make, f"{key} {kind}, start_pos bigint, end_pos bigint, lang string, confidence double")


def document_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = 300, per_fit: int = 1500) -> DataFrame:
    """(key, lang, confidence, n_languages, label_lang): a row per language of each text.

    `label_lang` is what the label names, null if nothing known. A text without letters enough, or
    none of whose sentences can be told, has no row. Rows that repeat a key repeat its languages.
    Tables without any usable label can't be fitted on and are refused.
    """
    model = fit(labelled_sample(docs, key, text, label, per_language), per_fit=per_fit)

    def make():
        def work(rows):
            for (k, code, _), runs in zip(rows, segments(model, [r[2] for r in rows])):
                found = text_languages(runs)
                for c, p in found:
                    yield k, c, p, len(found), code

        return work

    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(key, label_language(F.col(label)).alias("label_lang"), text)
    return map_texts(named, make, f"{key} {kind}, lang string, confidence double, n_languages int, label_lang string")
