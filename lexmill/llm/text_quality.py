"""Text quality: statistics of each document, and which of its lines are prose, list, table or junk.

The labels come from a hidden Markov model over line statistics. Each line is turned into a tuple of
small categories (`observe`); a label's emission is the product of its categories' probabilities,
a label's successor has the probability seen in the labelled texts below, and the best label
sequence of a document is the Viterbi path. Probabilities are counts over those texts with additive
smoothing, made once when the module is loaded.

Everything is row-local. The plain statistics are column expressions; the labels take one Python
pass in Arrow batches. The common words are a small table by contract, read up to `MAX_COMMON`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import markup
from .arrow import map_texts

LABELS = ("prose", "list", "table", "junk")
MAX_COMMON = 100_000
#: A text of no more characters, after trimming, is too short to be called anything but prose.
LEAST_CHARS = 20

#: Labelled texts, one line each as `label|line`; an empty line ends a text. \\t stands for a tab.
LABELLED = """\
prose|My aunt and our postman carried the same ladder, it was kind of a disaster.
prose|Did you hear that noise? Better not tell them who left the gate open last week. Once was enough!
prose|the train was late and then we ran out of time so i went home and made a soup

prose|Everyone says the cold soup from the corner is better though the power went out
prose|I think my brother planted the new hedge since nobody else wanted to do it

prose|Patience outlasts ambition. Memory rearranges testimony; Custom outweighs statute. Silence remains eloquent.
prose|Grammar disciplines thought. Metaphor smuggles doctrine; Scarcity breeds allegory.

prose|Courtesy lubricates commerce; Pageantry anaesthetises grievance. Etiquette camouflages hostility; Punctuality betokens deference.

prose|Entropy humbles architecture. Ritual preserves forgetting. Scholarship domesticates wonder. Irony corrodes allegiance; Satire anticipates censorship. Commerce erodes ceremony.

prose|Translation betrays cadence. Liturgy stabilises grief. Taxonomy flatters curators. Melancholy annotates landscape. Diplomacy postpones candour. Cartography invents neighbours. Nostalgia is no archive. Leisure remains suspect.

prose|Astronomy enlarges modesty; Geometry consoles exiles. Jurisprudence codifies resentment. Theatre rehearses catastrophe; Botany catalogues desire. Arithmetic resists rhetoric; Ornament precedes utility.

prose|Rhetoric overwhelms prudence. Solitude sharpens judgement. Prudence tempers zeal. Solitude ripens doubt; Zeal confounds judgement. Habit precedes virtue. Solitude precedes wisdom; Habit confounds zeal. Rhetoric flatters virtue.

prose|Winter clarifies distance. Distance ennobles regret; Regret instructs vanity. Winter clarifies vanity. Distance absolves error; Winter absolves vanity. Error instructs regret.

prose|A mountain hut a border post and nine leaky shops that was our plan for the week I upgraded a borrowed suitcase after work Never photographed a night train like that before

prose|Unser Hausmeister sammelt alte Uhren. Der Bäcker hält die neue Brücke für zu schmal.
prose|Mi abuelo colecciona relojes antiguos. Quién lo hubiera pensado entonces.

prose|Наш сосед пишет длинные письма в мэрию, когда погода хорошая. Старый друг красит кухню в зелёный цвет, но это совсем не страшно.

prose|Дедушка собирает старые часы на чердаке. Кто бы мог это представить. Утром опять шёл дождь.

prose|Dedushka sobiraet starye chasy na cherdake. Kto by mog eto predstavit. Utrom opyat shyol dozhd.

prose|“My
prose|new
prose|bicycle
prose|is older than the shed that my cousin built
prose|The best part of the trip is that it was free

prose|Somehow
prose|the
prose|dough
prose|got warm again before dinner of all days I would trade my old pie for a new one any time Never froze a soup like that before

prose|It
prose|only took
prose|five tries until the door was open Please do not ask why I sold the shed

prose|Update: the
prose|heavy
prose|lamp is broken now but I need a rest We carried six boxes up the stairs and nobody seemed to care

prose|For the record, my passport, ZQ7654321; kindly remove it soon. I would trade my heavy hall for a light one any time.

prose|Coordinates 48.5054, -0.5988. The clerk wanted tax ID 11/222/33344 again. When I forgot my keys, the map was the first thing to go.

prose|Le contact est Anna Miller, 202.555.0100. Apparently, my aunt never cleaned a watering can, it never worked properly.

prose|The form has NI number QQ123456A on it, no idea why. Ticket 1200-9981-07 was closed again. ISBN 978-1-55-123456-7 bored me a little.

prose|I rejected a perfect road in March. Coordinates 44.1020, 12.5501. On Monday the yard was already empty; we went home early.

prose|We found three maps
prose|It seemed easy and then the shop was closed
prose|I would gladly go there again

prose|IT ONLY TOOK FIVE TRIES BEFORE THE BOAT WOULD START. THE CAPTAIN ONLY LAUGHED.

prose|Regards, Anna Miller
prose|12 Mill Road, Apt 3
prose|Call me after six, the old number is still in use.

list|- bread
list|- two onions
list|- a jar of honey
list|- rice

list|• saddle
list|• old bell
list|• inner valve
list|• pump

list|* lamp
list|* desk
list|* green chair

list|(1) bread
list|(2) dusty oven
list|(3) kettle
list|(4) soup

list|1. wash the pan
list|2) cut the carrots
list|3. boil

list|things to pack
list|2x warm socks
list|1x ticket
list|7x tiny map
list|3x torch

list|to buy: bread, brown sugar, onion, honey, two eggs, tea, salt

list|Needs: chain, new saddle, old bell, pump, brake cable, front wheel, light

list|tags: lamp, green chair, sofa, new desk, stool, shelf, curtain, old carpet

list|lamp; green chair; sofa; new desk; stool; shelf; curtain; old carpet

list|bread; brown sugar; onion; honey; tea

list|half-price rake; felt cap; candle; grey felt cap; long rake; stool

list|Needs: warm lamp, sofa, lovely green chair, stool, stool, bench, overpriced bench, shelf

list|to buy: flour, brown sugar, massive melon, tea, pear, cheap pear, cold tea, salt, honey, new melon, egg, egg

list|tags: sofa, wool hat, heavy bench, curtain, delicate old carpet, massive carpet, shelf, lovely sofa, lamp

list|ladder; dusty rope; tent shop; homemade long rope; mountain tent; lamp

list|toll booth; sand box; leaflet; bent sign; foot bridge; foot bridge; thick leaflet; loud mayor

list|plum hedge; stone wall; sunny cabbage row; clay pot; clay pot; vine post; pear shrub; crooked pear shrub; pear shrub; plum hedge

list|packed: rope, tent, wool hat, warm socks, torch, map

list|bread
list|brown sugar
list|old honey
list|green tea
list|onion
list|salt

table|item\\tqty\\tprice
table|bread\\t4\\t2.30
table|brown sugar\\t12\\t17.05
table|honey\\t3\\t8.99

table|lamp,4,22.30
table|green chair,12,170.05
table|desk,1,99.90

table|bread                    4     2.30
table|brown sugar             12    17.05
table|honey                    3     8.99

table|Day 1   10:30   long ride   23.10
table|Day 2   9:15   hill climb   12.70
table|Day 3   8:45   night ride   7.20

table|bread .... 2.30
table|brown sugar .... 17.05
table|honey .... 8.99

table|name;count;price
table|lamp;4;22.30
table|chair;12;170.05

table|lamp | 4 | 22.30
table|chair | 12 | 170.05

junk|bread lamp noisy green saddle old kettle sofa dusty tiny pump second-hand desk honey broken ladder

junk|onion cold fence gorgeous ticket strange map useless bell chair soup guitar inbox cheap train

junk|amp web page receipt rusty amp tea machine melody receipt playlist deadline parking spot chair plan tour bus oven old broken tiny noisy lamp

junk|weird useless report huge amp quiet gorgeous tape dusty wristband bench chorus bass line microphone huge warm massive honey curtain green

junk|meeting strange second-hand delicate drum parking spot tour bus perfect lyric guitar strange tiny printer quiet ugly useless sofa pear rope

junk|Home Login Search Top FAQ Home Join Next Top Search Login Top

junk|Next Top Home Contact Imprint Login Join Search

junk|buy cheap lamp online best lamp cheap lamp 2021 lamp free lamp top 10 lamp no risk lamp buy lamp

junk|top 10 green chair online green chair free green chair best green chair cheap green chair

junk|click here click here click here click here click here click here

junk|now now now now now now now now now now now

junk|ok ok ok ok ok ok ok ok ok ok ok ok

junk|gkaw fjaq lskd wqe dhag fjwe klqs akdj hgaf sldk qwjd flak

junk|asdk jfhg lakd qwpe rjks dfla hgjd kslw eqka jdhs fgla kwjd

junk|c4fe 30ab577 aa9e b 7 80174 0d b3d1c764 3ee 5d 9e 356 861275 5809

junk|4f06d1 b07e 99a2c41 3d e810f7 52 7bb4a03 0c6 d5e9f1 18a 6e4 f03b 27c 91d 8a05f2

junk|TX4ECoq/fGYlRI9F1R+Nvr9o6Hm32tE9OWZeChottDiUu2gJbkMAu/AAw6sgLtSVBFIGIsvM8fXTsgBdgcJ=

junk|bW8xZ2hQd0tSc1l2TjdkQ2ZaMnBFa0w5aUo4TjRyVG1YcEJ5SGw2c0R3VjFqS2VHcTVuUmJhZkUoz8cXywO1tVdA

junk|kR9vQ2mZpX7LwT4yHs8NbC3fJd6Ga1Ue5iVo0DqWxYtBnMzKlPrShFgEj+uAcOI/vCyQw==

junk|Ã©Ã¼âxx ¼â€™kk Ã©zz ©Ã¼zk ©Ãxz â€™kz Ã¼â€™qk Ã¼â€kz ©Ã¼âzk

junk|Ã ï¿½qz ™Ã xk â€qz Ã¼âkk ¼â€zx ©Ãkx €™qk

junk|~!+=$*=%?$%=*+!&#=#&+&#$#@=#+@~^%&*

junk|=-|*_*=|__=*=-|*
junk|*_-=|*|=-_*==
junk||-*=_|=*-_-|

junk|!!!! ???? !!!! $$$$ !!!! #### ???? !!!!
"""

_ITEM = r"^\s*(?:[-*•·▪◦‣–]\s+|\(?\d{1,3}[.)]\s+|\(\d{1,3}\)\s*|\d{1,3}\s?[x×]\s+|\[[ xX]?\]\s+)"
_MARK = r"\pL{2}[\"”»’)]*[.!?…]+[\"”»’)]*(?:\s|$)|\pL{2};(?:\s+[\p{Lu}\d]|\s*$)"
_BROKEN = r"[Ã€™¼½¿âï©Â\x{fffd}]"
_COLUMN = r"\t|\s\|\s|\.{4}|  |[^\s,;][,;][^\s,;]"
_COLUMNS = re.compile(r"\t|\s\|\s|\s?\.{4,}\s?| {2,}|(?<=\S)[,;](?=\S)|[,;](?=[,;]|$)")
_NUMBER = re.compile(r"[-+]?\d[\d.,:/%]*$")
_HEAD = re.compile(r"\s*[^\W\d_][\w ]{1,24}: ")
_PART = re.compile(r"[,;]\s+")
_INNER_END = re.compile(r"[.!?]\s")
#: Latin words nobody can say: no vowel, or consonants that don't go together.
_UNSAYABLE = re.compile(
    r"[b-df-hj-np-tv-xz]{3,}$|[a-z]*?(?:[b-df-hj-np-tv-xz]{5}|q[a-tv-z]|[jwqvk]{2}|[dgfkjq][sfkljq][dgfkjhq]"
    r"|[bcdfghjklmnpqrstvwxz][jqw][bcdfghjklmnpqrstvwxz]|[fkgd][jqwg]|[ls][jq]|[hj][ghjklqsfd])[a-z]*$"
)
PLACES = 13


def _enum(line: str) -> int:
    """0 no enumeration, 1 one with sentences, 2 a bare one, 3 one after a heading."""
    head = _HEAD.match(line)
    parts = _PART.split(line[head.end() :] if head else line)
    if len(parts) < 4 or sum(len(p.split()) <= 3 for p in parts) < 0.9 * len(parts):
        return 0
    return 1 if _INNER_END.search(line) else 3 if head else 2


def _cells(line: str) -> int:
    """Columns of a line: 0 none, else by their number and the share of numbers in them."""
    cells = [c for c in _COLUMNS.split(line) if c and not c.isspace()]
    if len(cells) < 2:
        return 0
    share = sum(_NUMBER.match(c.strip()) is not None for c in cells) / len(cells)
    return (1 if len(cells) == 2 else 2) + 3 * ((share > 0) + (share > 0.45))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `values` that end before `ends`."""
    total = np.concatenate(([0], np.cumsum(values)))
    return np.diff(total[ends])


def observe(lines: list[str], common: frozenset[str]) -> np.ndarray:
    """The categories of each line, a row of `PLACES` small numbers. Whole batches at once: what a word
    is like is worked out once per different word."""
    array = pa.array(lines, pa.large_string())
    count = lambda pattern: pc.count_substring_regex(array, pattern).to_numpy(zero_copy_only=False)
    chunks = pc.split_pattern_regex(pc.utf8_trim_whitespace(array), r"\s+")
    at = chunks.offsets.to_numpy()
    size = pc.utf8_length(chunks.flatten()).to_numpy(zero_copy_only=False)
    solid = np.maximum(_sums(size, at - at[0]), 1)
    longest = np.maximum.reduceat(size, (at - at[0])[:-1]) if len(size) else solid
    words = pc.split_pattern_regex(array, r"[^\pL'’]+")
    where = words.offsets.to_numpy()
    where = where - where[0]
    coded = words.flatten().dictionary_encode()
    codes, known = coded.indices.to_numpy(zero_copy_only=False), [w.strip("'’") for w in coded.dictionary.to_pylist()]
    low = [w.lower() for w in known]
    number = {w: i for i, w in enumerate(dict.fromkeys(low))}
    prop = np.array(
        [(w != "", len(w), w in common, _UNSAYABLE.match(w) is not None, (k[:1].isupper() and not (k.isupper() and len(k) > 4)), number[w]) for w, k in zip(low, known)],
        dtype=np.int64,
    ).reshape(-1, 6)[codes]
    n, letters, usual, odd, titled = (_sums(prop[:, i], where) for i in range(5))
    line_of = np.repeat(np.arange(len(lines)), np.diff(where))
    pairs = np.unique((line_of * (len(number) + 1) + prop[:, 5])[prop[:, 0] > 0])
    distinct = np.bincount(pairs // (len(number) + 1), minlength=len(lines))
    digits, marks = count(r"\d"), count(_MARK)
    enum, columns = np.zeros(len(lines), int), np.zeros(len(lines), int)
    for i in np.flatnonzero(count("[,;]") >= 3):
        enum[i] = _enum(lines[i])
    for i in np.flatnonzero(pc.match_substring_regex(array, _COLUMN).to_numpy(zero_copy_only=False)):
        columns[i] = _cells(lines[i])
    some = np.maximum(n, 1)
    cut = lambda x, *edges: np.searchsorted(np.array(edges), x, side="left")
    return np.stack(
        [
            cut((solid - letters - digits) / solid, 0.06, 0.13, 0.3, 0.6),
            cut(digits / solid, 0, 0.05, 0.15, 0.4),
            cut(n, 0, 2, 5, 12),
            cut(marks / some, 0, 0.03, 0.12, 0.28),
            np.where(n < 4, 5, cut(usual / some, 0, 0.04, 0.12, 0.2)),
            pc.match_substring_regex(array, _ITEM).to_numpy(zero_copy_only=False).astype(int),
            enum,
            columns,
            np.where(n < 5, 4, cut(distinct / some, 0.3, 0.55, 0.8)),
            np.where(n == 0, 4, cut(odd / some, 0.12, 0.3, 0.5)),
            np.where(n == 0, 4, cut(longest, 14, 24, 45)),
            np.where((n < 4) | (marks > 0), 3, cut(titled / some, 0.55, 0.8)),
            cut(count(_BROKEN) / solid, 0, 0.1),
        ],
        axis=1,
    )


def _fit(texts: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities: of the categories by label and place, of a label after a label, of a first label."""
    rows = [r.split("|", 1) if r else None for r in texts.splitlines()]
    lines = [r[1].replace("\\t", "\t") for r in rows if r]
    labels = np.array([LABELS.index(r[0]) for r in rows if r])
    seen = np.full((len(LABELS), PLACES, 9), 0.3)
    for label, row in zip(labels, observe(lines, frozenset(COMMON_HERE))):
        seen[label, np.arange(PLACES), row] += 1
    follow, begin, last = np.full((4, 4), 0.5), np.ones(4), None
    for r in rows:
        if r:
            label = LABELS.index(r[0])
            if last is None:
                begin[label] += 1
            else:
                follow[last, label] += 1
            last = label
        else:
            last = None
    return np.log(seen / seen.sum(2, keepdims=True)), np.log(follow / follow.sum(1, keepdims=True)), np.log(begin / begin.sum())


#: The common words the labelled texts use; real texts bring their own list.
COMMON_HERE = (
    "the and a to of in it is was i my that but for on we they not with so because this have had at be are if you what "
    "der die das und ich ist nicht ein eine mit auf el la los que y de en un una no mi es por и в не на что я с он как это"
).split()
EMIT, FOLLOW, BEGIN = _fit(LABELLED)


def label_lines(texts: list[list[str]], common: frozenset[str]) -> list[list[int]]:
    """The most probable labels, as places in `LABELS`, of the lines of each text: its Viterbi path."""
    flat = [line for lines in texts for line in lines]
    if not flat:
        return [[] for _ in texts]
    seen = observe(flat, common)
    here = sum(EMIT[:, i, seen[:, i]] for i in range(PLACES)).T
    out, at = [], 0
    for lines in texts:
        part = here[at : at + len(lines)]
        at += len(lines)
        if len(lines) <= 1:
            out.append([int(np.argmax(BEGIN + p)) for p in part])
            continue
        score, back = BEGIN + part[0], []
        for p in part[1:]:
            ways = score[:, None] + FOLLOW
            back.append(ways.argmax(0))
            score = ways.max(0) + p
        path = [int(score.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        out.append(path[::-1])
    return out


_INLINE = ("md_style", "md_link", "wiki_style", "wiki_link", "wiki_url", "html_entity", "tex_quote", "tex_escape", "tex_style", "md_code", "tex_math")


def bare_lines(text: str) -> list[str]:
    """The lines of a text that are not blank, markup set aside: blocks made by markup go, marked words stay."""
    if markup.kinds(text):
        parts = markup.tokens(text)
        tabled = any(name == "md_table" for name, _ in parts)
        text = "".join(s if name == "text" else markup.plain(name, s) if name in _INLINE else "" if name == "html_tag" and not markup._BLOCKS.match(s) else "\n" for name, s in parts)
        if tabled:
            text = re.sub(r"(?m)^[ \t]*\|.*\|[ \t]*$", "", text)
    return [x for x in text.splitlines() if x.strip()]


def label_texts(texts: list[str | None], common: frozenset[str]) -> list[tuple]:
    """(kind, share of each label in the visible characters) of each text; a text without lines is all
    prose. The kind is `prose` for texts of up to `LEAST_CHARS` characters and where at least half is
    prose, else the label that has the most."""
    lines = [bare_lines(t or "") for t in texts]
    out = []
    for t, own, labels in zip(texts, lines, label_lines(lines, common)):
        size = [0, 0, 0, 0]
        for line, label in zip(own, labels):
            size[label] += len(line.strip())
        share = [round(x / sum(size), 6) for x in size] if any(size) else [1.0, 0.0, 0.0, 0.0]
        long = t is not None and len(t.strip()) > LEAST_CHARS
        kind = LABELS[max((1, 2, 3), key=lambda i: share[i])] if long and share[0] < 0.5 else "prose"
        out.append((kind, *share))
    return out


def common_set(common: DataFrame) -> frozenset[str]:
    rows = common.select(F.lower("word").alias("word")).dropna().distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return frozenset(r[0] for r in rows)


def line_labels(texts: DataFrame, common: DataFrame, key: str = "rid", text: str = "post") -> DataFrame:
    """(key, kind, prose, list, table, junk): the kind of each input row's text and the shares of its
    labels. Null, blank and very short texts are prose."""
    known = common_set(common)

    def make():
        def work(rows):
            for (k, _), row in zip(rows, label_texts([t for _, t in rows], known)):
                yield k, *row

        return work

    kind = texts.schema[key].dataType.simpleString()
    return map_texts(texts.select(key, text), make, f"{key} {kind}, kind string, prose double, list double, table double, junk double")


def text_statistics(texts: DataFrame, common: DataFrame, key: str = "rid", text: str = "post") -> DataFrame:
    """(key, n_chars, n_words, mean_word_len, symbol_ratio, n_lines, end_punct_share, common_share, distinct_share).

    Words are runs of letters, symbols what is neither letter, digit nor white space, lines are split
    at line feeds and blank ones don't count. Ratios of nothing are 0. Null texts count as empty.
    """
    known = sorted(common_set(common))
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\S"))
    visible = F.length(F.regexp_replace(t, r"\s", ""))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    base = texts.select(key, t.alias("_t"), words.alias("_w"), lines.alias("_l"), visible.alias("_v"))
    w, x = F.col("_w"), F.col("_l")
    return base.select(
        key,
        F.length("_t").cast("bigint").alias("n_chars"),
        F.size(w).cast("bigint").alias("n_words"),
        ratio(F.length(F.array_join(w, "")), F.size(w)).alias("mean_word_len"),
        ratio(F.length(F.regexp_replace("_t", r"[\p{L}\p{Nd}\s]", "")), F.col("_v")).alias("symbol_ratio"),
        F.size(x).cast("bigint").alias("n_lines"),
        ratio(F.size(F.filter(x, lambda s: s.rlike(r"[.!?…]\s*$"))), F.size(x)).alias("end_punct_share"),
        ratio(F.size(F.filter(w, lambda s: s.isin(known))), F.size(w)).alias("common_share"),
        ratio(F.size(F.array_distinct(w)), F.size(w)).alias("distinct_share"),
    )
