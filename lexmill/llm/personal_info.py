"""Personal information in free text: found by anchors, expanded and validated by local parsers.

One Aho-Corasick pass over the lower-cased text finds anchors: at-signs and their spelled-out forms,
words that announce identity numbers, street words and family names. At each anchor a small
deterministic parser reads to both sides, as far as the mention goes, decides whether a mention is
there and where it begins and ends. Phone numbers have no fixed anchor; the runs of digits and
separators are their anchors.

The name list is incomplete, so names are learnt from the texts first (`learnt_names`): one pass counts
how often each word stands behind a listed given name or a title, or before a listed family name.
Words that stand there in `LEAST_SHARE` of their occurrences, beside two different ones at least, are
names. Finding itself is
row-local: no shuffle, one Python pass in Arrow batches. What is read on the driver (name list, learnt
names, placeholders) has a bound; beyond it the operator refuses rather than leave names out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts

#: Bounds of what is read on the driver: names, listed and learnt; placeholders.
MAX_NAMES, MAX_PLACEHOLDERS = 500_000, 1000
#: A word is a name if this share of its occurrences stands beside a listed name or a title.
LEAST_SHARE = 0.1

# What announces things, and how they are written.
ID_CUES = (
    "ssn", "social security", "my social", "passport", "dni", "nie", "nif", "steuer-id", "steuer id", "steuernummer", "ni number",
    "national insurance", "personal id", "national id", "identity card", "identity number", "id number", "tax id", "tax number",
    "driving licence", "driving license", "driver's licence", "driver's license", "driver licence", "driver license",
    "personalausweis", "reisepass", "pasaporte", "passeport", "passaporto", "paspoort", "codice fiscale", "bsn", "cpf", "nhs number", "паспорт", "снилс",
)
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "señor", "señora", "sr", "sra", "monsieur", "madame", "mme", "signor", "signora", "mevrouw", "meneer")
STREET_TYPES = (
    "street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "dr", "close", "court", "ct", "blvd", "boulevard", "way",
    "place", "terrace", "crescent", "square",
)
STREET_ENDINGS = ("straße", "strasse", "str.", "gasse", "allee", "weg", "platz", "ufer")
STREET_STARTS = ("avenida", "avda.", "av.", "calle", "c/", "plaza", "paseo", "via", "viale", "piazza", "rua", "travessa")
STREET_FRENCH = ("rue", "avenue", "chemin", "boulevard", "place", "allée", "impasse", "quai")
STREET_PREPOSITIONS = ("am", "an der", "an den", "auf der", "auf dem", "im", "in der", "zum", "zur", "unter den")
AT_SIGNS = ("@", "(at)", "[at]", "{at}", "(@)", "[@]", " at ")
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "de", "fr", "es", "pt", "it", "nl", "ru", "uk", "us", "eu", "test", "example", "invalid", "localhost")
FILE_TYPES = ("png", "jpg", "jpeg", "gif", "svg", "pdf", "txt", "csv", "html", "htm", "php", "js", "css", "zip", "mp3", "mp4")
NOT_PHONE = re.compile(
    r"(?:order|tracking|track|ticket|part|serial|build|isbn|version|invoice|reference|ref|case|item|sku|batch|lot|flight|article|model|account|bestell\w*|pool of)"
    r"\W{0,3}(?:number|num|no|nr|id|code)?\W{0,3}$"
)

_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|punkt|punto|point)\s?[)\]}]\s?|\s(?:dot|punkt|punto|point)\s)"
_DOMAIN = re.compile(rf"\s?({_LABEL}(?:{_DOT}{_LABEL})*(?:{_DOT}[a-z]{{2,}}))(?![a-z0-9])")
_SPELLED_DOT = re.compile(r"\b(?:dot|punkt|punto|point)\b")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ID_LINK = re.compile(r"(?:\W{0,2}\b(?:number|num|no|nr|nummer|número|numéro|card|code|is|was|id|security|insurance)\b\.?)*[\s:,.#(]{0,3}")
_ID_DIGITS = r"\d[0-9a-z]*(?:[./-][0-9a-z]*\d[0-9a-z]*| \d{2,}[a-z]?(?![\w.]))*"
_ID_VALUE = re.compile(rf"[a-z]{{1,3}}[ -]?{_ID_DIGITS}(?: [a-z](?!\w))?|{_ID_DIGITS}")
_PHONE = re.compile(
    r"(?<![\w.+/@#-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}"
    r"|\(0\)\d{1,4}(?:[ /-]\d{2,8}){1,4}"
    r"|0\d{1}(?:[ .-]\d{2}){4}"
    r"|0\d{2,4}[ /-]\d{3,4}(?:[ -]?\d{2,6}){0,2}"
    r"|(?:1[-. ])?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[-. ])[2-9]\d{2}[-. ]\d{4}"
    r"|[2-9]\d{2}[2-9]\d{6}"
    r")(?![\w/@-]|[.:]\d)"
)
_HOUSE_EN = re.compile(r"(\d{1,5}[a-d]?),? ((?:[^\W\d_][\w'’-]*\.? ){1,3})$")
_HOUSE_FR = re.compile(r"\d{1,5}[a-d]?(?: bis| ter)?,? $")
_STREET_FR = re.compile(r" (?:de la |de l['’]|du |des |de |d['’])?[^\W\d_][\w'’-]*(?: [A-ZÀ-Ý][\w'’-]*)?")
_UNIT_BEFORE = re.compile(r"(?:\b(?:flat|apt|apartment|unit|suite|ste|room|wohnung|piso|appt?)\.? ?#?\w{1,5}|#\w{1,5}),? $")
_UNIT_AFTER = re.compile(r"\.?(?:,? (?:flat|apt|apartment|unit|suite|ste)\.? ?#?\w{1,5}| ?#\w{1,5})\b")
_NUMBER_AFTER = re.compile(r",? ?(?:nº|n°|no\.)? ?\d{1,4}[a-z]?(?!\w)")
_NAMED_ES = re.compile(r"(?:de la |de los |de las |del |de |da |do |della )?[^\W\d_][\w'’-]*(?: [A-ZÀ-Ý][\w'’-]*)?,? ?(?:nº )?\d{1,4}[a-z]?(?!\w)")
_NAMED_DE = re.compile(r" [A-ZÄÖÜ][\w-]{3,} \d{1,4}[a-z]?(?!\w)")
_LOWER_LEAD = re.compile(r"(?:^|[,;:\n(]\s?|\b(?:at|en|near|to|in|bei|à|an|on|von) )$")
_HEXISH = re.compile(r"(?=\w*\d)(?=\w*[a-f])[0-9a-f]{2,}$|[0-9a-f]$")
_WORD, _TOKEN = re.compile(r"[^\W\d_]+"), re.compile(r"\s*(\S+)")
_NAME_WORD = r"^[(\"'“„«\[<*]*(?P<word>\pL[\pL'’-]*\pL)[^\pL]*$"


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def left_of(low: str, end: int, words: int) -> int:
    """Where the last `words` words before `end` begin, words being what blanks part."""
    at = end - 1 if low[end - 1 : end] == " " else end
    for _ in range(words):
        at = low.rfind(" ", 0, at)
        if at < 0:
            return 0
    return at + 1


class Finder:
    """Finds mentions in single texts."""

    def __init__(self, names: Iterable[tuple[str, str]]):
        import ahocorasick

        lists = defaultdict(list)
        for name, kind in names:
            lists[kind].append(name)
        self.given, self.family = ({lowered(n.strip()) for n in lists[k] if n.strip()} for k in ("given", "family"))
        anchors: dict[str, set[str]] = defaultdict(set)
        for kind, words in (
            ("at", AT_SIGNS), ("id", ID_CUES), ("name", self.family),
            ("type", (" " + w for w in STREET_TYPES)), ("ending", STREET_ENDINGS), ("start", STREET_STARTS),
            ("french", (" " + w for w in STREET_FRENCH)), ("preposition", (w + " " for w in STREET_PREPOSITIONS)),
        ):
            for w in words:
                anchors[w].add(kind)
        self.anchors = ahocorasick.Automaton()
        for w, kinds in anchors.items():
            self.anchors.add_word(w, (len(w), tuple(sorted(kinds))))
        self.anchors.make_automaton()

    def mentions(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in order of start, without overlaps; 0-based, end exclusive."""
        low = lowered(text)
        has_digit = any(map(str.isdigit, low)) if len(low) < 64 else re.search(r"\d", low) is not None
        at, ids, streets, names = [], [], [], []
        for last, (n, kinds) in self.anchors.iter(low):
            i, j = last - n + 1, last + 1
            for kind in kinds:
                if kind == "name":
                    names.append((i, j))
                elif kind == "at":
                    at.append((i, j))
                elif has_digit:
                    (ids if kind == "id" else streets).append((kind, i, j))
        found: list[tuple[str, int, int]] = []
        for i, j in at:
            self._add(found, "email", self._email(low, i, j))
        for _, i, j in ids:
            self._add(found, "id_number", self._id(low, i, j))
        if has_digit:
            for m in _PHONE.finditer(low):
                self._add(found, "phone", self._phone(low, m))
        for kind, i, j in streets:
            self._add(found, "address", getattr(self, "_" + kind)(text, low, i, j))
        for i, j in names:
            self._add(found, "name", self._name(low, i, j))
        return sorted(found, key=lambda x: x[1])

    @staticmethod
    def _add(found: list, kind: str, span: tuple[int, int] | None) -> None:
        if span and not any(a < span[1] and span[0] < b for _, a, b in found):
            found.append((kind, *span))

    @staticmethod
    def _email(low: str, i: int, j: int) -> tuple[int, int] | None:
        domain = _DOMAIN.match(low, j)
        if not domain:
            return None
        tail = re.split(r"[^a-z0-9-]+", domain[1])[-1]
        if tail in FILE_TYPES or (low[i:j] == " at " and not _SPELLED_DOT.search(domain[1]) and tail not in TOP_LEVEL):
            return None
        end = i - 1 if low[i - 1 : i].isspace() else i
        start = end
        while start and low[start - 1] in _LOCAL:
            start -= 1
        while start < end and low[start] in "._%+-":
            start += 1
        return (start, domain.end(1)) if start < end else None

    @staticmethod
    def _id(low: str, i: int, j: int) -> tuple[int, int] | None:
        if (i and low[i - 1].isalnum()) or low[j : j + 1].isalnum():
            return None
        value = _ID_VALUE.match(low, _ID_LINK.match(low, j).end())
        return value.span() if value and sum(map(str.isdigit, value[0])) >= 5 else None

    @staticmethod
    def _phone(low: str, m: re.Match) -> tuple[int, int] | None:
        digits = sum(map(str.isdigit, m[0]))
        if not 8 <= digits <= 15 or NOT_PHONE.search(low[left_of(low, m.start(), 4) : m.start()]):
            return None
        before, after = low[left_of(low, m.start(), 1) : m.start()].split(), _TOKEN.match(low, m.end())
        if before and after and _HEXISH.match(before[-1]) and _HEXISH.match(after[1]):
            return None
        return m.span()

    @staticmethod
    def _unit(low: str, start: int) -> int:
        left = left_of(low, start, 3)
        unit = _UNIT_BEFORE.search(low[left:start])
        return left + unit.start() if unit else start

    def _type(self, text: str, low: str, i: int, j: int) -> tuple[int, int] | None:
        """<number> <name> Street."""
        if low[j : j + 1].isalnum():
            return None
        left = left_of(low, i + 1, 5)
        house = _HOUSE_EN.search(low[left : i + 1])
        if not house or (left + house.start() and low[left + house.start() - 1] in "#.,:/-0123456789" and low[left + house.start() - 1] != ","):
            return None
        words = text[left + house.start(2) : i + 1].split()
        start = self._unit(low, left + house.start())
        if not all(w[0].isupper() for w in words):
            if len(words) > 2 or not _LOWER_LEAD.search(low[left_of(low, start, 2) : start]) or any(w[0].isupper() for w in words):
                return None
        after = _UNIT_AFTER.match(low, j)
        return start, after.end() if after else j

    def _ending(self, text: str, low: str, i: int, j: int) -> tuple[int, int] | None:
        """Lindenstraße <number>."""
        number = _NUMBER_AFTER.match(low, j)
        while i and (low[i - 1].isalpha() or low[i - 1] == "-"):
            i -= 1
        return (self._unit(low, i), number.end()) if number and low[j : j + 1] in " ," and j - i > 5 else None

    def _start(self, text: str, low: str, i: int, j: int) -> tuple[int, int] | None:
        """Calle de la <name> <number>."""
        named = _NAMED_ES.match(text, j + 1) if low[j : j + 1] == " " else _NAMED_ES.match(text, j) if low[j - 1] == "/" else None
        if not named or (i and low[i - 1].isalnum()):
            return None
        return self._unit(low, i), named.end()

    def _french(self, text: str, low: str, i: int, j: int) -> tuple[int, int] | None:
        """<number> bis, rue des <name>."""
        left = left_of(low, i + 1, 3)
        house, named = _HOUSE_FR.search(low[left : i + 1]), _STREET_FR.match(text, j)
        if not house or not named or named[0].split()[0] not in ("de", "du", "des") and not named[0].startswith((" de ", " d'", " d’", " l'")):
            return None
        return self._unit(low, left + house.start()), named.end()

    def _preposition(self, text: str, low: str, i: int, j: int) -> tuple[int, int] | None:
        """Am <name> <number>."""
        named = _NAMED_DE.match(text, j - 1) or (text[i:j].islower() and low[j:].isascii() and None)
        if not named or (i and low[i - 1].isalnum()) or not text[i].isupper():
            return None
        return self._unit(low, i), named.end()

    def _name(self, low: str, i: int, j: int) -> tuple[int, int] | None:
        """Given names and initials before a family name, or a given name after it and a comma."""
        before = low[i - 1 : i]
        if before and (before.isalnum() or before in "@#_/.+-&") or low[j : j + 1].isalnum() or low[j : j + 1] in ("_", "@", "+"):
            return None
        while low[j : j + 1] == "-" and (more := _WORD.match(low, j + 1)) and more[0] in self.family:
            j = more.end()
        start = i
        while low[start - 1 : start] == " ":
            word = low[left_of(low, start, 1) : start - 1].rpartition("\n")[2].lstrip("(\"'“„«[<*")
            initial = len(word) == 2 and word[1] == "." and word[0].isalpha()
            if not initial and word not in self.given:
                break
            start -= len(word) + 1
        if start == i and low[j : j + 2] == ", ":
            given = _WORD.match(low, j + 2)
            if given and given[0] in self.given:
                j = given.end()
        return start, j


def _names(names: DataFrame) -> list[tuple[str, str]]:
    rows = names.select("name", "kind").dropna().distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"the name list has more than {MAX_NAMES} rows")
    return [(r[0], r[1]) for r in rows]


def neighbours(texts: list[str | None], left: frozenset[str], right: frozenset[str]) -> list[tuple]:
    """(word, n, behind, behind_min, behind_max, before, before_min, before_max) of the words of some texts: how
    often each occurs, how often with a capital directly behind a word of `left` or before one of `right`,
    and the first and last of those words."""
    tokens = pc.utf8_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
    coded = tokens.flatten().dictionary_encode()
    codes, forms = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    bare = pc.struct_field(pc.extract_regex(forms, _NAME_WORD), [0]).to_pylist()
    low = [lowered(w) if w else "" for w in bare]
    number = {w: i for i, w in enumerate(dict.fromkeys(low))}
    word = np.array([number[w] for w in low] or [0])[codes]
    capital = np.array([bool(w) and w[0].isupper() for w in bare] or [False])[codes]
    # a name before another one ends without a mark, a title may have its full stop
    plain = forms.to_pylist()
    leads = np.array([w in left and (f[-1:].isalpha() or w in TITLES and f.endswith(".")) for w, f in zip(low, plain)] or [False])[codes]
    ends = np.array([f[-1:].isalpha() for f in plain] or [False])[codes]
    follows = np.array([w in right for w in low] or [False])[codes]
    text = np.repeat(np.arange(len(texts)), np.diff(tokens.offsets.to_numpy()))
    same = text[1:] == text[:-1] if len(text) else np.array([], bool)
    found: dict[int, list] = {}
    names = list(number)
    for at in np.flatnonzero(same & leads[:-1] & capital[1:]) if len(text) else ():
        found.setdefault(int(word[at + 1]), [[], []])[0].append(names[word[at]])
    for at in np.flatnonzero(same & ends[:-1] & capital[:-1] & follows[1:]) if len(text) else ():
        found.setdefault(int(word[at]), [[], []])[1].append(names[word[at + 1]])
    total = np.bincount(word, minlength=len(names)).tolist()
    ends_of = lambda words: (len(words), min(words), max(words)) if words else (0, None, None)
    alone = (0, None, None) * 2
    return [(w, n, *(ends_of(found[i][0]) + ends_of(found[i][1]) if i in found else alone)) for i, (w, n) in enumerate(zip(names, total)) if len(w) >= 3]


def learnt_names(texts: DataFrame, listed: list[tuple[str, str]], text: str = "post") -> list[tuple[str, str]]:
    """(name, kind) of names that are not listed, told from all texts: words that stand with a capital behind
    a listed given name or a title (family names) or before a listed family name (given names), beside two
    different ones at least and in `LEAST_SHARE` of their occurrences.

    The texts are counted in Arrow batches, then summed up by word with partial aggregation: the shuffle
    holds words, not texts. More than `MAX_NAMES` names are refused."""
    given, family = (frozenset(lowered(n.strip()) for n, k in listed if k == kind) for kind in ("given", "family"))
    if not given and not family:
        return []
    schema = "word string, n bigint, behind bigint, a string, b string, before bigint, c string, d string"
    counted = map_texts(texts.select(text), lambda: lambda rows: neighbours([t for (t,) in rows], given | frozenset(TITLES), family), schema)
    words = counted.groupBy("word").agg(*(F.sum(x).alias(x) for x in ("n", "behind", "before")), F.min("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c"), F.max("d").alias("d"))
    is_family, is_given = F.expr(f"a <> b and behind >= {LEAST_SHARE} * n"), F.expr(f"c <> d and before >= {LEAST_SHARE} * n")
    rows = words.where(is_family | is_given).select("word", F.coalesce(is_family, F.lit(False)), F.coalesce(is_given, F.lit(False))).limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"the texts hold more than {MAX_NAMES} names that are not listed")
    known = given | family | frozenset(TITLES)
    return [(w, kind) for w, f, g in rows for kind, yes in (("family", f and w not in family), ("given", g and w not in given)) if yes and w not in known]


def personal_mentions(texts: DataFrame, names: DataFrame, key: str = "rid", text: str = "post", learn: bool = True) -> DataFrame:
    """(key, kind, start_pos, length) of every mention; start_pos is 1-based, both in code points.

    Null and empty texts have none. One row per mention and input row: rows that repeat a key repeat
    its mentions. Other columns of `texts` are ignored. `learn` takes names from the texts as well.
    """
    listed = _names(names)
    if learn:
        listed += learnt_names(texts, listed, text)

    def make():
        finder = Finder(listed)

        def work(rows):
            for k, t in rows:
                if t:
                    for kind, a, b in finder.mentions(t):
                        yield k, kind, a + 1, b - a

        return work

    kind = texts.schema[key].dataType.simpleString()
    return map_texts(texts.select(key, text), make, f"{key} {kind}, kind string, start_pos bigint, length bigint")


def mask_personal(texts: DataFrame, names: DataFrame, placeholders: DataFrame, key: str = "rid", text: str = "post", learn: bool = True) -> DataFrame:
    """(key, text) with every mention replaced by the placeholder of its kind and nothing else changed.

    A kind without a placeholder gets `[KIND]`. Null texts stay null. Mentions are those of
    `personal_mentions`.
    """
    listed = _names(names)
    if learn:
        listed += learnt_names(texts, listed, text)
    held = placeholders.select("kind", "placeholder").dropna().distinct().limit(MAX_PLACEHOLDERS + 1).collect()
    if len(held) > MAX_PLACEHOLDERS:
        raise ValueError(f"more than {MAX_PLACEHOLDERS} placeholders")
    marks = {r[0]: r[1] for r in held}

    def make():
        finder = Finder(listed)

        def work(rows):
            for k, t in rows:
                if t:
                    at, parts = 0, []
                    for kind, a, b in finder.mentions(t):
                        parts += t[at:a], marks.get(kind, f"[{kind.upper()}]")
                        at = b
                    t = "".join(parts) + t[at:] if parts else t
                yield k, t

        return work

    kind = texts.schema[key].dataType.simpleString()
    return map_texts(texts.select(key, text), make, f"{key} {kind}, {text} string")
