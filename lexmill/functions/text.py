"""Text functions as column expressions. Every function takes null as the empty text."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The patterns that decide what is a token, a tag, an address and so on.
NON_WORD = r"[^\p{L}\p{N}_]+"
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Plain classes of those characters: Java's own Unicode classes ask for a property of every character.
SPACE, NO_SPACE = f"[{WHITE}]", f"[^{WHITE}]"
SPACES = SPACE + "+"
TAG = r"<[^>]+>"
LINK = rf"https?://{NO_SPACE}+|www\.{NO_SPACE}+"
LINK_STRICT = r"(?:https?://|www\.)[$-_a-z!]+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
MENTION, HASHTAG = r"(?U)@\w+", r"(?U)#(\w+)"
REPEATS = r"([^\n])\1{2,}"
SENTENCE_END, VOWELS = r"[.!?]+", r"[aeiouy]+"


def full(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(WHITE))


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-cased word-character runs made of ASCII letters only, of `least` letters or more, in order."""
    return F.filter(F.split(F.lower(full(text)), NON_WORD), lambda w: w.rlike(f"^[a-z]{{{least},}}$"))


def squeeze_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def clean(text: Column) -> Column:
    """Without tags and links, lower-cased, white space squeezed."""
    out = F.regexp_replace(F.regexp_replace(full(text), TAG, " "), LINK, " ")
    return squeeze_spaces(F.lower(out))


@F.pandas_udf(StringType())
def _ascii(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def ascii_only(text: Column) -> Column:
    """Compatibility decomposition, then ASCII characters only. Plain ASCII texts, the usual case, stay
    out of Python."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _ascii(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


@dataclass(frozen=True)
class Cleaner:
    """A configurable cleaner; the steps are taken in the order of the fields."""

    ascii: bool = True
    html: bool = True
    urls: bool = True
    emails: bool = True
    mentions: bool = True
    hashtags: bool = False
    repeats: bool = True
    lowercase: bool = True

    def __call__(self, text: Column) -> Column:
        """The cleaned text; a blank one is empty."""
        raw = full(text)
        out = ascii_only(raw) if self.ascii else raw
        for on, pattern in ((self.html, TAG), (self.urls, LINK_STRICT), (self.emails, EMAIL), (self.mentions, MENTION)):
            if on:
                out = F.regexp_replace(out, pattern, " ")
        out = F.regexp_replace(out, HASHTAG, " " if self.hashtags else "$1")
        if self.repeats:
            out = F.regexp_replace(out, REPEATS, "$1$1")
        if self.lowercase:
            out = F.lower(out)
        return F.when(raw.rlike(NO_SPACE), squeeze_spaces(out)).otherwise("")


def language_guess(text: Column) -> Column:
    """`en`, `mixed` or `other` by the share of ASCII characters; `unknown` for fewer than 10 characters."""
    t = full(text)
    n = F.length(t)
    share = F.length(F.regexp_replace(t, r"[^\x00-\x7F]", "")) / F.greatest(n, F.lit(1))
    return F.when(n < 10, "unknown").when(share > 0.9, "en").when(share > 0.7, "mixed").otherwise("other")


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(full(text), SENTENCE_END), lambda s: s.rlike(NO_SPACE)))


def syllables(word: Column) -> Column:
    """Vowel runs, one less for a final e, one at least."""
    runs = F.size(F.regexp_extract_all(word, F.lit(VOWELS), F.lit(0)))
    return F.greatest(F.lit(1), runs - F.when(word.endswith("e") & (runs > 1), 1).otherwise(0))


def joined(values: Column) -> Column:
    """An array of texts as one text, nulls left out; null is empty."""
    return F.coalesce(F.array_join(values, " "), F.lit(""))


def flattened(values: Column) -> Column:
    """An array of arrays of texts as one text, nulls on either level left out; null is empty."""
    return joined(F.flatten(F.array_compact(values)))
