"""Markup residue taken out of texts, structure kept.

One lexer reads HTML, Markdown, wiki and LaTeX markup into tokens; what lies between is text. Words
score positive, markup and symbols beside symbols negative, with weights fitted to the labelled pages
below; a linear scan finds the contiguous token range of maximal score, the content region. The kinds
of markup reported are those of the tokens in that region and beside it, so markup that is nowhere
near readable text is none. The clean text is what the region holds, written out plainly: headings as
`# `, items as `- `, code between ``` lines, formulas as they are.

Row-local: no shuffle, one Python pass in Arrow batches; texts without any sign that can start
markup are passed through without lexing. Constructs may be of any length, and a text is searched once
for each closer however often it is opened.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from html.entities import html5

from pyspark.sql import DataFrame

from .arrow import map_texts

#: A text with fewer words is no readable text.
LEAST_WORDS = 3

# Element names of HTML, and commands of LaTeX that take no argument in braces.
HTML_NAMES = (
    "a abbr address article aside audio b blockquote body br button canvas caption center cite code col colgroup dd del details div dl dt em fieldset "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav "
    "noscript object ol option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table "
    "tbody td textarea tfoot th thead time title tr tt u ul var video wbr"
).replace(" ", "|")
LATEX_BARE = "item|par|noindent|newline|newpage|maketitle|tableofcontents|centering|hline|bigskip|medskip|smallskip|quad|qquad|ldots|dots|LaTeX|TeX"

# What is opened here and closed somewhere behind; the ends are found by `_Ends`.
_OPENERS = r"""
    (?P<md_fence>^(?P<bar>```+|~~~+)[^\n`]*(?=\n))
  | (?P<html_gone><!--|<(?P<gone>script|style)\b[^>]*>)
  | (?P<html_code><pre\b[^>]*>)
  | (?P<tex_code>\\begin\{(?P<env>verbatim|lstlisting)\*?\})
  | (?P<tex_math>\\\[|\\\(|\$\$|\$(?=[^\s$]))
"""
_WHOLE = rf"""
    (?P<html_tag></?(?:{HTML_NAMES})(?:\s+[a-z][\w:-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*\s*/?>)
  | (?P<html_entity>&(?:[a-z][a-z0-9]{{1,30}}|\#[0-9]{{1,7}}|\#x[0-9a-f]{{1,6}});)
  | (?P<tex_head>\\(?:part|chapter|(?:sub){{0,2}}section|(?:sub)?paragraph)\*?\{{[^{{}}\n]*\}})
  | (?P<tex_env>\\(?:begin|end)\{{[a-z*]+\}}(?:\[[^\]\n]*\])?)
  | (?P<tex_ref>~?\\(?:cite[a-z]*|ref|label|eqref|pageref|index|bibliography|usepackage|documentclass|includegraphics)\*?(?:\[[^\]\n]*\])?\{{[^{{}}\n]*\}})
  | (?P<tex_item>^[ \t]*\\item\b(?:\[[^\]\n]*\])?[ \t]?)
  | (?P<tex_style>\\[a-z]+\*?(?:\[[^\]\n]*\])?\{{[^{{}}\n]*\}})
  | (?P<tex_bare>(?<![\w:\\])\\(?:{LATEX_BARE})\b)
  | (?P<tex_quote>``[^`'\n]+'')
  | (?P<tex_escape>\\[,;!%&_\#{{}}](?!\w*[/\\]))
  | (?P<tex_break>(?<=\s)\\\\(?=\s|$))
  | (?P<wiki_table>^\{{\|[^\n]*$|^\|\}}[ \t]*$|^\|-+[ \t]*$)
  | (?P<wiki_row>^[|!](?!-)[^|\n]*(?:\|\||!!)[^\n]*$)
  | (?P<wiki_gone>\[\[(?:category|file|image|kategorie|datei|catégorie|fichier|categoría|archivo)\s*:[^\[\]\n]*\]\]|\{{\{{[^{{}}]*\}}\}})
  | (?P<wiki_item>^[*\#:;]+[ \t]*(?=\[\[))
  | (?P<wiki_link>\[\[[^\[\]\n]+\]\])
  | (?P<wiki_url>\[https?://[^\s\]]+(?:[ ][^\]\n]*)?\](?!\())
  | (?P<wiki_head>^(?P<eq>={{2,6}})[ \t]*(?=[^\s=])[^\n]*?[^\s=][ \t]*(?P=eq)[ \t]*$)
  | (?P<wiki_style>'''''(?=\S)(?:[^\n']|'(?!''''))+'''''|'''(?=\S)(?:[^\n']|'(?!''))+'''|(?<![\w'])''(?=[^\s'])(?:[^\n']|'(?!'))*(?<![\s'])''(?![\w']))
  | (?P<md_image>!\[[^\[\]\n]*\]\([^()\n]*\))
  | (?P<md_link>\[(?:!\[[^\[\]\n]*\]\([^()\n]*\)|[^\[\]\n])+\]\((?:[^()\s]|\([^()\s]*\))+(?:\s"[^"\n]*")?\))
  | (?P<md_head>^[ ]{{0,3}}\#{{1,6}}[ \t]+(?!\[\[)\S[^\n]*$)
  | (?P<md_under>^(?=[^\n]*\w)[^\n|]+\n={{3,}}[ \t]*$)
  | (?P<md_rule>^[ ]{{0,3}}(?:\*[ \t]*){{3,}}$)
  | (?P<md_table>^[ \t]*\|?[ \t]*:?-{{3,}}:?[ \t]*(?:\|[ \t]*:?-{{3,}}:?[ \t]*)+\|?[ \t]*$)
  | (?P<md_quote>^>[ \t]?(?=\S))
  | (?P<md_code>`[^`\n]+`)
  | (?P<md_style>\*\*(?=[^\s*])[^*\n]+\*\*|(?<!\w)__(?=[^\W_])(?:[^\n_]|_(?!_))+(?<=[^\W_])__(?!\w)|~~(?=[^\s~])[^~\n]+~~)
"""
_LEXER, _REST = (re.compile(p, re.X | re.M | re.I) for p in (f"{_OPENERS} | {_WHOLE}", _WHOLE))
_SIGN = re.compile(r"[<&`*_#\[{\\$|~>]|==|''")
_KIND = {"html": "html", "md": "markdown", "wiki": "wiki", "tex": "latex"}
_WORD = re.compile(r"[^\W\d_]{2,}")
#: Symbols that stand with symbols.
_NOISE = re.compile(r"(?<=[^\w\s])[^\w\s]")
_APART = re.compile(rf"{_WORD.pattern}|{_NOISE.pattern}")
_BLOCKS = re.compile(r"</?(?:p|div|ul|ol|table|tr|blockquote|section|article|header|footer|nav|form|body|html|head|h[1-6]|li|dl|dt|dd|br|hr)\b", re.I)
_KEPT_TAGS = re.compile(r"</?(?:h[1-6]|p|br|ul|ol|li|dl|dt|dd|pre|code|blockquote|table|tr|td|th|b|i|em|strong|u|s|sub|sup|mark|small|q|cite)\b", re.I)
_PAGE_TAGS = re.compile(r"</?(?:nav|form|header|footer|script|style|iframe|button|select|option|input|link|meta)\b", re.I)
_LIMITS = re.compile(r"</?(?:nav|form|header|footer|script|style|iframe|button|select|option|input|link|meta|html|head|title|body)\b", re.I)
_LINK = re.compile(r"</?a\b", re.I)

#: So many links in a row without a word between them are a menu.
MENU = 3

#: Labelled pages for the weights, a blank line between pages: + lines are content, - lines are not.
LABELLED = """\
- <html><head><title>Garden notes</title><link rel="x"></head><body>
- <nav><a href="/">Home</a> <a href="/all">All posts</a> <a href="/in">Log in</a></nav>
+ <h1>Moving the compost</h1>
+ <p>We moved the compost heap behind the shed last week, and it is <b>much</b> better there.</p>
+ <p>The neighbours asked about it twice, so I wrote down what we did and why it worked.</p>
- <div class="side"><ul><li><a href="/t/1">tags</a></li><li><a href="/t/2">archive</a></li></ul></div>
- <form><input name="q"><button>Search</button></form>
- <footer><a href="/imprint">Imprint</a> <a href="/rss">RSS</a></footer></body></html>

- <div id="top"><img src="a.gif"><img src="b.gif"><a href="/">start</a> <a href="/shop">shop</a></div>
+ <h2>Opening hours in winter</h2>
+ <p>From November on the museum closes at four.<br>Groups can still book the <i>evening tour</i> by letter.</p>
+ <ul><li>Mondays we are closed</li><li>Tuesdays admission is free</li></ul>
+ <p>The lift is being repaired &amp; will run again after Easter, or so we hope.</p>
- <script>count(1)</script><iframe src="ad"></iframe><a href="/a">print</a> <a href="/b">share</a> <a href="/c">feed</a>

- {{infobox|name=Ferry|year=1911}} [[File:boat.jpg|thumb]]
+ '''The ferry''' has crossed the lake every hour since the railway bridge was closed to cars.
+ == History ==
+ It carries about forty people and, in summer, two or three [[bicycle|bicycles]] on each trip.
+ * [[lake]] steamers stop at the same pier
- [[Category:Boats]] [[Category:Lakes]] {{stub}}

- ![logo](logo.png) [start](/) [help](/help) [about](/about)
+ ## What I learned
+ After three tries the loaf finally rose. Keep the **water** cool and wait longer than you think.
+ > Patience is half the recipe, my teacher used to say.
+ Weigh the flour with `scale --zero` first, then add salt.
- ![a](1.png) ![b](2.png) [next](/2) [top](#)

- \\documentclass{article} \\usepackage{x} \\begin{document} \\maketitle \\tableofcontents
+ \\section{Results} The second series shows a clear rise, which we discuss in the next part.
+ Each group was measured twice and the mean is given as $m = s/n$ in the table below.
+ As \\emph{expected}, the third sample dried faster than the others did.
- \\bibliography{refs} \\end{document}

- <a href="/1">news</a> <a href="/2">sport</a> <a href="/3">weather</a> <a href="/4">travel</a>
+ The council met on Tuesday and put off the vote on the new cycle path.
- ~*$ #_|= ^^ ~~ $$ %% && ## @@ ** __ || == ~^ #~
"""


def _shape(name: str, source: str) -> str:
    """The class a token is weighed by; `kept` is the structure that stays in the clean text."""
    if name == "html_tag":
        return "page" if _PAGE_TAGS.match(source) else "kept" if _KEPT_TAGS.match(source) else "block" if _BLOCKS.match(source) else "inline"
    if name in ("html_gone", "wiki_gone", "tex_ref", "md_image"):
        return "page"
    if name in ("tex_env", "md_rule"):
        return "block"
    return "inline" if name in ("wiki_link", "wiki_url", "md_link", "tex_bare") else "kept"


class _Ends:
    """Where constructs that were opened in a text end. The place found for a closer serves all openers before
    it, so a text is searched once for each closer however many openers it has."""

    def __init__(self, text: str):
        self.text, self.found = text, {}

    def next(self, closer: str, at: int) -> re.Match | None:
        """The first match of `closer` from `at` on."""
        last = self.found.get(closer)
        if last is None or (last[1] is not None and last[1].start() < at) or last[0] > at:
            last = self.found[closer] = (at, re.compile(closer, re.I | re.M).search(self.text, at))
        return last[1]

    def of(self, name: str, opener: re.Match) -> int | None:
        """The end of the construct, None if it isn't one."""
        at = opener.end()
        if name == "tex_math":
            return self._formula(opener[0], at)
        closer = (
            rf"^{re.escape(opener['bar'])}[ \t]*$" if name == "md_fence" else "-->" if opener[0] == "<!--" else rf"</{opener['gone'].lower()}\s*>" if name == "html_gone"
            else r"</pre\s*>" if name == "html_code" else rf"\\end\{{{opener['env'].lower()}\*?\}}"
        )
        end = self.next(closer, at)
        return end and end.end()

    def _formula(self, opener: str, at: int) -> int | None:
        if opener[0] == "$":
            end = self.text.find("$", at)
            inside = self.text[at:end] if end > at else ""
            closed = inside and ("\n" not in inside if opener == "$" else self.text.startswith("$$", end))
            return end + len(opener) if closed and any(c in inside for c in "\\^_=") else None
        end = self.next(r"\\\]" if opener == "\\[" else r"\\\)", at)
        return end.end() if end and end.start() > at and (opener == "\\[" or self.text.find("\n", at, end.start()) < 0) else None


def tokens(text: str) -> list[tuple[str, str]]:
    """(class, source) in order; class `text` for what is no markup."""
    out, done, at, ends = [], 0, 0, _Ends(text)
    while m := _LEXER.search(text, at):
        name = next(k for k in _CLASSES if k in m.re.groupindex and m[k] is not None)
        end = ends.of(name, m) if name in _OPENED else m.end()
        if end is None and (m := _REST.match(text, m.start()) or m).re is _REST:
            name, end = next(k for k in _CLASSES if k in _REST.groupindex and m[k] is not None), m.end()
        if name == "html_entity" and m[0][1] != "#" and m[0][1:] not in html5:
            end = None
        at = m.start() + 1 if end is None else max(end, m.start() + 1)
        if end is None:
            continue
        if m.start() > done:
            out.append(("text", text[done : m.start()]))
        out.append((name, text[m.start() : at]))
        done = at
    if done < len(text):
        out.append(("text", text[done:]))
    return out


_OPENED = ("md_fence", "html_gone", "html_code", "tex_code", "tex_math")
_CLASSES = [k for k in _LEXER.groupindex if "_" in k]


def _features(name: str, source: str) -> tuple[int, int, str | None]:
    """Words a token shows, symbols beside symbols in it, and the class it is weighed by, None for text."""
    if name == "text":
        return len(_WORD.findall(source)), len(_NOISE.findall(source)), None
    return len(_WORD.findall(plain(name, source))), 0, _shape(name, source)


def _scan(features: list[tuple[int, int, str | None]], weights: dict[str, float]) -> tuple[int, int, int]:
    """First token, end and number of words of the range of maximal score that has words, the longest of
    equals. Words score above 0, markup and symbols beside symbols below."""
    best, score, since, seen, since_seen = (0.0, 0, 0, 0), 0.0, 0, 0, 0
    for i, (n, marks, shape) in enumerate(features):
        score += weights["word"] * n + weights["noise"] * marks + (weights[shape] if shape else 0.0)
        seen += n
        if score >= best[0] and seen > since_seen:
            best = (score, since, i + 1, seen - since_seen)
        if score < 0:
            score, since, since_seen = 0.0, i + 1, seen
    return best[1:]


def _fit(pages: str, steps: tuple[float, ...] = (0.05, 0.1, 0.2, 0.4, 0.8, 1.2, 1.6, 2.4, 3.2)) -> dict[str, float]:
    """Weights of a word and of each class of token: a word scores 1, the others are chosen from -`steps`, one
    class at a time until nothing changes, for the fewest words on the wrong side of the region's borders in
    the labelled pages. Of equals the weight nearest to the class' log-odds, content against the rest, wins."""
    pages_of = [[(_features(*t), line[0]) for line in page.splitlines() for t in tokens(line[2:] + "\n")] for page in pages.split("\n\n")]
    seen = {"+": Counter(), "-": Counter()}
    for (_, marks, shape), side in (x for page in pages_of for x in page):
        seen[side].update({"noise": marks} if shape is None else {shape: 1})
    classes = ("kept", "inline", "block", "page", "noise")
    total = {k: sum(c.values()) + len(classes) for k, c in seen.items()}
    odds = {c: math.log((seen["+"][c] + 1) / total["+"]) - math.log((seen["-"][c] + 1) / total["-"]) for c in classes}
    weights = {"word": 1.0} | {c: -min(steps, key=lambda x: abs(odds[c] + x)) for c in classes}

    def wrong(weights: dict[str, float]) -> int:
        out = 0
        for page in pages_of:
            first, end, _ = _scan([f for f, _ in page], weights)
            out += sum(f[0] for i, (f, side) in enumerate(page) if (first <= i < end) != (side == "+"))
        return out

    for _ in range(10):
        old = dict(weights)
        for c in classes:
            weights[c] = -min(steps, key=lambda x: (wrong(weights | {c: -x}), abs(odds[c] + x)))
        if weights == old:
            break
    return weights


def region(parts: list[tuple[str, str]]) -> tuple[int, int, int]:
    """First token, end and number of words of the content region: the range of maximal score."""
    return _scan([_features(*p) for p in parts], WEIGHTS)


def readable(parts: list[tuple[str, str]]) -> tuple[int, int, int]:
    """The content region with what `_reach` finds beside it."""
    first, end, words = region(parts)
    if end:
        first, end = first - _reach(parts[:first][::-1]), end + _reach(parts[end:])
    return first, end, words


def around(parts: list[tuple[str, str]]) -> tuple[int, int, int]:
    """First token and end of the readable region with the markup that touches it on either side, up to the
    next text with a word or noise; the number of words in it."""
    first, end, words = readable(parts)
    if end:
        while first and not _APART.search(parts[first - 1][1] if parts[first - 1][0] == "text" else ""):
            first -= 1
        while end < len(parts) and not _APART.search(parts[end][1] if parts[end][0] == "text" else ""):
            end += 1
        words = sum(_features(*p)[0] for p in parts[first:end])
    return first, end, words


def _reach(parts: list[tuple[str, str]]) -> int:
    """How many of the tokens beside the region, nearest first, belong to it: those up to a part of the page,
    a menu or noise, without what shows nothing at the far end. A lone link or a short sentence weighs less than
    the markup around it, but its words are content."""
    reach, links, menu, inside = 0, 0, 0, False
    for i, (name, source) in enumerate(parts):
        if name == "html_tag" and _LIMITS.match(source) or name == "text" and len(_NOISE.findall(source)) > len(_WORD.findall(source)):
            break
        shown = source if name == "text" else plain(name, source)
        link = name in ("md_link", "wiki_url")
        if name == "html_tag" and _LINK.match(source):
            inside = not inside  # read backwards, the closing tag comes first
            link = inside
        elif not link and not inside and (_WORD.search(shown) or name == "text" and "\n" in shown):
            links = 0
        if link:
            links, menu = links + 1, menu if links else i
            if links == MENU:
                return min(reach, menu)
        shape = "text" if name == "text" else _shape(name, source)
        if shape == "kept" or shape != "page" and re.search(r"\w", shown):
            reach = i + 1
    return reach


def plain(name: str, source: str) -> str:
    """What a token leaves in the clean text."""
    if name == "html_entity":
        return html.unescape(source).replace("\xa0", " ")
    if name == "html_code":
        inner = html.unescape(re.sub(r"<[^>]*>", "", source))
        return f"\n```\n{inner.strip(chr(10))}\n```\n"
    if name == "html_tag":
        tag = re.match(r"</?([a-z0-9]+)", source, re.I)[1].lower()
        opening = source[1] != "/"
        if re.fullmatch(r"h[1-6]", tag):
            return "\n" + "#" * int(tag[1]) + " " if opening else "\n"
        if tag == "li":
            return "\n- " if opening else ""
        if tag in ("td", "th"):
            return " | " if opening else ""
        if tag == "code":
            return "`"
        return "\n" if _BLOCKS.match(source) else ""
    if name == "md_fence":
        return source
    if name == "tex_code":
        return "\n```\n" + re.sub(r"^\\begin\{[^}]*\}|\\end\{[^}]*\}$", "", source).strip("\n") + "\n```\n"
    if name in ("tex_math", "md_code", "md_head"):
        return source
    if name == "tex_head":
        depth = 1 + source.count("sub")
        return "\n" + "#" * depth + " " + source[source.index("{") + 1 : -1] + "\n"
    if name == "tex_item":
        return "- "
    if name == "tex_style":
        return source[source.rindex("{") + 1 : -1]
    if name == "tex_quote":
        return '"' + source[2:-2] + '"'
    if name == "tex_escape":
        return " " if source[1] in ",;!" else source[1]
    if name == "tex_break":
        return "\n"
    if name == "tex_bare":
        return {"ldots": "…", "dots": "…", "LaTeX": "LaTeX", "TeX": "TeX"}.get(source[1:], " ")
    if name == "wiki_row":
        return "| " + re.sub(r"\s*(?:\|\||!!)\s*", " | ", source[1:].strip())
    if name == "wiki_item":
        return "- "
    if name == "wiki_link":
        return source[2:-2].split("|")[-1]
    if name == "wiki_url":
        return source[1:-1].partition(" ")[2]
    if name == "wiki_head":
        depth = len(source) - len(source.lstrip("="))
        return "#" * depth + " " + source.strip().strip("=").strip()
    if name == "wiki_style":
        return source.strip("'")
    if name == "md_image":
        return source[2 : source.index("]")]
    if name == "md_link":
        return source[1 : source.index("](")]
    if name == "md_under":
        return "# " + source.split("\n")[0].strip()
    if name == "md_style":
        return source[2:-2]
    return ""


def kinds(text: str | None) -> list[str]:
    """The kinds of markup around readable text, sorted: those of the tokens in the content region or beside
    it, where that has `LEAST_WORDS` words."""
    if not text or not _SIGN.search(text):
        return []
    parts = tokens(text)
    if all(name == "text" for name, _ in parts):
        return []
    first, end, words = around(parts)
    return sorted({_KIND[name.partition("_")[0]] for name, _ in parts[first:end] if name != "text"}) if words >= LEAST_WORDS else []


def clean(text: str | None) -> str | None:
    """The content region without markup; a text without markup as it is, one without words as it is."""
    if not text or not _SIGN.search(text):
        return text
    parts = tokens(text)
    first, end, words = readable(parts)
    if words == 0 or all(name == "text" for name, _ in parts):
        return text
    out = "".join(source if name == "text" else plain(name, source) for name, source in parts[first:end])
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", out)).strip()


WEIGHTS = _fit(LABELLED)


def markup_kinds(texts: DataFrame, key: str = "rid", text: str = "post") -> DataFrame:
    """(key, markup), one row per kind in each input row; null, empty and unmarked texts have none."""
    kind = texts.schema[key].dataType.simpleString()
    return map_texts(texts.select(key, text), lambda: lambda rows: ((k, m) for k, t in rows for m in kinds(t)), f"{key} {kind}, markup string")


def clean_markup(texts: DataFrame, key: str = "rid", text: str = "post") -> DataFrame:
    """(key, text) without markup; null stays null."""
    kind = texts.schema[key].dataType.simpleString()
    return map_texts(texts.select(key, text), lambda: lambda rows: ((k, clean(t)) for k, t in rows), f"{key} {kind}, {text} string")
