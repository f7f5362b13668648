"""Personal information, reading levels, markup and line labels."""

import random

import pytest

from lexmill.llm.markup import clean, clean_markup, kinds, markup_kinds
from lexmill.llm import personal_info as P
from lexmill.llm.personal_info import Finder, learnt_names, mask_personal, personal_mentions
from lexmill.llm.reading_level import fit, reading_levels
from lexmill.llm.text_quality import line_labels, text_statistics

TEXTS = "rid bigint, post string, kind string, level int, text string"
NAMES = [(g + e, "given") for g in ("Bren", "Cal", "Dor", "Fen") for e in ("elle", "on", "isa")] + [(s + e, "family") for s in ("Brack", "Crow", "Dray", "Moss") for e in ("worth", "isch", "ova")]


@pytest.fixture(scope="module")
def finder():
    return Finder(NAMES)


def test_names_are_learnt_from_the_texts(spark):
    listed = [("Anna", "given"), ("Paul", "given"), ("Miller", "family"), ("Stone", "family")]
    texts = [
        "Anna Quimby told me.", "ask Paul Quimby, he knows", "Mr. Drax was here", "Anna Drax too", "Vera Miller and", "then Vera Stone left", "Paul said so", "Anna said it", "Paul Never again",
        "Anna Never again", "never never never never never never never never never never never never never never never never never never never", "Anna Once only", None, "", "Anna\nQuimby",
    ]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], TEXTS)
    assert set(learnt_names(df, listed)) == {("quimby", "family"), ("drax", "family"), ("vera", "given")}
    assert learnt_names(df.where("false"), listed) == learnt_names(df, []) == []
    names = spark.createDataFrame(listed, "name string, kind string")
    found = {(r.rid, r.start_pos) for r in personal_mentions(df.where("rid < 6"), names).collect()}
    assert found == {(0, 1), (1, 5), (2, 5), (3, 1), (4, 1), (5, 6)}
    assert {(r.rid, r.start_pos) for r in personal_mentions(df.where("rid < 6"), names, learn=False).collect()} == {(4, 6), (5, 11)}


def test_bounds_refuse_loudly(spark, monkeypatch):
    names = spark.createDataFrame(NAMES, "name string, kind string")
    df = spark.createDataFrame([(1, "Brenelle Quimby, Fenisa Quimby, Calon Drax, Doron Drax", "x", 1, "y")], TEXTS)
    monkeypatch.setattr(P, "MAX_NAMES", 1)
    with pytest.raises(ValueError):
        learnt_names(df, NAMES)
    with pytest.raises(ValueError):
        personal_mentions(df, names)
    monkeypatch.undo()
    monkeypatch.setattr(P, "MAX_PLACEHOLDERS", 1)
    with pytest.raises(ValueError):
        mask_personal(df, names, spark.createDataFrame([("email", "[E]"), ("name", "[N]")], "kind string, placeholder string"))


@pytest.mark.parametrize(
    "lead, mention, kind",
    [
        ("Write to ", "x" * 120 + "@mail.example", "email"), ("Write to ", "a." * 5_000 + "b@mail.example", "email"), ("signed by ", "Brenelle " * 40 + "Crowova", "name"),
        ("lives at ", "12 " + "Q" + "u" * 80 + " Road", "address"), ("near ", "C/ " + "Olmo" * 30 + " 185", "address"),
    ],
)
def test_long_mentions_are_whole(finder, lead, mention, kind):
    assert finder.mentions(lead + mention + ", they say") == [(kind, len(lead), len(lead + mention))]


def test_order_words_count_however_long(finder):
    assert finder.mentions("bestellnummernverzeichniseintrag nr 07700 900179") == []


@pytest.mark.parametrize(
    "text, kind, mention",
    [
        ("Write to a.b+c@mail.example now", "email", "a.b+c@mail.example"),
        ("mailto:joe_9 (at) mail (dot) example works", "email", "joe_9 (at) mail (dot) example"),
        ("reach me (joe at mail dot example)", "email", "joe at mail dot example"),
        ("Call +33 6 39 98 53 80 after six", "phone", "+33 6 39 98 53 80"),
        ("new: (202) 555-0141!", "phone", "(202) 555-0141"),
        ("tel (0)30 23125 475, ask", "phone", "(0)30 23125 475"),
        ("my SSN, 000-15-6473 and", "id_number", "000-15-6473"),
        ("with national insurance number QQ 39 12 11 C twice", "id_number", "QQ 39 12 11 C"),
        ("tax ID 03/457/61212 on it", "id_number", "03/457/61212"),
        ("lives at Flat 1, 207 Quarry Road.", "address", "Flat 1, 207 Quarry Road"),
        ("parcel to 107 bis rue des Tilleuls", "address", "107 bis rue des Tilleuls"),
        ("near Lindenstraße 47, reward", "address", "Lindenstraße 47"),
        ("Calle del Olmo 185 is it", "address", "Calle del Olmo 185"),
        ("ask for Prof. Crowova-Brackisch now", "name", "Crowova-Brackisch"),
        ("signed Brenelle K. CROWWORTH.", "name", "Brenelle K. CROWWORTH"),
        ("Mossova, Fenisa told me", "name", "Mossova, Fenisa"),
    ],
)
def test_mentions(finder, text, kind, mention):
    assert [(k, text[a:b]) for k, a, b in finder.mentions(text)] == [(kind, mention)]


@pytest.mark.parametrize(
    "text",
    [
        "The file icon@2x.png is missing.", "Order no. 000-82-1758 arrived.", "Ticket 4471-6019-18 is open, tracking number 5495399115 too.", "ISBN 978-0-22-533027-3",
        "Bus 76 Avenue stop was closed.", "Chapter 33 Lane changes are boring.", "Part number X29162239", "Coordinates 51.4757, -0.7897", "@crowova_18 says hi",
        "Brenelle is a given name", "Follow @user_27", "top 10 bike lane", "",
    ],
)
def test_lookalikes(finder, text):
    assert finder.mentions(text) == []


def test_masking_keeps_the_rest(spark):
    text = "👍 İ Regards, Brenelle Crowova (a@b.example) — done"
    rows = [(1, text, "x", 1, "y"), (2, None, "x", 1, "y"), (3, "", "x", 1, "y"), (4, "nothing here", "x", 1, "y"), (4, "nothing here", "x", 1, "y")]
    df = spark.createDataFrame(rows, TEXTS)
    names, marks = spark.createDataFrame(NAMES, "name string, kind string"), spark.createDataFrame([("email", "[EMAIL]")], "kind string, placeholder string")
    got = [tuple(r) for r in mask_personal(df, names, marks).collect()]
    assert sorted(got, key=repr) == sorted([(1, "👍 İ Regards, [NAME] ([EMAIL]) — done"), (2, None), (3, ""), (4, "nothing here"), (4, "nothing here")], key=repr)
    found = {(r.kind, r.start_pos) for r in personal_mentions(df, names).collect()}
    assert found == {("name", text.index("Brenelle") + 1), ("email", text.index("a@b") + 1)}
    assert personal_mentions(df.where("false"), names).count() == 0


def test_long_text_is_read_to_its_end(spark):
    text = "All quiet here. " * 60_000 + "Call 202-555-0141 now"
    df = spark.createDataFrame([(1, text, "x", 1, "y")], TEXTS)
    assert [r.start_pos for r in personal_mentions(df, spark.createDataFrame(NAMES, "name string, kind string")).collect()] == [text.index("202") + 1]


@pytest.mark.parametrize(
    "text, want",
    [
        ("<p>We met <b>them</b> at the old bridge.</p>", ["html"]), ("Fish &amp; chips again today", ["html"]), ("This was **really** good for all of us", ["markdown"]),
        ("Ferry\n========\n\nIt left at noon again", ["markdown"]), ("see [[bus stop|the stop]] near the market", ["wiki"]), ("== History ==\nIt was built long ago", ["wiki"]),
        ("as \\emph{shown} before~\\cite{x1} in the text", ["latex"]), ("we get $x^2 + 7x = 60$ from the sum", ["latex"]), ("``shift'' costs about 6\\,\\% now they say", ["latex"]),
        ("I <3 this & that, 5 * 6 * 2 and A -> B", []), ("mail <joe@mail.example> or me", []), ("It was $5 then and $15 now", []), ("=*-|_=**~$^{}<>[]", []), ("C:\\temp\\new\\file is \\o/", []),
        ("#one #two at http://x.example/a_b_c", []), ("They said [sic] a < b and b > 7", []), ("", []), (None, []),
    ],
)
def test_markup_kinds(text, want):
    assert kinds(text) == want


LONG = "7 x + " * 600


@pytest.mark.parametrize(
    "text, want",
    [
        (f"we get \\[ {LONG} = 0 \\] from the sum", ["latex"]), (f"we get \\( {LONG} \\) from the sum", ["latex"]), (f"we get $${LONG}= 0$$ from the sum", ["latex"]),
        (f"we get ${LONG}= 0$ from the sum", ["latex"]), (f"they said ``{LONG}'' about the sum", ["latex"]), (f"A heading of many words {LONG}\n=====\nIt left at noon", ["markdown"]),
    ],
)
def test_markup_of_any_length(text, want):
    assert len(text) > 2001 and kinds(text) == want


@pytest.mark.parametrize("text", [x * 50_000 + " three plain words" for x in ("<!--", "<pre>", "\\[", "\\(\n", "$$", "$a ", "{{", "```\n", "<script>", "\\begin{verbatim}", "``a", "&", "''a ")])
def test_unclosed_markup_takes_linear_time(text):
    kinds(text), clean(text)


def test_what_is_opened_and_never_closed():
    assert kinds("<pre>three plain words here") == ["html"] and kinds("we had \\[ three plain words") == [] and kinds("```\nthree plain words") == []


def test_the_region_decides():
    far = " ~#_ ^^ ## @@ ~~ ^^ || ^^ @@ `x`"
    assert kinds("We left the harbour at noon and came home late.<b></b>" + far) == ["html"]
    assert kinds("We left the <b>harbour</b> at noon and came home late.") == ["html"]
    assert kinds("<b>~#_ ^^ $$</b>") == kinds("<i></i>") == []


def test_structure_is_kept():
    html = "<nav><a href='/'>Home</a></nav><h2>Soup</h2><p>Cut the onions &amp; fry them.</p><ul><li>salt</li><li>two eggs</li></ul><pre><code>x &lt; 5</code></pre><script>track(1)</script>"
    out = clean(html)
    assert "## Soup" in out and "- two eggs" in out and "```\nx < 5\n```" in out and "onions & fry" in out and "track" not in out and "<" not in out.replace("x < 5", "")
    assert clean("\\section{Ferry} It holds $m = s/n$ here.\n\\begin{itemize}\n\\item one thing\n\\end{itemize}").startswith("# Ferry")
    assert "$m = s/n$" in clean("It holds $m = s/n$ \\emph{here} again")
    assert clean("'''Bold''' and [[a|the b]] stay") == "Bold and the b stay"
    assert clean("plain text stays as it is ") == "plain text stays as it is " and clean(None) is None


@pytest.mark.parametrize(
    "text, want",
    [
        ("[dough](https://n.example/1) You know the old recipe", "dough You know the old recipe"), ("You know the old recipe, the [dough](https://n.example/1)", "You know the old recipe, the dough"),
        ("<a href='/1'>pond</a> We watered the slug trap", "pond We watered the slug trap"), ("It was long ago \\cite{x1} they say.", "It was long ago  they say."),
        ("===ferry===\n# [[sunburn]]\n# [[museum]]\nIt left at noon again", "### ferry\n- sunburn\n- museum\nIt left at noon again"),
        ("Any tips? <!-- ad slot 11 --> <a href='/2'>Soup</a> was cold again today", "Any tips?  Soup was cold again today"),
        ("We met at noon.<table><tr><td>map</td><td>51</td></tr></table>", "We met at noon.\n\n | map | 51"),
        ("[start](/) [help](/help) [about](/about)\nThe loaf finally rose after three tries", "The loaf finally rose after three tries"),
    ],
)
def test_readable_edges_stay(text, want):
    assert clean(text) == want


def test_markup_tables(spark):
    df = spark.createDataFrame([(1, "<b>very</b> nice and good", "k", 1, "t"), (2, None, "k", 1, "t"), (3, "<i>" * 20_000 + "word two three", "k", 1, "t")], TEXTS)
    assert {tuple(r) for r in markup_kinds(df).collect()} >= {(1, "html"), (3, "html")}
    assert {r.rid: r.post for r in clean_markup(df).collect()}[2] is None
    assert markup_kinds(df.where("false")).count() == 0


def graded():
    words = {level: [f"w{'abcdefghij'[level]}{x}{y}" for x in "klm" for y in "nopq"] for level in range(1, 6)}
    shared = ["the", "and", "was", "with"]
    rng = random.Random(4)

    def text(level, n=40):
        return " ".join(rng.choice(words[level] if rng.random() < 0.5 else shared + words[max(1, level - 1)]) for _ in range(n))

    return text


def test_levels_of_held_out_texts():
    text = graded()
    scale = fit([(text(v), v) for v in range(1, 6) for _ in range(12)])
    right = [scale.levels([text(v)])[0][0] == v for v in range(1, 6) for _ in range(20)]
    assert sum(right) / len(right) > 0.9


def test_every_text_with_words_gets_an_estimate(spark):
    text = graded()
    samples = spark.createDataFrame([(text(v), v) for v in range(1, 6) for _ in range(8)], "text string, level int")
    rows = [(1, text(5), "k", 9, "t"), (2, None, "k", 9, "t"), (3, "=*-|", "k", 9, "t"), (4, "ja nein doch vielleicht immer nie", "k", 9, "t"), (5, "waky", "k", 9, "t"), (6, "wakn the", "k", 9, "t")]
    got = {r.rid: r for r in reading_levels(spark.createDataFrame(rows, TEXTS), samples).collect()}
    assert got[1].estimate == got[1].level == 5 and got[1].confidence == 1
    assert got[2].estimate is got[3].estimate is got[2].confidence is got[3].confidence is None
    assert all(1 <= got[i].estimate <= 5 and got[i].level is None and got[i].confidence < 0.5 for i in (4, 5, 6))


def test_words_never_seen_are_graded_by_their_form():
    rng = random.Random(5)
    words = {v: ["".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(v)) + ("" if v < 3 else "tion" if v == 5 else "er") for _ in range(60)] for v in range(1, 6)}
    scale = fit([(" ".join(rng.choices(words[v][:30], k=40)), v) for v in range(1, 6) for _ in range(12)])
    told = [scale.levels([" ".join(rng.choices([w for w in words[v][30:] if w not in scale.grades], k=40))])[0][2:] for v in range(2, 6)]
    assert [round(c, 6) for _, c in told] == [0] * 4 and all(abs(level - v) <= 1 for (level, _), v in zip(told, range(2, 6))) and told[0][0] < told[-1][0]


def test_a_style_the_samples_lack():
    """Texts of the top level whose words no sample has, told apart by the form of the words."""
    rng = random.Random(8)
    hard = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(4)) + rng.choice(["tion", "ism", "ence", "ical"])
    easy = lambda: rng.choice("bcdfglmnprstv") + rng.choice("aeiou") + rng.choice("bdgnpt")
    pools = {1: [easy() for _ in range(60)], 2: [easy() + easy() for _ in range(60)], 3: [hard() for _ in range(60)]}
    shared = ["the", "and", "of", "is"]
    text = lambda pool: " ".join(rng.choice(shared) if rng.random() < 0.3 else rng.choice(pool) for _ in range(40))
    scale = fit([(text(pools[v]), v) for v in pools for _ in range(12)])
    right = [scale.levels([text([hard() for _ in range(60)])])[0][0] == 3 for _ in range(20)] + [scale.levels([text([easy() for _ in range(60)])])[0][0] != 3 for _ in range(20)]
    assert sum(right) >= 36


def test_level_edges(spark):
    text = graded()
    samples = spark.createDataFrame([(text(v), v) for v in range(1, 6) for _ in range(8)] + [(None, 1), ("x", None)], "text string, level int")
    rows = [(1, text(5), "k", 9, "t"), (2, None, "k", 9, "t"), (3, "", "k", 9, "t"), (4, "ja nein doch vielleicht immer nie", "k", 9, "t"), (5, text(1, 20_000), "k", 9, "t")]
    got = {r.rid: r.level for r in reading_levels(spark.createDataFrame(rows, TEXTS), samples).collect()}
    assert got == {1: 5, 2: None, 3: None, 4: None, 5: 1}
    with pytest.raises(ValueError):
        fit([("a b", 1), (None, 2)])


COMMON = [("en", w) for w in "the and a to of in it is was i my that but for on we they not with so because this".split()]


@pytest.mark.parametrize(
    "text, kind",
    [
        ("We found three maps on Sunday and I would do it again. It was on sale, so we took it.", "prose"),
        ("we found three maps on sunday and i would do it again\nit was on sale so we took it\n", "prose"),
        ("(1) bread\n(2) old kettle\n(3) saddle\n(4) pump\n(5) bell", "list"),
        ("to buy: bread, old kettle, saddle, pump, new bell, chain", "list"),
        ("lamp\t4\t22.30\nchair\t12\t170.05\nsofa\t1\t99.00", "table"),
        ("lamp                     4    22.30\nchair                   12   170.05", "table"),
        ("spam spam spam spam spam spam spam spam spam", "junk"),
        ("Home Login Search Top FAQ Home Join Next Top Search", "junk"),
        ("gkaw fjaq lskd wqe dhag fjwe klqs akdj hgaf sldk", "junk"),
        ("~!+=$*=%?$%=*+!&#=#&+&#$#@=#+@~^%&*", "junk"),
        ("ok", "prose"), ("", "prose"), (None, "prose"),
    ],
)
def test_line_labels(spark, text, kind):
    df = spark.createDataFrame([(1, text, "k", 1, "t")], TEXTS)
    row = line_labels(df, spark.createDataFrame(COMMON, "lang string, word string")).first()
    assert row.kind == kind and row.prose + row.list + row.table + row.junk == pytest.approx(1)


def test_statistics_edges(spark):
    df = spark.createDataFrame([(1, None, "k", 1, "t"), (2, "", "k", 1, "t"), (3, " \n ", "k", 1, "t"), (4, "The cat.\nIt!", "k", 1, "t")], TEXTS)
    got = {r.rid: r for r in text_statistics(df, spark.createDataFrame(COMMON, "lang string, word string")).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_lines == 0 and got[1].symbol_ratio == 0
    assert (got[4].n_words, got[4].n_lines, got[4].end_punct_share) == (3, 2, 1.0) and got[4].common_share == pytest.approx(2 / 3)
    assert line_labels(df.where("false"), spark.createDataFrame(COMMON, "lang string, word string")).count() == 0
