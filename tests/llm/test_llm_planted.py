"""Recall and precision over the posts of the test tables with cases planted in them, and agreement with labels."""

import random

import pyarrow.parquet as pq
import pytest
from conftest import SF

from lexmill.llm import languages as L
from lexmill.llm.markup import kinds
from lexmill.llm.personal_info import Finder
from lexmill.llm.text_quality import label_texts


@pytest.fixture(scope="module")
def posts():
    """Posts in which nothing is found, of some length."""
    texts = [t for n in ("political_leaning", "birth_year", "nationality") for t in pq.read_table(f"{SF}/{n}.parquet", columns=["post"]).column(0).to_pylist()]
    return [t for t in dict.fromkeys(texts) if t and 40 < len(t) < 400 and t.isprintable()]


def scores(found, true):
    return len(found & true) / len(true), len(found & true) / max(1, len(found))


MARKUP = {
    "html": ["<b>{}</b>", "<p>{}</p>", "<a href='/x'>{}</a>", "{} &nbsp; {}", "<div class='c'>{}<br/></div>"],
    "markdown": ["**{}**", "[{}](http://x.example/a)", "## {}\n", "`{}`", "> {}"],
    "wiki": ["'''{}'''", "[[{}]]", "== {} ==", "[[page|{}]]"],
    "latex": ["\\emph{{{}}}", "\\section{{{}}}", "${} = x^2$", "``{}''"],
}


def test_planted_markup(posts):
    rng, clean = random.Random(1), [t for t in posts if not kinds(t)]
    found, true = set(), set()
    for i, t in enumerate(clean):
        kind = rng.choice([None, *MARKUP])
        if kind:
            planted = rng.choice(MARKUP[kind]).replace("{}", "the garden gate") if kind != "latex" else rng.choice(MARKUP[kind]).format("gate")
            t = f"{t}\n{planted}\n{t}"
            true.add((i, kind))
        found |= {(i, k) for k in kinds(t)}
    recall, precision = scores(found, true)
    assert len(true) > 100 and recall > 0.95 and precision > 0.95


def test_planted_mentions(posts):
    rng = random.Random(2)
    finder = Finder([("Brenelle", "given"), ("Crowova", "family")])
    mentions = {
        "email": ["joe.{}@mail.example", "joe{} (at) mail (dot) example"], "phone": ["+44 20 7946 0{}", "(202) 555-0{}"], "id_number": ["passport XK{}4567", "SSN 000-12-0{}"],
        "address": ["{} Quarry Road", "Lindenstraße {}"], "name": ["Brenelle Crowova", "Brenelle Q. Crowova"],
    }
    clean = [t for t in posts if not finder.mentions(t)]
    found, true = set(), set()
    for i, t in enumerate(clean):
        kind = rng.choice([None, *mentions])
        if kind:
            text = rng.choice(mentions[kind]).format(rng.randrange(100, 200))
            start = len(t) + 11 + (text.index(" ") + 1 if kind == "id_number" else 0)
            t = f"{t} they gave {text}, I think."
            true.add((i, kind, start))
        found |= {(i, k, a) for k, a, _ in finder.mentions(t)}
    recall, precision = scores(found, true)
    assert len(true) > 100 and recall > 0.97 and precision > 0.97


def test_planted_lists_tables_and_junk(posts):
    rng = random.Random(3)
    words = "anvil brooch cradle dipper easel funnel gasket hammock inkwell jug kettle lantern mallet napkin".split()
    common = frozenset("the and a to of in it is was i my that but for on we they not with so because this".split())
    some = lambda k: rng.sample(words, k)
    make = {
        "list": lambda: rng.choice(["\n".join(f"{m} {w}" for w in some(6)) for m in ("-", "*", "•")] + ["\n".join(f"{i + 1}. {w}" for i, w in enumerate(some(6)))]),
        "table": lambda: "\n".join(rng.choice(["{}\t{}\t{}.50", "{},{},{}.50"][k : k + 1]).format(w, rng.randrange(9), rng.randrange(90)) for k in [rng.randrange(2)] for w in some(6)),
        "junk": lambda: rng.choice(["#$%=~*&^" * 6, "anvil " * 12, "Home Login Search Top FAQ Join Next Contact"]),
    }
    prose = [t for t in posts if t.count(". ") + t.count(".") > 1 and "\n" not in t and not any(c in t for c in "|*#=\t")][:300]
    texts = [(None, t) for t in prose] + [(k, make[k]()) for k in make for _ in range(60)]
    labels = label_texts([t for _, t in texts], common)
    right = [row[0] == (kind or "prose") for (kind, _), row in zip(texts, labels)]
    assert len(prose) > 50 and sum(right) / len(right) > 0.95


def test_labels_agree_with_the_texts():
    table = pq.read_table(f"{SF}/documents.parquet", columns=["text", "lang"]).to_pylist()
    code = {n: c for c, names in L.NAMES.items() for n in names}
    rows = [(r["text"], code.get((r["lang"] or "").strip().lower())) for r in table if r["text"] and len(r["text"]) > 80]
    model = L.fit([r for r in rows if r[1]][::2])
    held = [r for r in rows if r[1]][1::2]
    found = [dict(L.text_languages(runs)) for runs in L.segments(model, [t for t, _ in held])]
    assert len(held) > 20 and sum(c in f for (_, c), f in zip(held, found)) / len(held) > 0.85
