"""Encoding, mixing and languages."""

import random

import numpy as np
import pytest

from lexmill.llm import languages as L
from lexmill.llm.mixing import mix, mix_report, plan_mix, split_tree
from lexmill.llm.tokenize import TOKENIZERS, Encoder, RankQueue, count_tokens, encode_texts, encoder

DOCS = "doc_id bigint, text string, lang string, source string, ids string, n_tokens int"


def test_queue_gives_the_lowest_rank():
    rng = random.Random(1)
    queue, held = RankQueue(50_000), []
    for _ in range(3000):
        if held and rng.random() < 0.4:
            rank, at = queue.pop()
            assert rank == min(r for r, _ in held) and at == sorted(p for r, p in held if r == rank)
            held = [x for x in held if x[0] != rank]
        else:
            x = (rng.randrange(50_000), rng.randrange(1000))
            queue.push(*x)
            held.append(x)


def slow_merge(ranks, piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return tuple(ranks[p] for p in parts)
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_like_the_plain_way():
    rng = random.Random(2)
    e = encoder()
    for _ in range(300):
        piece = "".join(rng.choice("abcdethe ion=-_é日") for _ in range(rng.randrange(1, 60))).encode()
        assert e.merge(piece) == slow_merge(e.ranks, piece)


def test_ids_equal_the_library_and_decode_to_the_text(spark):
    from tokenizers import Tokenizer

    texts = [None, "", " ", "Hello,  world!\r\n\tIt's 12345", "<|endoftext|> is text", "👩‍👩‍👧 İ é", "=-_" * 20_000, "a" * 50_000, "word " * 50_000, "same", "same", "\u0000\u200b"]
    df = spark.createDataFrame([(i, t, "en", "s", "x", 1) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.ids for r in encode_texts(df).collect()}
    library = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    back = {v: k for k, v in encoder().ranks.items()}
    for i, t in enumerate(texts):
        assert got[i] == library.encode(t or "", add_special_tokens=False).ids
        assert b"".join(back[x] for x in got[i]).decode() == (t or "")
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, "doc_id").collect()} == {i: len(v) for i, v in got.items()}
    assert encode_texts(df.where("false")).count() == 0


def test_kept_pieces_are_bounded(monkeypatch):
    from lexmill.llm import tokenize

    monkeypatch.setattr(tokenize, "KEPT", 10)
    e = Encoder(encoder().ranks, tokenize.PATTERN)
    text = " ".join(f"word{i} other{i}" for i in range(200))
    assert e.encode(text) == encoder().encode(text) and len(e.kept) <= 10


def test_tree_splits_exactly():
    counts = np.array([1000, 300, 1])
    sizes = [1301 * (i + 1) // 7 - 1301 * i // 7 for i in range(7)]
    parts = split_tree(counts, sizes, np.random.default_rng(1))
    assert sum(parts).tolist() == counts.tolist() and [int(p.sum()) for p in parts] == sizes
    assert all(abs(p[0] / p.sum() - 1000 / 1301) < 0.15 for p in parts)


def test_plan_meets_shares_within_repeats():
    blocks = {"a": [(i, 100) for i in range(50)], "b": [(i, 100) for i in range(5)]}
    rows = plan_mix(blocks, [("a", 0.5, 1), ("b", 0.4, 3), ("gone", 0.1, 2)], 4, np.random.default_rng(0))
    tokens = {s: sum(100 if take is None else take for x, _, _, take, _ in rows if x == s) for s in "ab"}
    assert tokens["b"] == 1500 and tokens["a"] == pytest.approx(1875, abs=1)
    assert len({(s, b, c) for s, b, c, _, _ in rows}) == len(rows) and max(c for s, _, c, _, _ in rows if s == "b") == 2


def mixing(spark):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randrange(5, 60), "en", "big" if i % 3 else "mid" if i % 2 else "small", "x", 7) for i in range(900)]
    rows += [(1000, None, "en", "big", "x", 7), (1001, "", "en", "big", "x", 7), (1002, "no source", "en", None, "x", 7), (None, "no id", "en", "big", "x", 7), rows[5]]
    targets = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "gone", 0.2, 5), ("even", "mid", 0.5, 4), ("even", "small", 0.5, 4)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")


def test_mixtures(spark):
    docs, targets = mixing(spark)
    mixed = mix(docs, targets)
    rows = mixed.collect()
    assert rows and len({(r.mix_name, r.doc_id, r.copy) for r in rows}) == len(rows)
    assert sorted(rows, key=repr) == sorted(mix(docs, targets).collect(), key=repr)
    places = {}
    for r in rows:
        places.setdefault((r.mix_name, r.shard), []).append(r.pos)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    report = {(r.mix_name, r.source): r for r in mix_report(mixed, targets).collect()}
    assert report["m", "gone"].n_tokens == 0 and report["m", "gone"].actual_share == 0
    assert report["m", "big"].actual_share == pytest.approx(0.625, abs=0.03) and report["even", "mid"].actual_share == pytest.approx(0.5, abs=0.03)
    assert all(r.most_used <= r.max_repeats for r in report.values())


def test_cells_change_nothing(spark, monkeypatch):
    from lexmill.llm import mixing as X

    docs, targets = mixing(spark)
    want = sorted(mix(docs, targets).collect(), key=repr)
    monkeypatch.setattr(X, "CELL_DOCS", 5)
    monkeypatch.setattr(X, "BROADCAST_PLAN", 0)
    assert sorted(mix(docs, targets).collect(), key=repr) == want


def test_shards_grow_with_the_tokens(spark, monkeypatch):
    from lexmill.llm import mixing as X

    monkeypatch.setattr(X, "SHARD_TOKENS", 500)
    docs, targets = mixing(spark)
    assert mix(docs, targets).select("shard").distinct().count() > X.SHARDS


def test_many_repeats_are_planned_or_refused(spark, monkeypatch):
    from lexmill.llm import mixing as X

    docs, _ = mixing(spark)
    targets = spark.createDataFrame([("m", "big", 0.5, 10**9), ("m", "small", 0.5, 40)], "mix_name string, source string, target_share double, max_repeats int")
    rows = mix(docs, targets).where("source = 'small'").groupBy("doc_id").count().collect()
    assert {r["count"] for r in rows} == {40}
    monkeypatch.setattr(X, "MAX_PLAN", 50)
    with pytest.raises(ValueError):
        mix(docs, targets)


def test_no_documents_for_a_mixture(spark):
    docs, targets = mixing(spark)
    assert mix(docs.where("false"), targets).count() == 0
    assert mix(docs, targets.where("source = 'gone'")).count() == 0


SENTENCES = {
    "en": ["The old train was late again this morning.", "My brother found the keys under the table.", "We never thought it would be so cheap.", "Nobody in the street knows what happened to the garden."],
    "de": ["Der alte Zug war heute Morgen wieder zu spät.", "Mein Bruder hat die Schlüssel unter dem Tisch gefunden.", "Wir hätten nie gedacht, dass es so billig ist.", "Niemand in der Straße weiß, was mit dem Garten passiert ist."],
    "es": ["El viejo tren llegó tarde otra vez esta mañana.", "Mi hermano encontró las llaves debajo de la mesa.", "Nunca pensamos que sería tan barato.", "Nadie en la calle sabe qué pasó con el jardín."],
    "ru": ["Старый поезд сегодня утром опять опоздал.", "Мой брат нашёл ключи под столом.", "Мы никогда не думали, что это так дёшево.", "Никто на улице не знает, что случилось с садом."],
}


@pytest.fixture(scope="module")
def model(spark):
    from conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return L.fit(L.labelled_sample(docs, "doc_id", "text", "lang", 300))


def languages(model, text):
    return [c for c, _ in L.text_languages(L.segments(model, [text])[0])]


def test_held_out_sentences(model):
    right = [languages(model, s) == [c] for c, own in SENTENCES.items() for s in own]
    assert sum(right) >= len(right) - 1


def test_spelling_and_script(model):
    assert languages(model, " ".join(SENTENCES["de"]).upper()) == ["de"]
    assert languages(model, "Moy brat nashyol klyuchi pod stolom. My nikogda ne dumali, chto eto tak dyoshevo.") == ["ru"]


def test_mixed_texts_need_two_sentences_in_a_row(model):
    en, de = SENTENCES["en"], SENTENCES["de"]
    assert languages(model, " ".join(en[:3] + de[:2])) == ["de", "en"]
    assert languages(model, " ".join(en[:2] + de[:1] + en[2:])) == ["en"]
    runs = L.segments(model, [" ".join(en[:3] + de[:2])])[0]
    assert [r[2] for r in runs] == ["en", "de"] and all(0 < r[3] <= 1 for r in runs)


def test_short_sentences_make_a_stretch(model):
    english = "The old train was late again this morning. My brother found the keys under the table. We never thought it would be so cheap. "
    assert languages(model, english + "Он дома. Мы тоже.") == ["en", "ru"]
    assert languages(model, english + "Wir hatten Pech. Es hat geregnet.") == ["de", "en"]
    assert languages(model, english + "desk .... 70\nlamp ....") == ["en"]


def test_the_fit_is_bounded_by_its_parameters(spark):
    docs = spark.createDataFrame([(i, " ".join(SENTENCES[c]) + f" {c} {i}.", c, "s", "x", 1) for i in range(40) for c in SENTENCES], DOCS)
    rows = L.labelled_sample(docs, "doc_id", "text", "lang", 5)
    assert 0 < len(rows) <= 2 * 5 * len(L.LANGUAGES)
    few = L.fit([(" ".join(SENTENCES[c]), c) for c in SENTENCES], per_fit=2)
    assert [c for c, _ in L.text_languages(L.segments(few, [SENTENCES["ru"][0]])[0])] == ["ru"]


def test_recurring_sentences_have_the_label_most_texts_give():
    rows = [(" ".join(SENTENCES[c]), c) for c in SENTENCES for _ in range(3)] + [(" ".join(SENTENCES["de"]), "en")]
    assert languages(L.fit(rows[::-1]), " ".join(SENTENCES["de"])) == ["de"]


@pytest.mark.parametrize("text", ["word " * 100_000, "a. " * 100_000, "." * 300_000, "1 " * 300_000, "x" * 500_000])
def test_long_texts_take_linear_time(model, text):
    L.segments(model, [text])


def test_pieces_are_bounded_by_bytes_and_rows():
    import pyarrow as pa

    from lexmill.llm.arrow import PIECE_BYTES, PIECE_ROWS, pieces

    texts = ["x" * (PIECE_BYTES + 5), None, "a", "y" * (PIECE_BYTES - 10), "z" * 20, *["b"] * (2 * PIECE_ROWS)]
    parts = list(pieces(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "t"])))
    assert [a for a, _ in parts[1:]] == [b for _, b in parts[:-1]] and parts[0] == (0, 1) and parts[-1][1] == len(texts)
    assert all(b - a <= PIECE_ROWS and (b - a == 1 or sum(len(t or "") for t in texts[a:b]) <= PIECE_BYTES) for a, b in parts)
    assert list(pieces(pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["t"]))) == []


def test_language_edges(spark, model):
    assert L.segments(model, [None, "", "12345 !!!", "abc"]) == [[], [], [], []]
    assert languages(model, SENTENCES["en"][0] * 5000) == ["en"]
    names = ["en", "EN-us", "English", "deu", "Español ", "fr_CA", "xx", "", None, "??", "русский"]
    df = spark.createDataFrame([(n,) for n in names], "lang string")
    assert [r[0] for r in df.select(L.label_language(df.lang)).collect()] == ["en", "en", "en", "de", "es", "fr", None, None, None, None, "ru"]
    with pytest.raises(ValueError):
        L.fit([])
