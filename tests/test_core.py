"""Golden values, edge inputs and properties of the core operators, against brute force."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import collapse as J
from lexmill.operators import corpora as B
from lexmill.operators import docstats as D
from lexmill.operators import lexical as C
from lexmill.operators import rollup as R
from lexmill.operators import sequence as M
from lexmill.operators import similarity as X

GOLDEN = "the cat sat on the mat the cat ran and the dog sat"


def docs(spark, *rows):
    return B.documents(spark.createDataFrame(list(rows), "corpus string, id bigint, text string"), "corpus", "id", "text")


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def golden(spark):
    d = docs(spark, ("a", 2, "ran and the dog sat"), ("a", 1, "the cat sat on the mat the cat"))
    return d, B.frequencies(B.token_table(d)), B.positions(d)


def test_golden_corpus(golden):
    got = one(C.corpus_stats(golden[1]))
    want = {
        "n_tokens": 13, "vocab_size": 8, "ttr": 0.6153846153846154, "root_ttr": 2.2188007849009166, "log_ttr": 0.8107144632819592, "hapax_ratio": 0.38461538461538464,
        "yules_k": 946.7455621301775, "simpsons_d": 0.8974358974358975, "entropy": 2.7773627950641693, "norm_entropy": 0.9257875983547231,
        "perplexity": 6.855979497130704, "avg_word_len": 2.923076923076923,
    }
    assert got == pytest.approx({"corpus": "a"} | want)
    assert one(C.word_lengths(golden[1]))["word_len_var"] == pytest.approx(0.07100591715976332)


def test_golden_sequences(spark, golden):
    docs, freq, pos = golden
    assert one(M.conditional_entropy(docs))["conditional_entropy"] == pytest.approx(2 / 3)
    two = one(M.ngram_stats(docs, (2,)))
    assert (two["ngram_count"], two["unique_ngrams"]) == (12, 11)
    assert two["ngram_entropy"] == pytest.approx(3.4182958340544896)
    assert two["most_common_ngram_freq"] == pytest.approx(1 / 6)
    assert one(M.moving_ttr(docs, 5))["mattr"] == pytest.approx(0.8888888888888888)
    assert one(M.burstiness(pos).where("tok = 'the'"))["burstiness"] == pytest.approx(-0.5590375815769153)
    pairs = spark.createDataFrame([("the", "cat"), ("the", "nowhere")], "w1 string, w2 string")
    got = {r.w2: r.pmi for r in M.pmi(docs, pairs, 2).collect()}
    assert got["cat"] == pytest.approx(1.59352451422458) and got["nowhere"] == 0
    assert one(M.zipf_exponents(freq))["zipf_exponent"] == pytest.approx(0.7025921779389528)
    curve = M.heaps_curve(pos, 4)
    assert sorted((r.corpus_size, r.vocab_size) for r in curve.collect()) == [(4, 4), (8, 5), (12, 8), (13, 8)]
    fitted = one(M.heaps_fit(curve))
    assert (fitted["heaps_k"], fitted["heaps_beta"]) == pytest.approx((1.6054576501034592, 0.6178055486607773))


def test_golden_document(spark):
    got = one(D.full_stats(spark.createDataFrame([(1, GOLDEN + ".")], "id int, text string"), "id", "text"))
    assert got["token_count"] == 13 and got["sentence_count"] == 1 and got["mattr_100"] == pytest.approx(8 / 13)
    assert got["yules_k"] == pytest.approx(946.7455621301775) and got["word_length_var"] == pytest.approx(0.07100591715976332)


def test_distribution_moments(spark):
    counts = [1, 1, 1, 2, 2, 5, 9, 14, 3]
    freq = spark.createDataFrame([("a", f"t{i}", c) for i, c in enumerate(counts)] + [("b", "x", 3), ("b", "y", 3)], "corpus string, tok string, c bigint")
    got = {r.corpus: r for r in C.distribution(freq).collect()}
    assert (got["a"].skewness, got["a"].kurtosis) == pytest.approx((1.9445381345734012, 3.771372272990563))
    assert (got["b"].skewness, got["b"].kurtosis, got["b"].std) == (0, 0, 0)


def test_edges(spark):
    d = docs(spark, ("none", 1, None), ("none", 2, "  "), ("one", 1, "word"), ("same", 1, "aa aa aa aa"), (None, 1, "left out"), ("one", None, "left out"))
    freq, pos = B.frequencies(B.token_table(d)), B.positions(d)
    got = {r.corpus: r for r in C.with_empty(C.corpus_stats(freq), d).collect()}
    assert set(got) == {"none", "one", "same"}
    assert got["none"].perplexity == 0 and got["none"].n_tokens == 0
    assert got["one"].perplexity == 1 and got["one"].log_ttr == 0 and got["same"].norm_entropy == 0
    assert {r.corpus: r.zipf_exponent for r in M.zipf_exponents(freq).collect()} == {"one": 0, "same": 0}
    grams = {(r.corpus, r.n): r for r in M.ngram_stats(d).collect()}
    assert grams["one", 2].ngram_count == 0 and grams["one", 2].ngram_entropy is None and grams["same", 2].unique_ngrams == 1
    assert {r.corpus: r.mattr for r in M.moving_ttr(d).collect()} == {"one": 1.0, "same": 0.25}
    assert {r.corpus: (r.heaps_k, r.heaps_beta) for r in M.heaps_fit(M.heaps_curve(pos, 4)).collect()} == {"one": (0, 0), "same": (0, 0)}
    assert {r.corpus: r.avg_burstiness for r in M.average_burstiness(pos).collect()} == {"one": 0, "same": 0}
    assert {(r.c1, r.c2, r.similarity) for r in X.jaccard_pairs(freq).collect()} == {("one", "same", 0.0)}


def test_empty_tables(spark):
    d = docs(spark, ("a", 1, "x")).where("false")
    freq, pos = B.frequencies(B.token_table(d)), B.positions(d)
    for df in (C.corpus_stats(freq), M.ngram_stats(d), M.moving_ttr(d), M.heaps_curve(pos), M.average_burstiness(pos), X.jaccard_matrix(freq), X.tfidf_similarity(freq), M.ranked(freq)):
        assert df.count() == 0


def brute_pmi(toks, w1, w2, window):
    at = [i for i, t in enumerate(toks) if t == w1]
    around = [[t for k, t in enumerate(toks) if k != i and abs(k - i) <= window] for i in at]
    co, den = sum(a.count(w2) for a in around), sum(map(len, around))
    return math.log2((co / den) / (len(at) / len(toks) * (toks.count(w2) / len(toks)))) if co else 0.0


@pytest.mark.parametrize("ranges, stretch", [(1, 7), (40, 1 << 20)])
def test_stretches_and_ranges_change_nothing(spark, monkeypatch, ranges, stretch):
    rng = random.Random(3)
    rows = [(c, i * 7 if i < 30 else 10**15, " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rng.choice([0, 1, 1, 2, 3, 40])))) for c in "xy" for i in range(31)]
    from lexmill.operators import corpora, sequence

    monkeypatch.setattr(corpora, "LEAST_RANGES", ranges)
    monkeypatch.setattr(corpora, "MOST_RANGES", ranges)
    monkeypatch.setattr(corpora, "STRETCH", stretch)
    monkeypatch.setattr(sequence, "STRETCH", stretch)
    d = docs(spark, *rows)
    pos = B.positions(d).collect()
    mattr = {w: {r.corpus: r.mattr for r in M.moving_ttr(d, w).collect()} for w in (5, 2000)}
    grams = B.ngram_counts(d, (1, 3, 4)).collect()
    burst = M.burstiness(B.positions(d)).collect()
    pairs = spark.createDataFrame([("aa", "bb"), ("cc", "cc"), ("bb", "aa"), ("dd", "none")], "w1 string, w2 string")
    pmi = M.pmi(d, pairs, 3).collect()
    entropy = {r.corpus: r.conditional_entropy for r in M.conditional_entropy(d).collect()}
    for c in "xy":
        toks = [w for _, _, t in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]) for w in t.split()]
        assert [r.tok for r in sorted((r for r in pos if r.corpus == c), key=lambda r: r.gpos)] == toks
        windows = [len(set(toks[i : i + 5])) / 5 for i in range(len(toks) - 4)]
        assert mattr[5][c] == pytest.approx(sum(windows) / len(windows)) and mattr[2000][c] == pytest.approx(len(set(toks)) / len(toks))
        for n in (1, 3, 4):
            assert {r.gram: r.c for r in grams if r.corpus == c and r.n == n} == Counter(" ".join(toks[i : i + n]) for i in range(len(toks) - n + 1))
        two = Counter(zip(toks, toks[1:]))
        assert entropy[c] == pytest.approx(-sum(k / (len(toks) - 1) * math.log2(k / sum(v for p, v in two.items() if p[0] == a)) for (a, _), k in two.items()))
        assert {(r.w1, r.w2): r.pmi for r in pmi if r.corpus == c} == pytest.approx({p: brute_pmi(toks, *p, 3) for p in [("aa", "bb"), ("cc", "cc"), ("bb", "aa"), ("dd", "none")]})
        for r in burst:
            if r.corpus != c:
                continue
            at = [i for i, t in enumerate(toks) if t == r.tok]
            gaps = [b - a for a, b in zip(at, at[1:])]
            mu = sum(gaps) / len(gaps) if gaps else 0
            sd = math.sqrt(sum((g - mu) ** 2 for g in gaps) / len(gaps)) if gaps else 0
            assert r.burstiness == pytest.approx((sd - mu) / (sd + mu) if sd + mu else 0)


def test_shared_orders_and_an_outlying_one(spark):
    d = docs(spark, ("a", 1, "one two"), ("a", 1, "three four"), ("a", 1, "one two"), ("b", 2, "x y z"))
    got = B.positions(d).collect()
    assert sorted(r.gpos for r in got if r.corpus == "a") == list(range(6)) and {r.n for r in got if r.corpus == "a"} == {6}
    wide = spark.range(2000).union(spark.createDataFrame([(10**15,)], "id bigint"))
    sizes = [r["count"] for r in B.ranged(wide, "id").groupBy("_range").count().collect()]
    assert len(sizes) == B.LEAST_RANGES and max(sizes) < 2 * 2001 / B.LEAST_RANGES


def test_tokens_follow_unicode_word_borders(spark):
    cases = {"café noir": ["cafe", "noir"], "café noir": ["noir"], "İstanbul ab": ["stanbul", "ab"], "x1y foo_bar ab": ["ab"], "": [], None: [], "A-b Cd": ["cd"]}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r.k for r in df.select(T.tokens(F.col("t")).alias("k")).collect()] == list(cases.values())


def reference_clean(text):
    """The default cleaner in plain Python."""
    if text is None or not text.strip():
        return ""
    t = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    for p in (r"<[^>]+>", r"(?:https?://|www\.)[$-_a-z!]+", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"@\w+"):
        t = re.sub(p, " ", t)
    t = re.sub(r"([^\n])\1{2,}", r"\1\1", re.sub(r"#(\w+)", r"\1", t)).lower()
    return re.sub(r"\s+", " ", t).strip()


def test_cleaner(spark):
    texts = [None, "", "  \t", "soooo AAAaaa !!!!", "#tag and @you", "see http://x.example/" + "a" * 50_000 + " end", "<b>Été</b> a@b.example — ok", "x" * 200_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.k for r in df.select(T.Cleaner()(F.col("t")).alias("k")).collect()] == [reference_clean(t) for t in texts]
    kept = T.Cleaner(ascii=False, lowercase=False, repeats=False, html=False, urls=False, emails=False, mentions=False)
    assert [r.k for r in df.select(kept(F.col("t")).alias("k")).collect()][4] == "tag and @you"


def test_language_guess_and_joined(spark):
    df = spark.createDataFrame([("short",), ("plain english text",), ("наш сосед чинит велосипед",), (None,)], "t string")
    assert [r.g for r in df.select(T.language_guess(F.col("t")).alias("g")).collect()] == ["unknown", "en", "other", "unknown"]
    assert spark.range(1).select(T.joined(F.array(F.lit("a"), F.lit(None), F.lit("b"))).alias("j")).first().j == "a b"


def test_pairs_of_many_corpora(spark):
    n = 5001
    freq = spark.range(n).select(F.concat(F.lit("c"), "id").alias("corpus"), F.concat(F.lit("w"), "id").alias("tok"), F.lit(1).cast("bigint").alias("c"))
    for same, want in ((False, n * (n - 1) // 2), (True, n * (n + 1) // 2)):
        found = X._pairs(freq, same).agg(F.count(F.lit(1)), F.min(F.when(F.col("c1") <= F.col("c2"), 1).otherwise(0)), F.count_distinct("c1")).first()
        assert tuple(found) == (want, 1, n if same else n - 1)
    few = freq.where("tok in ('w1', 'w2', 'w3')").union(freq.where("tok = 'w1'").withColumn("corpus", F.lit(None).cast("string")))
    assert {(r.c1, r.c2) for r in X.jaccard_pairs(few).collect()} == {("c1", "c2"), ("c1", "c3"), ("c2", "c3")}


def test_registered_collapse_has_every_column(spark):
    from conftest import SF

    from lexmill.plans.queries import QUERIES

    fields = {"political_leaning": {"political_leaning", "attrs"}, "birth_year": {"birth_year"}, "nationality": {"nationality", "gender"}}
    for name in ("collapse_entities_all", "collapse_value_counts_all"):
        got = {(r.dataset, r.field) for r in QUERIES[name](spark, SF).select("dataset", "field").distinct().collect()}
        assert got == {(n, f) for n, own in fields.items() for f in own | {"post", "posted_at"}}
    merged = {r.field for r in QUERIES["merged_fields_all"](spark, SF).select("field").distinct().collect()}
    assert merged == set().union(*fields.values()) | {"posted_at_x", "posted_at_y"}


def test_collapse_commutes_with_join(spark):
    rng = random.Random(5)
    sets = {}
    for n, base in (("left_set", 0), ("right_set", 1000)):
        rows = [(rng.choice([1, 2, 3, None]), base + i, rng.choice(["p", "q q", "r", None, " "]), rng.choice(["x", "y", None])) for i in range(30)]
        sets[n] = spark.createDataFrame(rows, "entity bigint, rid bigint, post string, label string")
    got = {(r.entity, r.field, r.value) for r in J.merged_fields(sets).collect()}
    plain = {n: df.collect() for n, df in sets.items()}
    shared = {r.entity for r in plain["left_set"]} & {r.entity for r in plain["right_set"]} - {None}
    assert got == {(r.entity, f"label{m}", r.label) for n, m in (("left_set", "_x"), ("right_set", "_y")) for r in plain[n] if r.entity in shared}
    texts = {}
    for r in J.merged_posts(sets).orderBy("ord").collect():
        texts.setdefault(r.entity, []).append(r.post)
    for e in shared:
        want = list(dict.fromkeys(r.post for n in ("left_set", "right_set") for r in sorted(plain[n], key=lambda r: r.rid) if r.entity == e and r.post is not None))
        assert texts[e] == want


def test_extracted_texts_match_built_ones(spark):
    rng = random.Random(9)
    rows = [("c", e, o, rng.choice(["hello there you", " ", "\t", "x", "a longer post with words  ", "  lead"])) for e in range(12) for o in range(rng.randrange(1, 5))]
    rows += [("c", 100, 1, "hello there you"), ("c", 100, 2, "a longer post with words"), ("c", 101, 5, "hello there you"), ("c", 101, 9, "a longer post with words")]
    got = {(r.entity, r.n_chars) for r in J.extracted_texts(spark.createDataFrame(rows, "corpus string, entity int, ord bigint, post string")).collect()}
    built = {}
    for _, e, o, p in sorted(rows, key=lambda r: r[2]):
        built.setdefault(e, []).append(p)
    first = {}
    for e in sorted(built):
        t = " ".join(built[e]).strip()
        if len(t) > 20:
            first.setdefault(t, (e, len(t)))
    assert got == set(first.values())


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5), (2.0, 4.0, 5), (4.0, 8.5, 5)], "a double, b double, k int")
    got = {(r.a, r.b): r.r for r in R.correlations(df, ("a", "b", "k")).collect()}
    assert got["a", "k"] is None and got["k", "k"] is None and got["a", "a"] == pytest.approx(1) and got["a", "b"] == got["b", "a"]


def test_dense_dots(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, -2.0]) for i in range(7)] + [(9, None), (None, [1.0, 1.0, 1.0]), (11, [1.0])], "id int, v array<float>")
    got = [tuple(r) for r in X.dense_dots(df, "id", "v", df.where("id % 2 = 0"), block=2).collect()]
    assert sorted(got) == sorted((a, b, a * b + 5.0) for a in (0, 2, 4, 6) for b in range(7))
    assert X.dense_dots(df.where("false"), "id", "v", df).count() == X.dense_dots(df, "id", "v", df.where("false")).count() == 0


def test_sample_is_stable_and_whole(spark):
    d = docs(spark, *[("c", i, f"text {i}") for i in range(20)])
    a, b = ({r.doc_ord for r in J.sample(d, 5).collect()} for _ in range(2))
    assert a == b and len(a) == 5 and J.sample(d, 50).count() == 20
