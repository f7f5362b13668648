"""Term scores and hidden copies against brute force."""

import json
import math
import random
import re
from collections import Counter

import pytest

from lexmill.llm.collapse_copies import collapse_copies, copy_members
from lexmill.llm.distinctive_terms import distinctive_terms

TERMS = "rid bigint, post string, term string, tf int, loaded_at int"


def brute_scores(rows):
    texts = {}
    for rid, post, *_ in rows:
        if rid is not None:
            texts[rid] = max(texts.get(rid) or "", post or "")
    counts = {r: Counter(w for w in re.split(r"[^\w]+", t.lower()) if re.fullmatch("[a-z]{2,}", w)) for r, t in texts.items()}
    out = {}
    for term in set().union(*counts.values()):
        tf = {r: c[term] for r, c in counts.items() if c[term]}
        gf = sum(tf.values())
        spread = -sum(x / gf * math.log(x / gf) for x in tf.values())
        for r, x in tf.items():
            out[r, term] = math.log(1 + x) * (1 - spread / math.log(len(texts)))
    return out


def test_scores(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "the", "Café", "x9"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30))), "x", 1, 0) for i in range(15)]
    rows += [rows[3][:4] + (7,), (None, "alpha alpha", "x", 1, 0), (99, None, "x", 1, 0), (98, "", "x", 1, 0), (97, "   \t", "x", 1, 0)]
    got = {(r.rid, r.term): r.score for r in distinctive_terms(spark.createDataFrame(rows, TERMS)).collect()}
    assert got == pytest.approx(brute_scores(rows))


def test_limits_restrict_what_is_returned_only(spark):
    rows = [(i, "common " * 3 + ("special " * 4 if i < 3 else ""), "x", 1, 0) for i in range(8)]
    df = spark.createDataFrame(rows, TERMS)
    whole = {(r.rid, r.term): r.score for r in distinctive_terms(df).collect()}
    some = {(r.rid, r.term): r.score for r in distinctive_terms(df, min_len=7, min_tf=3, df_range=(3, 5)).collect()}
    assert some == {k: v for k, v in whole.items() if k[1] == "special"} and len(some) == 3


def test_single_record_long_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "word other " * 100_000, "x", 1, 0)], TERMS)
    assert {(r.term, r.tf) for r in distinctive_terms(df).collect()} == {("word", 100_000), ("other", 100_000)}
    assert distinctive_terms(df.where("false")).count() == 0


COPIES = "rid bigint, author_ID string, post string, attrs string, first int, n int"


def brute_groups(rows):
    groups = {}
    for rid, author, post, attrs, *_ in rows:
        if rid is None or author is None or post is None:
            continue
        a, t = ("".join(c for c in x.lower() if c.isalpha() or c.isdigit()) for x in (author, post))
        if a and t:
            groups.setdefault((a, t, None if attrs is None else json.dumps(json.loads(attrs), sort_keys=True)), set()).add(rid)
    return groups


def copies(seed=2, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        author = rng.choice(["u1", "U-1", " u1", "u2", "@u2", None, "--"])
        post = rng.choice(["Hello, world", "hello world!", "HELLO  WORLD", "Other", "été", "ÉTÉ", None, "", "?!"])
        a, b = rng.choice([1, 2]), rng.choice([True, False])
        attrs = rng.choice([f'{{"a":{a},"b":{str(b).lower()}}}', f'{{"b": {str(b).lower()}, "a": {a}}}', None])
        rows.append((rng.randrange(n), author, post, attrs, 0, 0))
    return [r for r in {r[0]: r for r in rows}.values()]


def test_groups_and_members(spark):
    rows = copies()
    want = brute_groups(rows)
    df = spark.createDataFrame(rows + rows[:20] + [(None, "u1", "x", None, 0, 0)], COPIES)
    assert {(r["first"], r.copies) for r in collapse_copies(df).collect()} == {(min(g), len(g)) for g in want.values()}
    assert {(r["first"], r["copy"]) for r in copy_members(df).collect()} == {(min(g), r) for g in want.values() for r in g if r != min(g)}


def test_one_group_holds_most_rows(spark):
    df = spark.range(3000).selectExpr("id AS rid", "if(id % 3 = 0, concat('u', id), 'U-7') AS author_ID", "concat('Same ', repeat('!', id % 5)) AS post", "cast(null as string) AS attrs")
    assert copy_members(df).count() == 1999
    assert collapse_copies(df).count() == 1001


def test_empty_and_bad_json(spark):
    df = spark.createDataFrame([(1, "a", "b", "{bad", 0, 0), (2, "A", "B!", "{bad ", 0, 0), (3, "a", "b", "{worse", 0, 0)], COPIES)
    assert [tuple(r) for r in copy_members(df).collect()] == [(1, 2)]
    assert copy_members(df.where("false")).count() == collapse_copies(df.where("false")).count() == 0


@pytest.mark.parametrize("words", [1, 1 << 10])
def test_deliveries_once(spark, monkeypatch, words):
    from lexmill.llm import tables

    monkeypatch.setattr(tables, "FILTER_WORDS", words)
    rng = random.Random(3)
    rows = [(i if i % 9 else None, f"text {i}", f"{k}") for i in range(300) for k in range(rng.choice([1, 1, 1, 2, 5]))]
    df = spark.createDataFrame(rows, "rid bigint, post string, loaded_at string")
    want = sorted({(r, p) for r, p, _ in rows if r is not None})
    assert sorted(map(tuple, tables.one_delivery(df, "rid", "post").collect())) == want
    assert sorted(map(tuple, tables.distinct_deliveries(df.select("rid", "post"), "rid").collect())) == want
    assert tables.one_delivery(df.where("false"), "rid", "post").count() == 0
    assert sorted(map(tuple, tables.one_per_key(df.select("rid", "post"), "rid", "post").collect())) == want
