"""Datasets collapsed to one set of values per entity, and joined in pairs.

A collapsed dataset stays long: a row per entity, field and distinct value with the place of the
value's first occurrence. Values of an entity that holds a large part of all rows are then spread
over tasks like any others; nothing gathers an entity in one row. Collapsing comes before joining,
so a join never multiplies rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import WHITE, full, stripped
from lexmill.session import cut
from lexmill.sources.datasets import initials

from .corpora import running_total

#: A text of no more characters is left out.
LEAST_CHARS = 20


def collapse(df: DataFrame, key: str = "entity", order: str = "rid", fields: list[str] | None = None) -> DataFrame:
    """(key, field, value, first): the distinct values of each field of each entity, as text, with the
    order of their first occurrence. Null counts as one value; rows without a key are left out."""
    names = fields or [c for c in df.columns if c not in (key, order)]
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in names))
    long = df.where(F.col(key).isNotNull()).select(key, order, F.explode(cells).alias("cell"))
    return long.groupBy(key, F.col("cell.field").alias("field"), F.col("cell.value").alias("value")).agg(F.min(order).alias("first"))


def value_counts(collapsed: DataFrame, key: str = "entity") -> DataFrame:
    """(key, field, n_values): 1 where the collapsed field is a single value, more where it is a list."""
    return collapsed.groupBy(key, "field").agg(F.count(F.lit(1)).alias("n_values"))


def pairs_of(names: list[str]) -> list[tuple[str, str, str]]:
    """(label, df1, df2) of every unordered pair, by name."""
    return [(f"{initials(a)}+{initials(b)}", a, b) for a, b in combinations(sorted(names), 2)]


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _holders(datasets: dict[str, DataFrame]) -> DataFrame:
    """(entity, held): the names of the datasets each entity is in, so one aggregation serves all pairs."""
    keys = _all([df.where("entity is not null").select("entity", F.lit(n).alias("name")) for n, df in datasets.items()])
    return keys.groupBy("entity").agg(F.collect_set("name").alias("held"))


def entity_pairs(datasets: dict[str, DataFrame]) -> DataFrame:
    """(corpus, df1, df2, entity): the entities each two datasets share."""
    every = F.array(*(F.struct(F.lit(c).alias("corpus"), F.lit(a).alias("df1"), F.lit(b).alias("df2")) for c, a, b in pairs_of(list(datasets))))
    met = F.filter(every, lambda p: F.array_contains("held", p["df1"]) & F.array_contains("held", p["df2"]))
    return _holders(datasets).select("entity", F.explode(met).alias("p")).select("p.corpus", "p.df1", "p.df2", "entity")


def merged_fields(datasets: dict[str, DataFrame]) -> DataFrame:
    """(corpus, entity, field, value, first): both sides' collapsed fields of every shared entity; a field
    both sides have carries _x and _y, posts apart, which `merged_posts` puts together."""
    parts = []
    for label, a, b in pairs_of(list(datasets)):
        common = set(datasets[a].columns) & set(datasets[b].columns) - {"entity", "rid", "post"}
        shared = datasets[a].select("entity").distinct().join(datasets[b].select("entity").distinct(), "entity")
        for name, mark in ((a, "_x"), (b, "_y")):
            fields = [c for c in datasets[name].columns if c not in ("entity", "rid", "post")]
            marked = F.when(F.col("field").isin(*common), F.concat("field", F.lit(mark))).otherwise(F.col("field")) if common else F.col("field")
            long = collapse(datasets[name], fields=fields).join(shared, "entity")
            parts.append(long.select(F.lit(label).alias("corpus"), "entity", marked.alias("field"), "value", "first"))
    return _all(parts)


def merged_posts(datasets: dict[str, DataFrame]) -> DataFrame:
    """(corpus, entity, ord, post): the distinct posts of every shared entity, those of the first dataset
    before those of the second, each side by first occurrence; `ord` gives that order."""
    span = (_all([df.select("rid") for df in datasets.values()]).agg(F.max("rid")).first()[0] or 0) + 1
    pairs = pairs_of(list(datasets))
    parts = []
    for name, df in datasets.items():
        sides = [(c, 0, b) if a == name else (c, 1, a) for c, a, b in pairs if name in (a, b)]
        own = F.array(*(F.struct(F.lit(c).alias("corpus"), F.lit(side * span).alias("base"), F.lit(other).alias("other")) for c, side, other in sides))
        parts.append(df.where("post is not null").select("entity", "rid", "post", own.alias("sides")))
    met = F.filter("sides", lambda p: F.array_contains("held", p["other"]))
    placed = _all(parts).join(_holders(datasets), "entity").select("entity", "rid", "post", F.explode(met).alias("p"))
    ordered = placed.groupBy("p.corpus", "entity", "post").agg(F.min(F.col("p.base") + F.col("rid")).alias("ord"))
    return ordered.select("corpus", "entity", "ord", "post")


def extracted_texts(posts: DataFrame) -> DataFrame:
    """(corpus, entity, n_posts, n_chars): an entity's posts joined by blanks and stripped make a text; of
    texts longer than `LEAST_CHARS`, those that repeat in a corpus count once (smallest entity).

    The texts themselves are never built: where each post would stand follows from the lengths before
    it, a text's ends from its outermost visible characters, and equal texts have equal sets of
    (place, post) digests."""
    # what is needed of a post, before anything is shuffled: its length, its margins and its digests
    t, bare = full(F.col("post")), stripped(full(F.col("post")))
    lead = F.length(t) - F.length(F.ltrim(t, F.lit(WHITE)))
    marks = posts.select(
        "corpus", "entity", "ord", (F.length(t) + 1).cast("bigint").alias("size"), lead.alias("lead"), F.length(bare).alias("bare"),
        F.xxhash64(F.lit(1), bare).alias("d1"), F.xxhash64(F.lit(2), bare).alias("d2"),
    )
    marks = cut(marks)  # narrow, and read several times below
    placed = running_total(marks, ["corpus", "entity"], "ord", F.col("size"), "off")
    placed = placed.withColumn("begin", F.col("off") + F.col("lead")).withColumn("end", F.col("begin") + F.col("bare"))
    seen = F.col("bare") > 0
    spans = placed.groupBy("corpus", "entity").agg(
        F.count(F.lit(1)).alias("n_posts"), F.min(F.when(seen, F.col("begin"))).alias("start"), F.max(F.when(seen, F.col("end"))).alias("stop")
    )
    long = spans.where(F.col("stop") - F.col("start") > LEAST_CHARS)
    visible = placed.where(seen).join(long, ["corpus", "entity"]).withColumn("at", F.col("begin") - F.col("start"))
    digests = visible.groupBy("corpus", "entity", "n_posts", (F.col("stop") - F.col("start")).alias("n_chars")).agg(
        F.bit_xor(F.xxhash64("at", "d1")).alias("h1"), F.bit_xor(F.xxhash64("at", "d2")).alias("h2")
    )
    first = digests.groupBy("corpus", "n_chars", "h1", "h2").agg(F.min_by(F.struct("entity", "n_posts"), "entity").alias("e"))
    return first.select("corpus", "e.entity", "e.n_posts", "n_chars")


def sample(docs: DataFrame, k: int) -> DataFrame:
    """k documents of each corpus without replacement, the same at every run: those whose texts have the
    smallest digests. (corpus, doc_ord, text)"""
    from pyspark.sql import Window as W

    order = W.partitionBy("corpus").orderBy(F.md5("text"), "doc_ord")
    return docs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def head(docs: DataFrame, k: int) -> DataFrame:
    """The first k documents of each corpus."""
    from pyspark.sql import Window as W

    return docs.withColumn("place", F.row_number().over(W.partitionBy("corpus").orderBy("doc_ord"))).where(F.col("place") <= k).drop("place")
