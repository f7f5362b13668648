"""Files of a feed whose fields are added, removed, renamed or change type, read into one table.

Rows are parsed once; one aggregation per (file, position), with map-side combination, leaves a small
profile of each field: which types all its values fit, quantiles of its numbers and a sketch of its
set of values. From there on only metadata moves: one row per file and field. Windows over a feed's
files find fields that come, go or change type; of those that come and go in the same file, pairs
with like content are renames. Types are folded through the lattice integer < decimal < text,
boolean < text, date < text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.session import cut

# Fixed values.
MISSING = ("", "NA", "NaN", "null")
INTEGER, DECIMAL, DATE = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)$", r"^\d{4}-\d{2}-\d{2}$"
ANY_DATE = r"^(\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4}|[A-Z][a-z]{2,8} \d{1,2}, \d{4}|\d{10}|\d{13})$"
WRAPPED = r"^[^\d]{0,8}?(\d+(?:\.\d+)?)[^\d]{0,8}$"
BOOLEAN_WORDS = ("true", "false", "y", "n", "yes", "no", "0", "1")
TYPES = {"integer": "bigint", "decimal": "double", "boolean": "boolean", "date": "date", "text": "string"}
#: Content is the same from this likeness on. MAX_FIELDS bounds the columns of a file and of the table.
SAME, MAX_FIELDS = 0.3, 1000
_CSV = {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\u0001", "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"}


def _cells(line: Column, n: int) -> Column:
    """The cells of one CSV record, line breaks inside quotes included, as an array of `n`."""
    v = F.from_csv(line, ", ".join(f"c{i} string" for i in range(n)), _CSV)
    return F.array(*(v[f"c{i}"] for i in range(n)))


def _width(files: DataFrame) -> int:
    n = files.agg(F.max(F.size(F.split("header", ",")))).first()[0] or 0
    if n > MAX_FIELDS:
        raise ValueError(f"a header has more than {MAX_FIELDS} fields")
    return n


def _fields(files: DataFrame, n: int) -> DataFrame:
    """(feed_id, file_id, file_no, at, next_no, pos, name): every field of every file; `at` counts a
    feed's files from 1 on, `next_no` is the number of the file after it. Of fields that share a name
    the first counts; unnamed ones don't."""
    w = W.partitionBy("feed_id").orderBy("file_no", "file_id")
    placed = files.where(F.col("feed_id").isNotNull() & F.col("header").isNotNull()).select(
        "feed_id", "file_id", "file_no", F.row_number().over(w).alias("at"), F.lead("file_no").over(w).alias("next_no"), "header"
    )
    named = placed.select("feed_id", "file_id", "file_no", "at", "next_no", F.posexplode(_cells(F.col("header"), n)).alias("pos", "raw"))
    return named.withColumn("name", F.trim("raw")).where("name <> ''").withColumn("k", F.row_number().over(W.partitionBy("file_id", "name").orderBy("pos"))).where("k = 1").drop("k", "raw")


def _values(rows: DataFrame, n: int) -> DataFrame:
    """(file_id, pos, v) of every cell that isn't missing, trimmed."""
    cells = rows.select("file_id", F.posexplode(_cells(F.col("record"), n)).alias("pos", "v"))
    return cells.withColumn("v", F.trim("v")).where(F.col("v").isNotNull() & ~F.col("v").isin(*MISSING))


def _profiles(values: DataFrame) -> DataFrame:
    """One row per (file_id, pos) that has values."""
    v, low = F.col("v"), F.lower("v")
    number = F.regexp_extract(v, WRAPPED, 1)
    year = F.when(v.rlike(r"^'\d\d$"), F.concat(F.lit("19"), number)).otherwise(number)
    one = values.select(
        "file_id", "pos", v, low.alias("low"), v.rlike(ANY_DATE).alias("dated"), F.expr("try_cast(null as double)").alias("none"),
        F.when(year != "", year.cast("double")).alias("x"), F.length(F.ltrim(F.translate(number, ".", ""), F.lit("0"))).alias("long"),
    )
    all_of = lambda c: F.every(c)
    return one.groupBy("file_id", "pos").agg(
        F.count(F.lit(1)).alias("n"),
        F.when(all_of(v.rlike(INTEGER)), "integer")
        .when(all_of(v.rlike(DECIMAL)), "decimal")
        .when(all_of(F.col("low").isin("true", "false")), "boolean")
        .when(all_of(v.rlike(DATE)), "date")
        .otherwise("text")
        .alias("type"),
        all_of(F.col("low").isin(*BOOLEAN_WORDS)).alias("yes_no"),
        F.avg(F.col("dated").cast("int")).alias("dates"),
        F.avg(F.col("x").isNotNull().cast("int")).alias("numbers"),
        F.avg(F.length("v")).alias("width"),
        F.min("x").alias("bottom"),
        F.max("x").alias("top"),
        F.max("long").alias("digits"),
        all_of(F.when(v.rlike(DATE), v.try_cast("date").isNotNull())).alias("real_dates"),
        F.percentile_approx("x", F.array(F.lit(0.5), F.lit(0.9)), 200).alias("q"),
        F.expr("theta_sketch_agg(coalesce(cast(try_cast(x as bigint) as string), low), 9)").alias("sketch"),
    )


def _kind(p: Column) -> Column:
    """What sort of content a profile shows."""
    return (
        F.when(p["yes_no"], "flag")
        .when((p["dates"] >= 0.9) & (p["type"] != "decimal"), "date")
        .when((p["numbers"] >= 0.9) & (p["bottom"] >= 1900) & (p["top"] <= 2030), "year")
        .when((p["numbers"] >= 0.9) & (p["width"] <= 20) & (p["top"] <= 1), "share")
        .when((p["numbers"] >= 0.9) & (p["width"] <= 20), "number")
        .when(p["width"] > 20, "prose")
        .otherwise("word")
    )


def _alike(a: Column, b: Column, old: Column, new: Column) -> Column:
    """Likeness of two profiles' contents, 0 to 1, and a little more for like names."""
    ka, kb = _kind(a), _kind(b)
    gap = lambda i: F.abs(F.log1p(F.abs(a["q"][i])) - F.log1p(F.abs(b["q"][i])))
    both = F.expr("theta_sketch_estimate(theta_intersection(removed.sketch, added.sketch))").cast("double")
    na, nb = (F.expr(f"theta_sketch_estimate({x}.sketch)").cast("double") for x in ("removed", "added"))
    held = F.coalesce(F.try_divide(both, F.least(na, nb)), F.lit(0.0))
    percent = F.exp(-(F.abs(F.log1p(a["q"][0] * F.when(ka == "share", 100).otherwise(1)) - F.log1p(b["q"][0] * F.when(kb == "share", 100).otherwise(1)))))
    few = lambda p, n: (n <= 6) & (p["top"].isNull() | (p["top"] <= 6))
    content = (
        F.when((ka == kb) & ka.isin("flag", "date", "year"), 0.9)
        .when((ka == kb) & (ka == "number"), F.greatest(F.exp(-(gap(0) + gap(1)) / 2), 0.8 * held))
        .when((ka == kb) & (ka == "share"), 0.9)
        .when(ka.isin("share", "number") & kb.isin("share", "number") & (F.greatest(a["top"], b["top"]) <= 100), 0.7 * percent)
        .when((ka == kb) & (ka == "prose"), 0.9)
        .when((ka == kb) & (ka == "word"), held)
        .when(few(a, na) & few(b, nb) & (F.abs(na - nb) <= 1) & ka.isin("word", "number") & kb.isin("word", "number"), 0.4)
        .otherwise(0.0)
    )
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    known = a["n"].isNotNull() & b["n"].isNotNull()
    close = F.contains(plain(old), plain(new)) | F.contains(plain(new), plain(old))
    name = F.when(plain(old) == plain(new), 0.35).when(close & (F.least(F.length(plain(old)), F.length(plain(new))) >= 3), 0.2).otherwise(0.0)
    return F.when(known, content).otherwise(0.0) + name


def _segments(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Every field of every file with the profile and type it has or, without values, keeps. A segment
    is a run of files in a row that have the field."""
    n = _width(files)
    profile = F.struct("n", "type", "yes_no", "dates", "numbers", "width", "bottom", "top", "digits", "real_dates", "q", "sketch")
    found = _profiles(_values(rows.select("file_id", "record"), n)).select("file_id", "pos", profile.alias("p"))
    here = _fields(files, n).join(found, ["file_id", "pos"], "left")
    w = W.partitionBy("feed_id", "name").orderBy("at")
    fresh = F.coalesce((F.col("at") - F.lag("at").over(w) != 1).cast("int"), F.lit(1))
    run = W.partitionBy("feed_id", "name", "segment").orderBy("at")
    # metadata, used several times below: written once to the shared folder
    return cut(
        here.withColumn("fresh", fresh)
        .withColumn("segment", F.sum("fresh").over(w))
        .withColumn("kept", F.last("p", ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("was", F.lag("kept.type").over(run))
        .withColumn("next_at", F.lead("at").over(w))
    )


def _renames(segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(came, went, pairs): fields that come and go by (feed_id, file_no), and which pairs are renames."""
    came = segments.where("fresh = 1 and at > 1").select("feed_id", "file_no", F.col("name").alias("new"), "segment", F.col("p").alias("added"))
    went = segments.where("next_no is not null and (next_at is null or next_at <> at + 1)").select(
        "feed_id", F.col("next_no").alias("file_no"), F.col("name").alias("old"), F.col("kept").alias("removed")
    )
    scored = went.join(came, ["feed_id", "file_no"]).withColumn("alike", _alike(F.col("removed"), F.col("added"), F.col("old"), F.col("new")))
    # per file the likeliest pair first, each field once; bounded by the fields of one file
    listed = scored.where(F.col("alike") >= SAME).groupBy("feed_id", "file_no").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("alike")).alias("away"), "old", "new", "segment", F.col("removed.type").alias("was"), F.col("added.type").alias("now")))).alias("pairs")
    )
    empty = F.expr("cast(array() as array<struct<away:double,old:string,new:string,segment:bigint,was:string,now:string>>)")
    chosen = F.aggregate(
        "pairs", empty, lambda acc, p: F.when(F.exists(acc, lambda q: (q["old"] == p["old"]) | (q["new"] == p["new"])), acc).otherwise(F.array_append(acc, p))
    )
    pairs = cut(listed.select("feed_id", "file_no", F.explode(chosen).alias("c")).select("feed_id", "file_no", "c.old", "c.new", "c.segment", "c.was", "c.now"))
    return came.select("feed_id", "file_no", "new"), went.select("feed_id", "file_no", "old"), pairs


def schema_changes(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(feed_id, file_no, change, old_field, new_field): every difference between a file and the one
    before it in its feed; change is added, removed, renamed or retyped. Ordered by feed, file, change and names.

    `files` has file_id, feed_id, file_no and header, `rows` file_id and record. Files without a feed
    or header are left out; a file without rows changes names only; a field without values keeps its
    type; repeated rows change nothing. Empty tables give an empty result.
    """
    segments = _segments(files, rows)
    came, went, pairs = _renames(segments)
    blank = F.lit("")
    added = came.join(pairs, ["feed_id", "file_no", "new"], "left_anti").select("feed_id", "file_no", F.lit("added").alias("change"), blank.alias("old_field"), F.col("new").alias("new_field"))
    removed = went.join(pairs, ["feed_id", "file_no", "old"], "left_anti").select("feed_id", "file_no", F.lit("removed").alias("change"), F.col("old").alias("old_field"), blank.alias("new_field"))
    renamed = pairs.select("feed_id", "file_no", F.lit("renamed").alias("change"), F.col("old").alias("old_field"), F.col("new").alias("new_field"))
    retyped = segments.where("was is not null and kept.type <> was").select("feed_id", "file_no", F.col("name").alias("f"))
    both = pairs.where("was <> now").select("feed_id", "file_no", F.col("new").alias("f"))
    typed = retyped.union(both).select("feed_id", "file_no", F.lit("retyped").alias("change"), F.col("f").alias("old_field"), F.col("f").alias("new_field"))
    # the log in the order things happened; metadata, so its sort is small
    return added.union(removed).union(renamed).union(typed).orderBy("feed_id", "file_no", "change", "old_field", "new_field")


def _roots(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """(feed_id, name, segment, root): the first name each field had. One group holds a feed's names and
    renames, metadata that grows with its changes, not with its rows."""
    begun = segments.where("fresh = 1").select("feed_id", "name", "segment", "at", "file_no")
    named = begun.join(pairs.select("feed_id", "file_no", F.col("new").alias("name"), "old"), ["feed_id", "file_no", "name"], "left")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict[str, str] = {}
        out = []
        for _, same_file in pdf.sort_values("at").groupby("at", sort=True):
            here = {r.name_: root.get(r.old, r.old) if isinstance(r.old, str) else r.name_ for r in same_file.itertuples()}
            root.update(here)
            out += [(r.feed_id, r.name_, r.segment, here[r.name_]) for r in same_file.itertuples()]
        return pd.DataFrame(out, columns=["feed_id", "name", "segment", "root"])

    kind = segments.schema["feed_id"].dataType.simpleString()
    return named.withColumnRenamed("name", "name_").groupBy("feed_id").applyInPandas(chain, f"feed_id {kind}, name string, segment bigint, root string")


def _keyed(rooted: DataFrame, key: str) -> DataFrame:
    """`rooted` with the root of each feed's key field replaced by `key`. A feed that never names its key
    so has it under the name whose numbers are the likest to the other feeds' keys: by the share found
    among them, then by magnitude (different feeds may share no author)."""
    held = rooted.where("p is not null").groupBy("feed_id", "root").agg(
        F.expr("theta_union_agg(p.sketch, 9)").alias("s"), F.min("p.numbers").alias("numbers"), F.max("p.width").alias("width"),
        F.max("p.dates").alias("dates"), F.min("p.bottom").alias("bottom"), F.max("p.top").alias("top"), F.max(F.col("p.yes_no").cast("int")).alias("flag"),
    )
    named = held.where(F.col("root") == key)
    keys = named.agg(F.expr("theta_union_agg(s, 9)").alias("keys"), F.median("top").alias("size"))
    numeric = "numbers >= 0.9 and width <= 20 and dates < 0.9 and flag = 0 and top > 1 and not (bottom >= 1900 and top <= 2030)"
    others = held.join(named.select("feed_id"), "feed_id", "left_anti").where(numeric)
    share = F.expr("theta_sketch_estimate(theta_intersection(s, keys)) / greatest(theta_sketch_estimate(s), 1)")
    size = F.exp(-F.abs(F.log1p("top") - F.log1p("size")))
    scored = others.withColumns({"keys": keys.select("keys").scalar(), "size": keys.select("size").scalar()}).where("keys is not null")
    scored = scored.withColumn("alike", 2 * share + size).where(F.col("alike") >= 2 * SAME)
    best = scored.groupBy("feed_id").agg(F.max_by("root", F.struct("alike", "root")).alias("key_root"))
    return rooted.join(best, "feed_id", "left").withColumn("root", F.when(F.col("root") == F.col("key_root"), F.lit(key)).otherwise(F.col("root"))).drop("key_root")


def _stored(kind: str, digits: int, real_dates: bool) -> str:
    """The type of a column that no value of its kind is lost in: numbers too long for the kind's own type
    are stored as decimal(38,0) or text, dates as text if one isn't in the calendar."""
    if kind == "integer" and digits > 18:
        return "decimal(38,0)" if digits <= 38 else "string"
    if kind == "decimal" and digits > 15 or kind == "date" and not real_dates:
        return "string"
    return TYPES[kind]


def one_table(files: DataFrame, rows: DataFrame, key: str = "author_ID") -> DataFrame:
    """All records of all files in one table: feed_id, file_id, row_no, the key as a whole number, and a
    column for every field under the first name it had, in the type its values fold to.

    A field that a file lacks, and a value that is missing, is null; no other value is (`_stored`). The key is the number its value
    holds, whatever is written around it (`u00000012`, `id:12`, `12.0`). Every row is kept, repeated
    ones too. The number of columns is bounded by `MAX_FIELDS`.
    """
    n = _width(files)
    segments = _segments(files, rows)
    _, _, pairs = _renames(segments)
    rooted = cut(_keyed(segments.join(_roots(segments, pairs), ["feed_id", "name", "segment"]), key))
    folded = rooted.groupBy("root").agg(F.collect_set("p.type").alias("kinds"), F.max("p.digits").alias("digits"), F.every("p.real_dates").alias("real_dates"))
    types: dict[str, set[str]] = {}
    digits, real = {}, {}
    for root, kinds, most, dates in folded.limit(MAX_FIELDS + 1).collect():
        types[root], digits[root], real[root] = set(kinds), most or 0, dates is not False
    if len(types) > MAX_FIELDS:
        raise ValueError(f"the table would have more than {MAX_FIELDS} columns")
    layout = rooted.groupBy("feed_id", "file_id").agg(F.map_from_entries(F.collect_list(F.struct("root", "pos"))).alias("place"))
    cells = rows.select("file_id", "row_no", _cells(F.col("record"), n).alias("v")).join(layout, "file_id")
    # Spark's names ignore case: roots that differ in case alone share a column, each file having one of them
    spelled: dict[str, list[str]] = {}
    for root in sorted(types):
        spelled.setdefault(root.lower(), []).append(root)

    def column(roots: list[str]) -> Column:
        raw = F.coalesce(*(F.trim(F.try_element_at(F.col("v"), F.try_element_at("place", F.lit(r)) + 1)) for r in roots))
        value = F.when(~raw.isin(*MISSING), raw)
        if key in roots:
            number = F.regexp_extract(value, r"(\d+)(?:\.0*)?\D*$", 1)
            return F.when(number != "", number).try_cast(_stored("integer", max(digits[r] for r in roots), True)).alias(key)
        kinds = set().union(*(types[r] for r in roots))
        kind = next(iter(kinds)) if len(kinds) == 1 else "decimal" if kinds and kinds <= {"integer", "decimal"} else "text"
        name = roots[-1]
        return value.try_cast(_stored(kind, max(digits[r] for r in roots), all(real[r] for r in roots))).alias(f"{name}_" if name.lower() in ("feed_id", "file_id", "row_no") else name)

    own = spelled.pop(key.lower(), None)
    return cells.select("feed_id", "file_id", "row_no", *(column(r) for r in [own] * bool(own) + [spelled[k] for k in sorted(spelled)]))
