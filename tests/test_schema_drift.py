import csv
import io

from lexmill.operators.schema_drift import one_table, schema_changes

FILES = "file_id bigint, feed_id bigint, file_no int, header string, extra string"
ROWS = "file_id bigint, row_no int, record string, name string"
WORDS = ("angry", "calm", "happy", "tired")


def line(*cells):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(cells)
    return out.getvalue()


def frames(spark, files):
    """files: (feed, number, header, rows of cells)."""
    heads = [(i, feed, no, header, "x") for i, (feed, no, header, _) in enumerate(files)]
    rows = [(i, k, line(*cells), "x") for i, (_, _, _, content) in enumerate(files) for k, cells in enumerate(content)]
    return spark.createDataFrame(heads, FILES), spark.createDataFrame(rows, ROWS)


def rows(n, *columns):
    return [[c(i) for c in columns] for i in range(n)]


def key(i):
    return str(300 + 37 * i)


def post(i):
    return f'A post of some length, number {i},\nwith a "quote" and a break.'


def likes(i):
    return str(i * 3 % 40)


def mood(i):
    return WORDS[i % 4]


def feed():
    return [
        (1, 1, " author_ID ,post, likes,mood", rows(12, key, post, likes, mood)),
        (1, 2, "mood,author_ID,post,likes", rows(12, mood, key, post, lambda i: likes(i) + ".0")),
        (1, 3, "author_ID,body,likes", rows(12, lambda i: "id:" + key(i), post, lambda i: likes(i) + ".0")),
        (1, 4, "uid,body,likes,quality", rows(12, lambda i: "id:" + key(i), post, lambda i: "NA", lambda i: f"0.{i + 10}")),
        (1, 5, "uid,body,likes,tone", rows(12, lambda i: "id:" + key(i), post, lambda i: likes(i) + ".0", mood)),
        (2, 1, "author_ID,post", rows(3, key, post)),
    ]


def test_changes(spark):
    log = [tuple(r) for r in schema_changes(*frames(spark, feed())).collect()]
    assert log == sorted(log)
    assert set(log) == {
        (1, 2, "retyped", "likes", "likes"),
        (1, 3, "removed", "mood", ""),
        (1, 3, "renamed", "post", "body"),
        (1, 3, "retyped", "author_ID", "author_ID"),
        (1, 4, "renamed", "author_ID", "uid"),
        (1, 4, "added", "", "quality"),
        (1, 5, "removed", "quality", ""),
        (1, 5, "added", "", "tone"),
    }


def test_repeated_rows_order_and_gaps_change_nothing(spark):
    files, lines = frames(spark, feed())
    again = {tuple(r) for r in schema_changes(files.orderBy(files.file_no.desc()), lines.union(lines)).collect()}
    assert again == {tuple(r) for r in schema_changes(files, lines).collect()}


def test_one_table(spark):
    files, lines = frames(spark, feed())
    table = one_table(files, lines)
    assert table.count() == lines.count()
    kinds = dict(table.dtypes)
    assert kinds["author_ID"] == "bigint" and kinds["likes"] == "double" and kinds["post"] == "string" and kinds["quality"] == "double"
    got = {(r.file_id, r.row_no): r for r in table.collect()}
    assert got[3, 2].author_ID == int(key(2)) and got[3, 2].post == post(2) and got[3, 2].likes is None and got[0, 5].mood == mood(5)


def test_no_present_value_turns_null(spark):
    huge, day, fine = "123456789012345678901", "2023-02-30", "0.12345678901234567"
    cells = [["1" + "0" * 21, huge, day, fine, "7", "2023-02-01", "9" * 40], ["5", "7", "2023-02-01", "1.5", "8", "2024-02-29", "1"]]
    table = one_table(*frames(spark, [(1, 1, "author_ID,serial,seen,ratio,likes,born,hash", cells)]))
    got = {r.row_no: r for r in table.collect()}
    assert (int(got[0].author_ID), int(got[0].serial), str(got[0].seen), str(got[0].ratio), str(got[0].hash)) == (10**21, int(huge), day, fine, "9" * 40)
    assert {c: k for c, k in table.dtypes if c in ("likes", "born")} == {"likes": "bigint", "born": "date"} and all(x is not None for r in got.values() for x in r)


def test_empty_and_null(spark):
    files, lines = frames(spark, feed())
    assert schema_changes(files.where("false"), lines).count() == 0
    assert one_table(files.where("false"), lines.where("false")).count() == 0
    bare = spark.createDataFrame([(0, 1, 1, "a,b", None), (1, 1, 2, "a,c", None), (2, None, 3, "a", None), (3, 1, 3, None, None)], FILES)
    none = spark.createDataFrame([(None, 1, "x,y", None), (0, None, None, None)], ROWS)
    assert {tuple(r) for r in schema_changes(bare, none).collect()} == {(1, 2, "added", "", "c"), (1, 2, "removed", "b", "")}
