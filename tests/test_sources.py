from lexmill.sources.datasets import csv_folder, initials, key_number, keyed, normalise_header, write_csv, write_json


def test_csv_folder(spark, tmp_path):
    (tmp_path / "b_set.csv").write_text(' auhtor_ID ,post\n12,"a, ""b""\nc"\nNA,null\n')
    (tmp_path / "a_set.csv").write_text("author_ID,post\nu0001,hello\n")
    (tmp_path / "other.CSV").write_text("x\n1\n")
    got = csv_folder(spark, str(tmp_path))
    assert list(got) == ["a_set", "b_set"]
    assert got["b_set"].columns == ["author_ID", "post"]
    assert [tuple(r) for r in got["b_set"].collect()] == [("12", 'a, "b"\nc'), (None, None)]


def test_csv_folder_with_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text("author_ID,n,x,flag,mixed,none\n1, 5,1.5,True,7,NA\n2,,2,false,a,\n3,-7,1e3,NaN,8,null\n")
    df = csv_folder(spark, str(tmp_path), infer=True)["t"]
    assert dict(df.dtypes) == {"author_ID": "bigint", "n": "bigint", "x": "double", "flag": "boolean", "mixed": "string", "none": "string"}
    assert [tuple(r) for r in df.orderBy("author_ID").collect()] == [(1, 5, 1.5, True, "7", None), (2, None, 2.0, False, "a", None), (3, -7, 1000.0, None, "8", None)]


def test_keys(spark):
    forms = ["u00000012", "U_00000012", " u0000 0012", "@u00000012", "12", "12.0", None, "none", ""]
    df = spark.createDataFrame([(f,) for f in forms], "k string")
    assert [r[0] for r in df.select(key_number(df.k)).collect()] == [12] * 6 + [None] * 3


def test_keyed_takes_a_record_once(spark):
    df = spark.createDataFrame([(1, "u1", "p", 5), (1, "u1", "p", 9), (None, "u2", "q", 1)], "rid int, auhtor_ID string, post string, loaded_at int")
    assert [tuple(r) for r in keyed(df).collect()] == [(1, 1, "p")]
    assert initials("political_leaning") == "p_l"
    assert normalise_header(df.toDF("rid", " author_ID", "post ", "auhtor_ID")).columns == ["rid", "author_ID", "post", "auhtor_ID"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    write_csv(df, str(tmp_path / "c"))
    write_json(df, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().k == "a"
    assert spark.read.json(str(tmp_path / "j")).first().n == 1
