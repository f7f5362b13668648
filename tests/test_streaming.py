from lexmill.operators.docstats import fast_stats
from lexmill.streaming.texts import append_parquet, cleaned, document_stats, read_parquet_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "<b>One</b> two two http://x.example"), (2, None), (3, "three")]
    batch = spark.createDataFrame(rows, "id int, text string")
    batch.write.parquet(str(tmp_path / "in"))
    for name, f in (("stats", document_stats), ("clean", cleaned)):
        stream = read_parquet_stream(spark, str(tmp_path / "in"), batch.schema)
        query = append_parquet(f(stream, "id", "text"), str(tmp_path / name), str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "stats")).collect()) == sorted(fast_stats(batch, "id", "text").collect())
    assert {r.id: r.toks for r in spark.read.parquet(str(tmp_path / "clean")).collect()} == {1: ["one", "two", "two"], 2: [], 3: ["three"]}
