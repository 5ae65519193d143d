from pyspark.sql import functions as F

from textloom import streaming


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_matches_and_windows(spark, tmp_path):
    rows = [(1, "banana", "2024-01-01 00:00:10"), (2, "anana ana", "2024-01-01 00:00:50"), (3, "none here", "2024-01-01 00:01:10"), (4, "ana", "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "doc_id long, text string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string, at timestamp").parquet(str(tmp_path / "in"))
    got = run(streaming.matches(stream, "ana", with_positions=True), "matched")
    assert sorted((r.doc_id, r.n, r.positions) for r in got) == [(1, 2, [1, 3]), (2, 3, [0, 2, 6]), (4, 1, [0])]
    windows = run(streaming.counts_by_window(stream, "ana", "at", "1 minute", "10 minutes"), "windows", "complete")
    assert sorted((r.start.minute, r.n_docs, r.n) for r in windows) == [(0, 1, 1), (0, 2, 5)]
