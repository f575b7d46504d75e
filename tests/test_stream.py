import json
from datetime import datetime

from rosterlake.streaming import ingest


def test_files_become_rows_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps([{"name": "Ada"}, {"name": "Bob", "mail": "b@c.example"}]))
    for _ in range(2):
        query = ingest.start(ingest.arrivals(spark, str(tmp_path / "in")), str(tmp_path / "pool"), str(tmp_path / "check"), 1)
        query.awaitTermination()
    (tmp_path / "in" / "b.json").write_text(json.dumps({"candidates": [{"name": "Cy"}]}))
    ingest.start(ingest.arrivals(spark, str(tmp_path / "in")), str(tmp_path / "pool"), str(tmp_path / "check"), 1).awaitTermination()
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "pool")).collect()) == ["Ada", "Bob", "Cy"]


def _streamed(spark, tmp_path, rows, schema, made, mode):
    """The rows that a streaming transform gives for batches of rows, one file each."""
    where = str(tmp_path / "in")
    for n, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(where)
        query = made(spark.readStream.schema(schema).parquet(where)).writeStream.format("parquet" if mode == "append" else "memory").queryName(f"q{n}")
        query = query.option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_first_of_each_fingerprint_is_kept(spark, tmp_path):
    at = [datetime(2024, 1, 1, h) for h in range(4)]
    batches = [[("email", "f1", at[0]), ("email", "f1", at[1]), ("phone", "f1", at[1])], [("email", "f1", at[2]), ("email", "f2", at[3])]]
    got = _streamed(spark, tmp_path, batches, "kind string, fingerprint string, arrived_at timestamp", ingest.first_seen, "append").collect()
    assert sorted((r.kind, r.fingerprint) for r in got) == [("email", "f1"), ("email", "f2"), ("phone", "f1")]


def test_files_are_counted_by_day_while_late_ones_may_come(spark, tmp_path):
    day = lambda d, h=0: datetime(2024, 1, d, h)
    batches = [[("a", day(1), 5), ("a", day(3), 1)], [("a", day(1, 6), 2)], [("b", day(25), 9)], [("a", day(2), 7)], [("b", day(26), 1)]]
    got = _streamed(spark, tmp_path, batches, "feed string, received_at timestamp, n_records int", ingest.feed_counts, "append").collect()
    counts = {(r.window.start.day, r.feed): (r.n_files, r.n_records) for r in got}
    assert counts[1, "a"] == (2, 7) and counts[3, "a"] == (1, 1)
    assert (2, "a") not in counts  # later than the watermark allows
