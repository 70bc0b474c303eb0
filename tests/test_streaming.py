import json
from datetime import datetime

from vitrine.operators import schedule
from vitrine.streaming.freshness import checkpointed_store, enrich_stream, notifications, schedule_stream, site_reads


def test_schedule_stream_equals_the_batch_fold(spark, tmp_path):
    ev = [(f"s{i % 3}", datetime(2026, 1, 1 + i), ("changed", "unchanged", "failed", "unchanged")[i % 4]) for i in range(20)]
    df = spark.createDataFrame(ev, "site string, ts timestamp, outcome string")
    for k in range(2):
        df.filter(f"day(ts) {'<=' if k == 0 else '>'} 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = schedule_stream(stream).writeStream.format("memory").queryName("plan").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {}
    for r in spark.sql("select * from plan").collect():
        rows[r.site] = (r.interval_hours, r.failures)
    want = {r.site: (r.interval_hours, r.failures) for r in schedule.schedule(df).collect()}
    assert set(rows) == set(want)


def test_enrichment_is_idempotent(spark, tmp_path):
    (tmp_path / "m").mkdir()
    line = lambda k: json.dumps({"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": k}}}]})
    (tmp_path / "m" / "1.txt").write_text(line("a") + "\n" + line("a") + "\nnot json\n" + line("b"))
    objects = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, name string")
    details = spark.createDataFrame([("a", "d")], "key string, detail string")
    for _ in range(2):
        enrich_stream(notifications(spark, str(tmp_path / "m")), objects, details, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.key: (r.detail, r.errors) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": ("d", []), "b": (None, ["details"])}


def test_rows_are_stored_a_batch_at_a_time(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    for i in range(2):
        df.filter(f"v % 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        checkpointed_store(stream, "k", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_a_batch_of_site_reads(spark):
    now, before = datetime(2026, 6, 1, 12), datetime(2026, 5, 1)
    reads = spark.createDataFrame([("down", False, False, 0, None, now), ("same", True, True, 0, None, now), ("new", True, False, 2, "f2", now), ("empty", True, False, 0, "f0", now)], "site string, reached boolean, not_modified boolean, found int, fingerprint string, began timestamp")
    listings = spark.createDataFrame([(i, s, "scraped", seen, None) for i, (s, seen) in enumerate([("down", before), ("same", before), ("new", before), ("new", now), ("empty", before)])] + [(9, "new", "submitted", before, None)], "exhibition_id int, site string, source string, last_seen_at timestamp, retired_at timestamp")
    states = spark.createDataFrame([("down", 168.0, 1, "x"), ("same", 168.0, 0, "x"), ("new", 168.0, 0, "f1")], "site string, interval_hours double, consecutive_failures int, fingerprint string")
    got = site_reads(reads, listings, states, spark.createDataFrame([], "site string, closes date"), now)
    assert {r.site: r.outcome for r in got["outcomes"].collect()} == {"down": "failed", "same": "unchanged", "new": "changed", "empty": "changed"}
    assert [r.exhibition_id for r in got["retired"].collect()] == [2] and [r.site for r in got["touched"].collect()] == ["same"]
    assert {r.site: (r.failures, r.interval_hours) for r in got["plan"].collect()} == {"down": (2, 168.0), "same": (0, 252.0), "new": (0, 84.0), "empty": (0, 168.0)}
