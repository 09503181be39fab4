"""State with timers: expiry, late rows, heartbeats, restarts; each batch is a file of its own."""

import json
import os

from pyspark.sql import functions as F

from lexmill.streaming import timers

BASE = 1_700_000_000


def batches(spark, folder, rows, schema):
    """A stream whose batches are the given lists of rows; ``ts`` is seconds after a base."""
    folder.mkdir()
    for i, batch in enumerate(rows):
        lines = [json.dumps(dict(r, ts=f"{_stamp(r['ts'])}")) for r in batch]
        (folder / f"{i:03}.json").write_text("\n".join(lines))
        os.utime(folder / f"{i:03}.json", (BASE + i, BASE + i))  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(folder))


def _stamp(seconds):
    import datetime

    return datetime.datetime.fromtimestamp(BASE + seconds, datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def run(stream, folder, name, mode):
    """Everything that the stream writes, with the batch it came in."""
    write = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/out")
    query = stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/cp")
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out").orderBy("batch").collect()


def test_memories_are_cleared_when_idle(spark, tmp_path):
    say = lambda c, t, ts, text="x": {"conv_id": c, "turn": t, "role": "assistant" if t % 2 else "user", "text": text, "ts": ts}
    rows = [[say(1, 0, 0), say(1, 1, 5, "y" * 600), say(2, 0, 3)], [say(2, i, 3600 + i) for i in range(1, 21)], [say(2, 30, 9000)], [say(1, 2, 9100), say(1, 3, 10)], [say(3, 0, 9200)]]
    stream = batches(spark, tmp_path / "in", rows, "conv_id long, turn long, role string, text string, ts timestamp")
    got = run(timers.session_memory(stream, "30 minutes", "1 minute"), tmp_path, "memories", "update")
    first = [r for r in got if r.conv_id == 1]
    assert first[0].history == ["user: x", "assistant: " + "y" * 500 + "..."] and not first[0].cleared
    assert any(r.cleared for r in first)
    assert [r.history for r in first if not r.cleared][-1] == ["user: x"]  # anew, and the late message is left out
    assert [len(r.history) for r in got if r.conv_id == 2 and r.turn == 20] == [12]


def test_feed_beats_until_its_end(spark, tmp_path):
    tell = lambda c, seq, ts, event="entity": {"corpus": c, "seq": seq, "event": event, "data": str(seq), "ts": ts}
    rows = [[tell("a", 1, 0), tell("b", 1, 1)], [tell("b", 2, 100)], [tell("b", 3, 101)], [tell("b", 4, 300)], [tell("b", 5, 301), tell("a", 2, 302, "done"), tell("a", 3, 303)]]
    stream = batches(spark, tmp_path / "in", rows, "corpus string, seq long, event string, data string, ts timestamp")
    got = sorted((r.corpus, r.n, r.event) for r in run(timers.event_feed(stream), tmp_path, "feed", "append"))
    a = [e for c, _, e in got if c == "a"]
    assert a[0] == "entity" and a[-1] == "done" and set(a[1:-1]) == {"heartbeat"} and len(a) >= 4
    assert [n for c, n, _ in got if c == "a"] == list(range(1, len(a) + 1))
    assert [e for c, _, e in got if c == "b"].count("entity") == 5


def test_cache_expires_and_survives_a_restart(spark, tmp_path):
    ask = lambda i, ts, key="k": {"key": key, "request_id": i, "value": f"v{i}", "ts": ts}
    schema = "key string, request_id long, value string, ts timestamp"
    stream = batches(spark, tmp_path / "in", [[ask(1, 0), ask(2, 200)], [ask(3, 299), ask(4, 301)]], schema)
    run(timers.cached(stream, late="1 hour"), tmp_path, "cache", "append")
    (tmp_path / "in/900.json").write_text("\n".join(json.dumps(dict(r, ts=_stamp(r["ts"]))) for r in [ask(5, 600), ask(6, 602), ask(7, 602, "other")]))
    again = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = {r.request_id: (r.value, r.hit) for r in run(timers.cached(again, late="1 hour"), tmp_path, "cache2", "append")}
    assert got == {1: ("v1", False), 2: ("v1", True), 3: ("v1", True), 4: ("v4", False), 5: ("v4", True), 6: ("v6", False), 7: ("v7", False)}
