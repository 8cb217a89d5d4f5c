"""Boards that become due as a stream's clock passes, beside the batch fold of the same polls."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from boardlake.streaming import poll_state, timers

START = datetime(2024, 1, 1)
POLLS = "domain string, changed boolean, failed boolean, polled_at timestamp, watched boolean"


def test_boards_come_due_with_the_clock(spark, tmp_path):
    at = lambda **t: START + timedelta(**t)
    batches = [
        [("a", True, False, at(), False), ("b", False, False, at(), True), ("c", False, True, at(seconds=1), False), (None, True, False, at(), False)],
        [("a", False, False, at(minutes=4), None), ("clock", True, False, at(minutes=4), False)],
        [("clock", True, False, at(hours=1), False)],
        [("b", True, False, at(minutes=1), False), ("clock", True, False, at(days=20), False)],
        [("clock", True, False, at(days=21), False)],
    ]
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, POLLS).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        stream = spark.readStream.schema(POLLS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = timers.due_boards(stream)
        query = out.writeStream.outputMode("update").foreachBatch(lambda b, k: b.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    got = [tuple(r) for r in spark.read.schema(timers.EVENTS).parquet(str(tmp_path / "out")).where("domain <> 'clock'").orderBy("at", "domain").collect()]
    # the batch fold of the same polls: a poll of b that came late is none
    state = spark.createDataFrame([], "domain string, interval_s int, next_at timestamp, last_change timestamp")
    for rows in batches[:2]:
        polls = spark.createDataFrame([r[:4] for r in rows if r[0]], POLLS.rsplit(",", 1)[0])
        state = poll_state.record(state, polls, spark.createDataFrame([("b",)], "domain string"))
    want = {r["domain"]: (r["next_at"], r["interval_s"]) for r in state.collect() if r["domain"] != "clock"}
    assert {d: (t, i) for d, e, t, i in got if e == "due"} == want and len(want) == 3
    assert [(d, t) for d, e, t, _ in got if e == "unwatched"] == [("b", START + timers.WATCH)] and len(got) == 4 and F
