"""Streams over several micro-batches, with late rows and restarts."""

import datetime as dt

from pyspark.sql import functions as F

from loomlake.streaming import streams as X

DAY = dt.datetime(2024, 3, 1)


def batch(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_blocks_go_on_over_batches_and_drop_late_rows(spark, tmp_path):
    schema, src, out, mark = "who string, id long, ts timestamp", f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    at = lambda m: DAY + dt.timedelta(minutes=m)
    parts = [
        [("a", 9000 - i, at(i)) for i in range(7)] + [("b", i * 17, at(i)) for i in range(3)],
        [("a", 100 + i, at(10 + i)) for i in range(5)] + [("b", 4, at(300))],
        [("a", 7, at(1)), ("b", 5, at(301)), ("c", 1, at(302))],  # a's row is late by now
    ]
    for rows in parts:
        batch(spark, src, rows, schema)
        X.run_available(X.stream_blocks(spark.readStream.schema(schema).parquet(src), "who", "id", "ts", 5, "60 minutes"), out, mark)
    got = {}
    for r in spark.read.parquet(out).collect():
        got.setdefault(r.who, []).append((r.place, r.block, r.id))
    order = {"a": [9000 - i for i in range(7)] + [100 + i for i in range(5)], "b": [0, 17, 34, 4, 5], "c": [1]}
    late = 7 in [i for *_, i in got["a"]]
    assert not late
    for who, ids in order.items():
        assert sorted(got[who]) == [(n, n // 5, i) for n, i in enumerate(ids)]


def test_health_of_a_growing_log(spark, tmp_path):
    schema, src = "ts timestamp, event_type string, tokens int", f"{tmp_path}/in"
    every = []
    for day in range(3):
        rows = [(DAY + dt.timedelta(days=day, hours=h), "error" if h % 3 else "call", h) for h in range(5)] + [(DAY, "call", 50 + day)]
        every += rows
        batch(spark, src, rows, schema)
        stream = X.event_health(spark.readStream.schema(schema).parquet(src), watermark="30 days")
        latest = X.run_latest(stream, ["start", "event_type"], f"{tmp_path}/out", f"{tmp_path}/mark")
        want = X.event_health(spark.createDataFrame(every, schema))
        columns = want.columns
        assert sorted(map(tuple, latest.select(columns).collect())) == sorted(map(tuple, want.collect()))
    assert latest.where(F.col("calls") > 3).count() >= 1
