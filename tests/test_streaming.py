"""Streams that come out of order, and losses that stop."""

import datetime as dt

from brepflow.streaming.alarms import streak_alarms

T0 = dt.datetime(2024, 1, 1)


def test_out_of_order_batches_wait_for_the_watermark(spark, tmp_path):
    schema = "run string, seq bigint, counts boolean, resets boolean, stops boolean, ts timestamp"
    row = lambda i, counts=True, resets=False, stops=False: ("r", i, counts, resets, stops, T0 + dt.timedelta(minutes=i))
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[row(0), row(2), row(3)], [row(1, False, True), row(5, False, False, True)], [row(4), row(6)], [row(60)], [row(61)]]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = streak_alarms(spark.readStream.schema(schema).parquet(source), 2, 3, at="ts", lateness="5 minutes")
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.seq: (r.streak, r.alarm) for r in spark.read.parquet(sink).collect()}
    assert {k: v for k, v in got.items() if k < 60} == {0: (1, "none"), 1: (0, "none"), 2: (1, "none"), 3: (2, "warn"), 4: (3, "fatal"), 5: (3, "stop"), 6: (4, "fatal")}
