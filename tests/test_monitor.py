"""Monitoring streams against the batch operators, and on the wall clock."""

import random
import time

from pyspark.sql import functions as F

from netloom.operators import metrics, traffic
from netloom.streaming import monitor
from netloom.streaming.detect import write_once

T0 = 1_700_000_000


def events(spark, path, batches=4):
    """Minutes of events in files of increasing time, each shuffled inside, and a last one that closes all windows."""
    rng = random.Random(2)
    rows = [(T0 + 60 * m + rng.randrange(60), rng.choice("abc") if not 40 < m < 55 else "c", float(rng.randrange(100)) + m) for m in range(120) if m % 17 for _ in range(5)]
    df = spark.createDataFrame(rows, "s long, kind string, value double").withColumn("ts", F.timestamp_seconds("s"))
    step = 120 * 60 // batches
    for k in range(batches):
        part = df.where(F.col("s").between(T0 + k * step, T0 + (k + 1) * step - 1))
        part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    spark.createDataFrame([(T0 + 86_400, "end", 0.0)], "s long, kind string, value double").withColumn(
        "ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
    return df


def run(spark, stream, folder):
    q = stream.writeStream.foreachBatch(lambda b, i: write_once(b, i, f"{folder}/out")).option("checkpointLocation", f"{folder}/state")
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def source(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_equal_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    df = events(spark, path)
    got = run(spark, monitor.increase_stream(source(spark, df, path), "10 minutes", "2 minutes", "kind = 'a'", "1 minute"), tmp_path / "i")
    same(got.where(F.col("ts") < F.timestamp_seconds(F.lit(T0 + 80_000))), metrics.increase(df, "10 minutes", "2 minutes", "kind = 'a'"))
    got = run(spark, monitor.average_stream(source(spark, df, path), "value", "5 minutes", "1 minute"), tmp_path / "a")
    same(got, metrics.windowed_average(df, "value", "5 minutes"))

    def predictions(rows):
        attack = F.col("kind") != "c"
        return rows.select("ts", attack.alias("is_attack"), F.when(attack, F.upper("kind")).otherwise("BENIGN").alias("attack_type"),
                           (F.col("value") / 220).alias("attack_confidence"), F.lit(0.5).alias("iso_score"), F.lit(None).cast("string").alias("error"))

    got = run(spark, monitor.counters_stream(predictions(source(spark, df, path)), "30 minutes", "1 minute"), tmp_path / "c")
    same(got, traffic.traffic_counters(predictions(df), "30 minutes"))


def test_rules_fire_and_resolve_as_in_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    df = events(spark, path)
    ratio = monitor.ratio_stream(source(spark, df, path), "kind = 'c'", "2 minutes", "1 minute")
    stream = monitor.hold_stream(metrics.firing(ratio, "ratio", 0.3), 240, 120, "many c")
    got = run(spark, stream, tmp_path).collect()
    want = metrics.hold_for(metrics.firing(metrics.windowed_ratio(df, "kind = 'c'", "2 minutes"), "ratio", 0.3), 240, step_s=120)
    want = want.select(F.unix_micros("started"), F.unix_micros("fired"), F.unix_micros("ended")).collect()
    assert len(want) >= 2
    assert sorted((r.started_us, r.fired_us, r.ended_us) for r in got if r.event == "resolved") == sorted(map(tuple, want))
    assert sorted((r.started_us, r.fired_us) for r in got if r.event == "firing") == sorted((a, b) for a, b, _ in want)


def test_silence_fires_once_and_recovers(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    beat = lambda names: spark.createDataFrame([(n,) for n in names], "source string").coalesce(1).write.mode("append").parquet(path)
    beat(["a", "b"])
    stream = monitor.silence_stream(spark.readStream.schema("source string").parquet(path), 6)
    q = stream.writeStream.foreachBatch(lambda b, _: seen.extend((r.source, r.event) for r in b.collect()))
    q = q.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        deadline = time.time() + 120
        while ("b", "silent") not in seen and time.time() < deadline:
            beat(["a"])
            time.sleep(1)
        beat(["b", "a"])
        while ("b", "recovered") not in seen and time.time() < deadline:
            beat(["a", "b"])
            time.sleep(1)
    finally:
        q.stop()
    assert [x for x in seen if x[0] == "b"][:2] == [("b", "silent"), ("b", "recovered")]


def test_late_rows_are_counted(spark, tmp_path):
    path = str(tmp_path / "in")
    put = lambda seconds: spark.createDataFrame([(T0 + s,) for s in seconds], "s long").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
    late = monitor.LateRows()
    spark.streams.addListener(late)
    try:
        put([0, 10, 1000])
        stream = spark.readStream.schema("s long, ts timestamp").parquet(path)
        windows = metrics.per_second(stream.withWatermark("ts", "10 seconds"), "10 seconds")
        q = windows.writeStream.foreachBatch(lambda b, i: b.count()).option("checkpointLocation", str(tmp_path / "s")).queryName("windows").start()
        try:
            q.processAllAvailable()
            put([1, 2, 3, 1001])
            q.processAllAvailable()
            for _ in range(50):
                if late.rows:
                    break
                time.sleep(0.2)
        finally:
            q.stop()
    finally:
        spark.streams.removeListener(late)
    rows = late.table(spark).collect()
    # The three seconds share one window, and a window is dropped as a whole.
    assert rows and {r.name for r in rows} == {"windows"} and sum(r.dropped for r in rows) in (1, 3)
