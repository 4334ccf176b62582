"""Streams against the batch operators on the same packets."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.config import AlertParams, DetectionParams, FlowParams
from netloom.operators.alerts import dedup_alerts, notification_queue
from netloom.operators.features import flow_features
from netloom.operators.flows import assemble_flows
from netloom.plans.detection import detect
from netloom.plans.views import rule_scores
from netloom.schema import PACKET_SCHEMA
from netloom.sources.alerts import read_alerts, to_alert_rows
from netloom.sources.packets import packet_stream
from netloom.streaming.dedup import dedup_stream
from netloom.streaming.detect import run_detection
from netloom.streaming.flows import assemble_stream, flush_open_flows

PARAMS = FlowParams(idle_s=30, absolute_s=90, slice_s=60)


@pytest.fixture(scope="module")
def packet_dir(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = []
    t = 1_700_000_000.0
    for i in range(900):
        t += rng.random() * 2
        a, b = ("10.0.0.1", 1000 + rng.randrange(5)), ("10.0.0.2", 80)
        if rng.random() < 0.4:
            a, b = b, a
        flags = rng.choice([16, 16, 16, 24, 2, 17, 4] if rng.random() < 0.3 else [16])
        rows.append((i, t, a[0], b[0], a[1], b[1], 6, 40 + rng.randrange(900), 40, flags, 512))
    df = spark.createDataFrame(rows, "packet_id long, t double, src_ip string, dst_ip string, src_port int, dst_port int,"
                                     " protocol int, length int, header_len int, tcp_flags int, window_size int")
    df = df.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).select(*PACKET_SCHEMA.names)
    path = str(tmp_path_factory.mktemp("packets"))
    # Several files, each one stretch of time with its packets shuffled.
    for k in range(4):
        df.where(f"packet_id >= {k * 225} AND packet_id < {(k + 1) * 225}").orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(path)
    return path


def test_stream_equals_batch(spark, packet_dir, tmp_path):
    parts = []

    def keep(batch, _):
        parts.extend(flow_features(batch, PARAMS).collect())

    stream = assemble_stream(packet_stream(spark, packet_dir, max_files=1), PARAMS, "5 minutes")
    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rest = flow_features(flush_open_flows(spark, str(tmp_path / "c"), PARAMS), PARAMS).collect()
    batch = flow_features(assemble_flows(spark.read.schema(PACKET_SCHEMA).parquet(packet_dir), PARAMS), PARAMS)
    want = {r.flow_id: r for r in batch.collect()}
    got = {r.flow_id: r for r in [*parts, *rest]}
    assert len(parts) > 50 and len(rest) >= 1
    assert len(parts) + len(rest) == len(want)
    for fid, r in want.items():
        for name in batch.columns:
            a, b = r[name], got[fid][name]
            same = a == b or (isinstance(a, float) and abs(a - b) <= 1e-6 * max(1.0, abs(a)))
            assert same, (fid, name, a, b)


def test_dedup_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, 1_700_000_000_000_000 + i * 3_000_000 + rng.randrange(2_000_000), f"s{rng.randrange(3)}", "d", "DDoS") for i in range(300)]
    df = spark.createDataFrame(rows, "flow_id long, us long, src_ip string, dst_ip string, attack_type string")
    df = df.withColumn("ts", F.timestamp_micros("us")).drop("us")
    path = str(tmp_path / "in")
    for k in range(3):
        df.where(F.col("flow_id") % 3 == k).coalesce(1).write.mode("append").parquet(path)
    seen = []
    stream = dedup_stream(spark.readStream.schema(df.schema).parquet(path), 60, delay="1 hour")
    q = stream.writeStream.foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c"))
    q.trigger(availableNow=True).start().awaitTermination()
    # The watermark stays an hour behind, so nothing is decided yet; one late alert moves it on.
    late = [(10_000, "x", "y", "Bot", 1_700_000_000_000_000 + 10 * 3_600_000_000)]
    spark.createDataFrame(late, "flow_id long, src_ip string, dst_ip string, attack_type string, us long").withColumn(
        "ts", F.timestamp_micros("us")).select(df.columns).coalesce(1).write.mode("append").parquet(path)
    q.trigger(availableNow=True).start().awaitTermination()
    want = {r.flow_id: (r.is_first, r.anchor_id) for r in dedup_alerts(df, 60).collect()}
    assert {r.flow_id: (r.is_first, r.anchor_id) for r in seen if r.flow_id != 10_000} == want


def test_run_detection_stores_alerts(spark, packet_dir, tmp_path):
    params = DetectionParams(flows=PARAMS, alerts=AlertParams(dedup_window_s=120))
    queries = run_detection(spark, packet_stream(spark, packet_dir, 2), str(tmp_path), rule_scores, params, delay="1 minute")
    for q in queries:
        q.awaitTermination()
        assert q.exception() is None
    alerts = read_alerts(spark, str(tmp_path / "alerts"))
    batch = detect(spark.read.schema(PACKET_SCHEMA).parquet(packet_dir), rule_scores, params).where("outcome = 'alert'")
    want = {(r.ts, r.src_ip, r.src_port, r.attack_type) for r in batch.collect()}
    got = {(r.timestamp, r.src_ip, r.src_port, r.attack_type) for r in alerts.collect()}
    assert got == want and len(got) > 5


def _alerts(df):
    return sorted((r.timestamp, r.src_ip, r.src_port, r.attack_type) for r in df.collect())


def test_runs_go_on_where_the_last_one_ended(spark, packet_dir, tmp_path):
    """Three runs over a growing folder: after each, the tables equal the batch plan over what has come."""
    params = DetectionParams(flows=PARAMS, alerts=AlertParams(dedup_window_s=120))
    packets, source = spark.read.schema(PACKET_SCHEMA).parquet(packet_dir).cache(), str(tmp_path / "in")
    folder = str(tmp_path / "out")
    for run, (low, high) in enumerate([(0, 350), (350, 420), (420, 900)]):
        packets.where(f"packet_id >= {low} AND packet_id < {high}").coalesce(2).write.mode("append").parquet(source)
        for q in run_detection(spark, packet_stream(spark, source), folder, rule_scores, params, delay="1 minute"):
            assert q.exception() is None
        batch = detect(packets.where(f"packet_id < {high}"), rule_scores, params).cache()
        got = spark.read.parquet(f"{folder}/predictions")
        assert sorted(r.flow_id for r in got.collect()) == sorted(r.flow_id for r in batch.collect()), run
        alerts = batch.where("outcome = 'alert'").withColumn("timestamp", F.col("ts"))
        assert _alerts(read_alerts(spark, f"{folder}/alerts")) == _alerts(alerts), run
        notices = spark.read.parquet(f"{folder}/notices")
        assert notices.count() == notification_queue(to_alert_rows(alerts), params.alerts.notify_min_severity).count()
    # A run without new packets changes nothing.
    before = _alerts(read_alerts(spark, f"{folder}/alerts"))
    run_detection(spark, packet_stream(spark, source), folder, rule_scores, params, delay="1 minute")
    assert _alerts(read_alerts(spark, f"{folder}/alerts")) == before


class _Map(dict):
    reads = 0

    containsKey = dict.__contains__

    def getValue(self, key):
        type(self).reads += len(self[key][0]) if isinstance(self[key][0], list) else 0
        return self[key]

    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


class _List:
    reads = 0

    def __init__(self):
        self.rows = []

    def get(self):
        type(self).reads += len(self.rows)
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows += rows

    def clear(self):
        self.rows = []


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return _Map()

    def getListState(self, *_):
        return _List()

    def getValueState(self, *_):
        return _Value()

    def registerTimer(self, at):
        self.timers.add(at)


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_every_waiting_row_is_read_once():
    """One key with an open flow: what a batch reads does not grow with what the key holds."""
    import pandas as pd

    from netloom.streaming import flows as S

    processor = S.FlowProcessor(FlowParams(idle_s=60, absolute_s=3600))
    handle = _Handle()
    processor.init(handle)
    _Map.reads = _List.reads = 0
    rows, out, start = 0, [], 1_700_000_000
    for batch in range(300):
        new = pd.DataFrame([((start + batch * 10 + k) * 1_000_000, batch * 10 + k, k % 2, 100, 40, 16, 512) for k in range(10)], columns=list(S._PACKET))
        assert list(processor.handleInputRows(("a", 1, "b", 2, 6), iter([new]), _Clock(0))) == []
        rows += len(new)
        clock = (start + batch * 10 - 30) * 1000
        for at in sorted(t for t in handle.timers if t <= clock):
            handle.timers.discard(at)
            out += processor.handleExpiredTimer(("a", 1, "b", 2, 6), _Clock(clock), None)
        assert _Map.reads <= rows and _List.reads == 0
    assert not out and _Map.reads >= rows - 60
    late = (start + 100_000) * 1000
    while any(t <= late for t in handle.timers):
        at = min(handle.timers)
        handle.timers.discard(at)
        out += processor.handleExpiredTimer(("a", 1, "b", 2, 6), _Clock(late), None)
    assert _Map.reads == rows and _List.reads <= rows
    assert sum(len(f) for f in out) == rows and not handle.timers and processor.head.value is None


def test_rows_far_behind_the_newest_are_one_chunk():
    """A month of one key in one batch: the accesses to the state do not grow with its time buckets, and the flows are the same."""
    import random

    import pandas as pd

    from netloom.streaming import flows as S

    rng, key, start = random.Random(3), ("a", 1, "b", 2, 6), 1_700_000_000
    packets = [((start + rng.randrange(2_592_000)) * 1_000_000, k, k % 2, 100, 40, 16 + (k % 40 == 0), 512) for k in range(900)]
    newest = max(p[0] for p in packets) // 1000

    def run(delay_us, clocks):
        processor, handle, out = S.FlowProcessor(FlowParams(idle_s=3600, absolute_s=7200), delay_us), _Handle(), []
        processor.init(handle)
        list(processor.handleInputRows(key, iter([pd.DataFrame(packets, columns=list(S._PACKET))]), _Clock(0)))
        stored = len(processor.waiting.rows)
        for clock in clocks:
            while any(t <= clock for t in handle.timers):
                handle.timers.discard(min(handle.timers))
                out += processor.handleExpiredTimer(key, _Clock(clock), None)
        assert not handle.timers and not processor.waiting.rows and not processor.waiting.chunks
        frames = [f.astype(object).where(f.notna(), None) for f in out]
        return stored, sorted(tuple(r) for f in frames for r in f.itertuples(index=False))

    end = newest + 100_000_000
    plain, flows = run(None, [newest - 60_000, end])
    assert plain > 500 and len(flows) == len(packets)
    few, same = run(60_000_000, [newest - 60_000, end])
    assert few <= 3 and same == flows
    # A watermark that stays behind what its delay promised.
    slow, same = run(60_000_000, [*range(start * 1000, newest, 50_000_000), end])
    assert slow == few and same == flows
