"""Capture files by byte ranges, and the decoder on fragments and tags."""

import datetime as dt
import random
import struct

import pytest
from pyspark.sql import functions as F

from netloom.sources import captures
from netloom.sources.captures import capture_stream, read_captures, write_captures
from netloom.sources.packets import decode_frames


def capture(records, order="<", magic=captures.MICROS, link=1, snap=65535):
    head = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, snap, link)
    return head + b"".join(struct.pack(order + "IIII", s, f, len(x), full) + x for s, f, full, x in records)


def random_records(seed, n=400):
    r = random.Random(seed)
    out = []
    for k in range(n):
        kind = r.random()
        if kind < 0.2:
            data = bytes(r.choice([0, 40, 1500]))
        elif kind < 0.4:  # a frame that holds records itself
            data = capture([(k, 5, 30, bytes(30))] * r.randrange(1, 20))[24:]
        elif kind < 0.5:
            data = struct.pack("<IIII", 7, 7, r.choice([0, 16, 3000, 60000]), 70000) * 3
        else:
            data = r.randbytes(r.randrange(0, 900))
        out.append((1_700_000_000 + k, r.randrange(10**6), len(data) + r.choice([1, 0, 500]) + (not data), data))
    return out


@pytest.fixture(autouse=True)
def short_reach(monkeypatch):
    """Ranges of a few kilobytes are to resynchronise within small files."""
    monkeypatch.setattr(captures, "LONGEST", 4096)


def spans(path, parts):
    size = path.stat().st_size
    return max(1, -(-size // parts))


@pytest.mark.parametrize("order,magic", [("<", captures.MICROS), (">", captures.MICROS), ("<", captures.NANOS)])
@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_hold_every_record_once(tmp_path, order, magic, seed):
    records = random_records(seed)
    path = tmp_path / "one.pcap"
    path.write_bytes(capture(records, order, magic, snap=1500))
    want, at = [], 24
    for s, f, full, x in records:
        want.append((at, s * 10**6 + (f if magic == captures.MICROS else f // 1000), full, x))
        at += 16 + len(x)
    for parts in (1, 3, 50, 997):
        got = []
        for part in captures.plan_ranges(captures.list_files(str(path)), spans(path, parts)):
            for batch in captures.read_range(part):
                stamps = batch.column("ts").cast("int64").to_pylist()
                got += zip(batch.column("packet_id").to_pylist(), stamps, batch.column("length").to_pylist(), batch.column("frame").to_pylist(), strict=True)
        assert got == want, parts


def test_frames_that_pose_as_records_for_long(tmp_path):
    """Chains inside one frame that are longer than the first look back."""
    inner = capture([(1, 1, 60, bytes(60))] * 50)[24:]
    records = [(9, 9, len(inner), inner)] * 30
    path = tmp_path / "posing.pcap"
    path.write_bytes(capture(records))
    got = [r for part in captures.plan_ranges(captures.list_files(str(path)), 3000) for b in captures.read_range(part) for r in b.column("packet_id").to_pylist()]
    assert got == [24 + k * (16 + len(inner)) for k in range(30)]


def test_cut_and_foreign_files(tmp_path):
    path = tmp_path / "cut.pcap"
    whole = capture([(1, 1, 100, bytes(100)), (2, 2, 100, bytes(100))])
    path.write_bytes(whole[:-1])
    rows = [r for p in captures.plan_ranges(captures.list_files(str(path)), 50) for b in captures.read_range(p) for r in b.to_pylist()]
    assert [r["packet_id"] for r in rows] == [24]
    (tmp_path / "text.pcap").write_bytes(b"no capture at all, only text")
    with pytest.raises(ValueError):
        [b for p in captures.plan_ranges(captures.list_files(str(tmp_path / "text.pcap")), 50) for b in captures.read_range(p)]
    assert list(captures.read_range(None)) == []
    with pytest.raises(FileNotFoundError):
        captures.list_files(str(tmp_path / "none"))


def test_source_reads_partitions_and_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.pcap").write_bytes(capture(random_records(10 + k, 150)))
    (folder / "_hidden").write_bytes(b"x")
    whole = read_captures(spark, str(folder))
    want = sorted(map(tuple, whole.collect()))
    assert len(want) == 450 and len({r[0] for r in want}) == 450
    small = read_captures(spark, str(folder), 4000)
    assert small.rdd.getNumPartitions() > 30
    assert sorted(map(tuple, small.collect())) == want
    assert whole.schema.simpleString() == "struct<packet_id:bigint,ts:timestamp,length:int,link:int,frame:binary>"

    def run():
        q = capture_stream(spark, str(folder), 20_000).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds")
        q = q.start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    assert run() == want
    (folder / "late.pcap").write_bytes(capture(random_records(20, 50)))
    assert len(run()) == 500
    assert sorted(map(tuple, read_captures(spark, str(folder)).collect())) == run()


def test_written_captures_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).select(
        F.timestamp_micros(F.col("id") * 1_234_567 + 1_700_000_000_000_000).alias("ts"),
        F.expr("unhex(repeat('ab', cast(id as int)))").alias("frame"), F.lit(1).alias("extra"),
    ).repartition(3)
    write_captures(df, path)
    back = read_captures(spark, path)
    assert sorted(map(tuple, back.select("ts", "frame").collect())) == sorted(map(tuple, df.select("ts", "frame").collect()))
    write_captures(df.limit(5), path, "overwrite")
    assert read_captures(spark, path).count() == 5


def frame(proto=17, offset=0, tags=b"", body=bytes(range(40))):
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 60, 1, offset, 64, proto, 0) + bytes([10, 0, 0, 1, 10, 0, 0, 2])
    return bytes(12) + tags + b"\x08\x00" + ip + body


def test_decoder_drops_later_fragments_and_skips_tags(spark):
    ports = struct.pack(">HH", 5353, 53) + bytes(36)
    frames = [
        frame(body=ports),
        frame(offset=0x2000, body=ports),  # first fragment: more follow
        frame(offset=0x0005, body=ports),  # later fragment
        frame(tags=b"\x81\x00\x00\x07", body=ports),
        frame(tags=b"\x88\xa8\x00\x01\x81\x00\x00\x07", body=ports),
        frame(tags=b"\x86\xdd\x00\x07", body=ports),
        frame(proto=6, body=ports[:10]),  # cut off
    ]
    rows = [(k, dt.datetime(2024, 1, 1), f) for k, f in enumerate(frames)]
    got = decode_frames(spark.createDataFrame(rows, "packet_id long, ts timestamp, frame binary")).collect()
    assert sorted((r.packet_id, r.src_ip, r.dst_ip, r.src_port, r.dst_port) for r in got) == [
        (k, "10.0.0.1", "10.0.0.2", 5353, 53) for k in (0, 1, 3, 4)
    ]
