import statistics
import struct

import numpy as np
import pytest

from flowlens.operators.adapter import PRIMARY_PROFILE
from flowlens.operators.flows import assemble_flows
from flowlens.schemas import FEATURE_COLUMNS, PACKET_SCHEMA
from flowlens.sources.flow_csv import flow_export
from flowlens.sources import pcap
from flowlens.sources.pcap import read_packets, split_records

BASE = 1700000000.0
A, B = ("10.0.0.10", 12345), ("10.0.0.20", 80)


def packet(ordinal, t, src, dst, flags=0x10, payload=0, proto=6, window="w", size=8192):
    return (window, ordinal, t, *src, *dst, proto, 54 + payload, payload, 40, flags, size)


def flows(spark, packets, **options):
    return assemble_flows(spark.createDataFrame(packets, PACKET_SCHEMA), **options)


@pytest.mark.parametrize("slice_seconds", [3600.0, 0.5, 0.1])
def test_worked_example(spark, slice_seconds):
    rows = [packet(0, BASE, A, B, 0x02), packet(1, BASE + 0.4, B, A, 0x12, 15), packet(2, BASE + 0.9, A, B, 0x18, 11)]
    row = flows(spark, rows, slice_seconds=slice_seconds).first()
    expected = {
        "Flow Duration": 900.0, "Total Fwd Packet": 2, "Total Bwd packets": 1, "Total Length of Fwd Packet": 11,
        "Total Length of Bwd Packet": 15, "Flow IAT Mean": 0.45, "Flow IAT Max": 0.5, "Flow Packets/s": 3.333333,
        "Flow Bytes/s": 208.888867, "SYN Flag Count": 2, "ACK Flag Count": 2, "PSH Flag Count": 1, "Fwd PSH Flags": 1,
        "Down/Up Ratio": 0.5, "Active Max": 0.9, "Idle Max": 0.0, "Packet Length Max": 69.0, "FWD Init Win Bytes": 8192.0,
    }
    assert {k: row[k] for k in expected} == expected
    assert row["Packet Length Std"] == pytest.approx(6.342099, abs=1e-6)
    assert row.source_flow_id == "10.0.0.10:12345-10.0.0.20:80-00000" and row.flow_family == "bidirectional"
    assert row.source_timestamp == "2023-11-14T22:13:20+00:00"


def test_direction_follows_file_order(spark):
    rows = [packet(0, BASE + 1, B, A), packet(1, BASE, A, B)]
    row = flows(spark, rows).first()
    assert (row["Src Port"], row["Dst Port"]) == (80, 12345) and row["Total Bwd packets"] == 1


def test_equal_times_give_zero_rates(spark):
    row = flows(spark, [packet(0, BASE, A, B), packet(1, BASE, A, B)]).first()
    assert row["Flow Bytes/s"] == row["Flow Packets/s"] == row["Bwd Bulk Rate Avg"] == 0.0
    assert row.flow_family == "unidirectional" and row["Bwd Packet Length Max"] == 0.0


def test_flow_index_order_and_windows(spark):
    c = ("10.0.0.30", 9)
    rows = [packet(5, BASE, c, B), packet(6, BASE, A, B), packet(7, BASE, B, c), packet(0, BASE, A, B, window="v"), packet(8, BASE, A, B, proto=17)]
    got = sorted((r.window_path, r.flow_index, r.src_ip, r.transport_family) for r in flows(spark, rows, index_bucket=1).collect())
    assert got == [("v", 0, A[0], "tcp"), ("w", 0, c[0], "tcp"), ("w", 1, A[0], "tcp"), ("w", 2, A[0], "udp")]


def brute_force(packets, gap):
    """Independent statistics of one flow for the order-dependent features."""
    times = sorted(p[2] for p in packets)
    head = min(packets, key=lambda p: p[1])[3:5]
    forward = sorted(p[2] for p in packets if p[3:5] == head)
    steps = [y - x for x, y in zip(times, times[1:])]
    forward_steps = [y - x for x, y in zip(forward, forward[1:])]
    sessions = [[times[0]]]
    for t in times[1:]:
        if t - sessions[-1][-1] > gap:
            sessions.append([])
        sessions[-1].append(t)
    active = [s[-1] - s[0] for s in sessions]
    idle = [x for x in steps if x > gap]
    sizes = [p[8] for p in packets]
    spread = lambda v: statistics.pstdev(v) if len(v) > 1 else 0.0
    mean = lambda v: statistics.fmean(v) if v else 0.0
    return {
        "Flow IAT Mean": mean(steps), "Flow IAT Std": spread(steps), "Fwd IAT Total": sum(forward_steps), "Fwd IAT Std": spread(forward_steps),
        "Active Mean": mean(active), "Active Std": spread(active), "Active Min": min(active), "Idle Mean": mean(idle), "Idle Std": spread(idle),
        "Idle Max": max(idle, default=0.0), "Packet Length Std": spread(sizes), "Packet Length Mean": mean(sizes),
    }


@pytest.mark.parametrize("slice_seconds", [1e6, 7.0, 0.7])
def test_hot_flow_over_many_slices(spark, slice_seconds):
    """One flow holds most packets; every slicing gives the brute-force result."""
    rng = np.random.default_rng(5)
    packets, t = [], BASE
    for i in range(600):
        t += float(rng.choice([0.01, 0.3, 0.99, 1.0, 1.7, 12.0], p=[0.3, 0.3, 0.1, 0.1, 0.15, 0.05]))
        src, dst = (A, B) if rng.random() < 0.6 else (B, A)
        if i % 10 == 0:
            src, dst = ("10.9.9.9", 7), B
        packets.append(packet(i, t, src, dst, payload=int(rng.integers(0, 500))))
    for row in flows(spark, packets, slice_seconds=slice_seconds).collect():
        own = [p for p in packets if {p[3], p[5]} == {row.src_ip, row.dst_ip}]
        for name, value in brute_force(own, 1.0).items():
            assert row[name] == pytest.approx(value, abs=2e-6), name


def frame(src, dst, proto=6, payload=b"", vlan=False, ethertype=0x0800):
    ports = struct.pack("!HH", src[1], dst[1])
    if proto == 6:
        l4 = ports + struct.pack("!IIBBHHH", 0, 0, 5 << 4, 0x12, 512, 0, 0) + payload
    else:
        l4 = ports + struct.pack("!HH", 8 + len(payload), 0) + payload
    ip = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(l4), 0, 0, 64, proto, 0) + bytes(map(int, src[0].split("."))) + bytes(map(int, dst[0].split(".")))
    tag = struct.pack("!HH", 0x8100, 1) if vlan else b""
    return b"\0" * 12 + tag + struct.pack("!H", ethertype) + ip + l4


def capture(frames, order="<", nano=False, link=1):
    magic = {("<", False): b"\xd4\xc3\xb2\xa1", (">", False): b"\xa1\xb2\xc3\xd4", ("<", True): b"\x4d\x3c\xb2\xa1", (">", True): b"\xa1\xb2\x3c\x4d"}[order, nano]
    out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, link)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1700000000 + i, 500_000_000 if nano else 500_000, len(f), len(f)) + f
    return out


@pytest.mark.parametrize("order,nano", [("<", False), (">", False), ("<", True), (">", True)])
def test_capture_files(spark, tmp_path, order, nano):
    frames = [
        frame(A, B, payload=b"abc"), frame(B, A, 17, b"xy", vlan=True), frame(A, B, ethertype=0x86DD), frame(A, B, proto=1),
        b"short", frame(A, B)[:40],
    ]
    (tmp_path / "one.pcap").write_bytes(capture(frames, order, nano))
    (tmp_path / "two.pcap").write_bytes(capture(frames[:1], order, nano))
    rows = read_packets(spark, str(tmp_path)).orderBy("window_path", "packet_ordinal").collect()
    assert [(r.packet_ordinal, r.protocol, r.payload_length, r.header_length) for r in rows] == [(0, 6, 3, 40), (1, 17, 2, 28), (0, 6, 3, 40)]
    assert rows[0].ts == BASE + 0.5 and rows[1].ts == BASE + 1.5
    assert (rows[0].src_ip, rows[0].src_port, rows[0].flags, rows[0].window_size) == (*A, 0x12, 512)


@pytest.mark.parametrize("content", [
    b"", b"\0" * 24, capture([], link=101), capture([frame(A, B)])[:-1], capture([frame(A, B)])[:30],
])
def test_broken_captures(content):
    with pytest.raises(ValueError):
        list(split_records(content))


def test_flow_export(spark):
    rows = [packet(0, BASE, A, B, 0x02), packet(1, BASE + 0.4, B, A, 0x12, 15), packet(2, BASE + 0.9, A, B, 0x18, 11)]
    export = flow_export(flows(spark, rows), PRIMARY_PROFILE)
    assert export.columns == list(PRIMARY_PROFILE.accepted_keys())
    row = export.first()
    assert (row["FlowDuration"], row["Flow Packets/s"], row["Flow IAT Mean"], row["Protocol"]) == ("900", "3.333333", "0.45", "6")
    assert len(FEATURE_COLUMNS) == 72


@pytest.mark.parametrize("tied", [False, True])
def test_hot_flow_in_a_short_window(spark, tied):
    """A flow whose packets all fall into 2.5 seconds is cut into many slices, with the features of one scan."""
    from flowlens.operators.flows import with_flow_key, with_slice

    rng = np.random.default_rng(6)
    times = np.sort(BASE + rng.uniform(0, 2.5, 6000).round(4)) if not tied else BASE + np.repeat([0.0, 0.7, 2.5], 2000)
    order = np.argsort(np.arange(6000) + rng.integers(0, 40, 6000))  # nearly in order, as captures are
    rows = [packet(int(o), float(times[i]), *((A, B) if rng.random() < 0.6 else (B, A)), payload=int(rng.integers(0, 900)))
            for o, i in enumerate(order)]
    rows += [packet(k, BASE + k, A, B, window="small") for k in range(5)]
    packets = spark.createDataFrame(rows, PACKET_SCHEMA).repartition(7)
    sizes = {}
    for r in with_slice(with_flow_key(packets), 3600.0, 250).groupBy("window_path", "slice").count().collect():
        sizes.setdefault(r["window_path"], []).append(r["count"])
    assert len(sizes["small"]) == 1 and len(sizes["w"]) >= 20 and max(sizes["w"]) <= 400
    whole = {r["window_path"]: r for r in assemble_flows(packets, gap_seconds=0.002).collect()}
    for r in assemble_flows(packets, gap_seconds=0.002, slice_packets=250).collect():
        for name in FEATURE_COLUMNS:
            assert r[name] == pytest.approx(whole[r["window_path"]][name], rel=1e-9, abs=2e-6), name


def _ranged(path, size, range_bytes):
    """Frames of a file through guessed and chained ranges, without Spark."""
    found, at, ordinal = [], pcap.FILE_HEADER, 0
    for low in range(0, size, range_bytes):
        capture, high = pcap.Capture(path), low + range_bytes
        if low:
            start = capture.resynchronised(low, high)
            if start is not None and at < high and not nested:
                assert start == at
        else:
            nested = b"inner" in open(path, "rb").read()
        if at < high:
            end, n = capture.span(at, high)
            found += list(capture.records(at, high, ordinal))
            at, ordinal = end, ordinal + n
    return found


@pytest.mark.parametrize("range_bytes", [1, 7, 61, 100, 333, 5000])
def test_capture_ranges_of_any_size(spark, tmp_path, range_bytes):
    rng = np.random.default_rng(2)
    frames = [rng.bytes(int(rng.integers(0, 90))) for _ in range(40)]
    # A payload that is itself a capture, with a tail that only looks like records.
    frames.insert(9, b"inner" + capture([b"x" * 20] * 20))
    content = capture(frames)
    path = tmp_path / "one.pcap"
    path.write_bytes(content)
    assert _ranged(str(path), len(content), range_bytes) == list(split_records(content))
    if range_bytes in (61, 333):
        (tmp_path / "two.pcap").write_bytes(capture(frames[:3], ">", True))
        (tmp_path / "none.pcap").write_bytes(capture([]))
        rows = pcap.read_frames(spark, str(tmp_path), range_bytes=range_bytes).collect()
        by_file = {}
        for r in rows:
            by_file.setdefault(r.window_path.rsplit("/", 1)[1], []).append((r.packet_ordinal, r.ts, bytes(r.frame)))
        assert sorted(by_file["one.pcap"]) == list(split_records(content))
        assert sorted(by_file["two.pcap"]) == list(split_records(capture(frames[:3], ">", True))) and "none.pcap" not in by_file


@pytest.mark.parametrize("content", [b"\0" * 30, capture([frame(A, B)])[:-1], capture([frame(A, B)] * 9)[:-60]])
def test_broken_capture_files_fail(spark, tmp_path, content):
    (tmp_path / "bad.pcap").write_bytes(content)
    with pytest.raises(Exception, match="pcap"):
        pcap.read_frames(spark, str(tmp_path), range_bytes=64).count()


def test_tasks_follow_the_number_of_packets(spark, monkeypatch):
    """Rows of slices and flows are spread by packets, whatever the session's shuffle partitions, and give the same flows."""
    from flowlens.operators import flows as module

    rows = [packet(i, BASE + i * 0.7, ("10.0.1.1", 1000 + i % 40), B, payload=i % 9) for i in range(600)]
    one_task = [tuple(r) for r in flows(spark, rows).orderBy("flow_index").collect()]
    asked = []
    write = module.stored
    monkeypatch.setattr(module, "stored", lambda df, purpose: asked.append((purpose, df.rdd.getNumPartitions())) or write(df, purpose))
    monkeypatch.setattr(module, "TASK_PACKETS", 30)
    many = flows(spark, rows)
    assert dict(asked)["flows"] == 21
    assert [tuple(r) for r in many.orderBy("flow_index").collect()] == one_task
