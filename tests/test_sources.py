"""Readers and sinks on real files."""

import datetime as dt
import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packetloom.operators.packets import flag
from packetloom.sources import capture as cp
from packetloom.sources import capture_ranges as cr
from packetloom.sources import flow_csv as fc
from packetloom.sources import sinks as sk
from packetloom.sources import zeek as zk


def frame(proto=6, payload=b"hello", flags=0x12, kind=0x0800):
    l4 = (struct.pack(">HHIIBBHHH", 1234, 80, 77, 0, 0x50, flags, 512, 0, 0) if proto == 6 else struct.pack(">HHHH", 53, 5353, 8 + len(payload), 0))
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(l4) + len(payload), 0, 0, 64, proto, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    return b"\0" * 12 + struct.pack(">H", kind) + ip + l4 + payload


def capture(frames, order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    data = struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, 1)
    for seconds, fraction, body in frames:
        data += struct.pack(order + "IIII", seconds, fraction, len(body), len(body)) + body
    return data


@pytest.mark.parametrize("order,nano,fraction", [("<", False, 500_000), (">", False, 500_000), ("<", True, 500_000_000), (">", True, 500_000_000)])
def test_classic_captures(spark, tmp_path, order, nano, fraction):
    (tmp_path / "one.pcap").write_bytes(capture([(100, fraction, frame()), (101, 0, frame(17, b"xy")), (102, 0, frame(kind=0x86DD)),
                                                 (103, 0, frame(kind=0x0806)), (104, 0, frame()[:20])], order, nano))
    decoded = cp.decode_frames(cp.read_capture_frames(spark, str(tmp_path)))
    assert {r["parse_status"]: r["frames"] for r in cp.status_counts(decoded).collect()} == {
        "ok": 2, "ipv6_not_implemented": 1, "non_ip": 1, "parse_error": 1}
    tcp, udp = decoded.filter("parse_status = 'ok'").orderBy("frame_no").collect()
    assert tcp["timestamp"] == dt.datetime(1970, 1, 1, 0, 1, 40, 500_000)
    assert (tcp["src_ip"], tcp["dst_port"], tcp["tcp_flags"], tcp["tcp_seq"], tcp["payload_length"]) == ("10.0.0.1", 80, "SA", 77, 5)
    assert (udp["protocol"], udp["payload_length"], udp["tcp_flags"]) == ("UDP", 2, None)
    assert cp.read_captures(spark, str(tmp_path)).count() == 2
    assert cp.read_captures(spark, str(tmp_path), include_non_ip=True).count() == 5
    assert cp.read_captures(spark, str(tmp_path), limit=1).first()["protocol"] == "TCP"


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"any other text")
    with pytest.raises(Exception, match="no capture file"):
        cp.read_capture_frames(spark, str(tmp_path)).count()


def test_cut_records_are_parse_errors(spark, tmp_path):
    whole = capture([(100, 0, frame()), (101, 0, frame())])
    (tmp_path / "body.pcap").write_bytes(whole[:-5])
    (tmp_path / "head.pcap").write_bytes(whole + b"\0" * 7)
    (tmp_path / "bare.pcap").write_bytes(whole[:9])
    frames = cp.decode_frames(cp.read_capture_frames(spark, str(tmp_path)))
    found = {(r["path"].rsplit("/", 1)[1], r["parse_status"]): r["n"] for r in
             frames.groupBy("path", "parse_status").agg(F.count("*").alias("n")).collect()}
    assert found == {("body.pcap", "ok"): 1, ("body.pcap", "parse_error"): 1, ("head.pcap", "ok"): 2,
                     ("head.pcap", "parse_error"): 1, ("bare.pcap", "parse_error"): 1}


def block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    size = struct.pack(order + "I", len(body) + 12)
    return struct.pack(order + "I", kind) + size + body + size


@pytest.mark.parametrize("order", ["<", ">"])
def test_block_captures_and_link_types(spark, tmp_path, order):
    whole = frame()
    ip = whole[14:]
    nanos = struct.pack(order + "HHB3xHH", 9, 1, 9, 0, 0)  # time option: 10^-9
    links = [(1, nanos), (101, b""), (113, b""), (276, b""), (0, b""), (999, b"")]
    data = block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    data += b"".join(block(order, 1, struct.pack(order + "HHI", link, 0, 0) + options) for link, options in links)
    two_tags = whole[:12] + struct.pack(">HHHH", 0x88A8, 5, 0x8100, 6) + whole[12:]
    bodies = [(0, whole), (0, two_tags), (1, ip), (2, b"\0" * 14 + b"\x08\0" + ip), (3, b"\x08\0" + b"\0" * 18 + ip),
              (4, b"\2\0\0\0" + ip), (5, whole)]
    for port, body in bodies:
        ticks = 7_500_000_000 if port == 0 else 7_500_000
        data += block(order, 6, struct.pack(order + "IIIII", port, ticks >> 32, ticks & 0xFFFFFFFF, len(body), len(body)) + body)
    data += block(order, 3, struct.pack(order + "I", len(whole)) + whole) + block(order, 5, b"\0" * 12)
    data += block(order, 6, struct.pack(order + "IIIII", 77, 0, 0, 0, 0))
    (tmp_path / "x.pcapng").write_bytes(data + b"\6\0\0")
    rows = cp.decode_frames(cp.read_capture_frames(spark, str(tmp_path))).orderBy("frame_no").collect()
    assert [r["parse_status"] for r in rows] == ["ok"] * 6 + ["non_ip", "ok", "parse_error", "parse_error"]
    assert {(r["src_ip"], r["dst_port"], r["payload_length"]) for r in rows if r["parse_status"] == "ok"} == {("10.0.0.1", 80, 5)}
    assert {r["timestamp"] for r in rows[:7]} == {dt.datetime(1970, 1, 1, 0, 0, 7, 500_000)}
    assert rows[7]["timestamp"] is None


def test_flag_bits(spark):
    row = spark.range(1).select(*[flag(F.lit(18).cast("long"), f).alias(f) for f in ("fin", "syn", "rst", "ack")]).first()
    assert row.asDict() == {"fin": False, "syn": True, "rst": False, "ack": True}


def test_events_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Timestamp,Source_IP,Destination IP,Protocol,Tot Fwd Pkts,Tot Bwd Pkts,Flow Duration,Extra\n"
                                    "2024-01-01 00:00:01,a,b,TCP,2,x,1.5,keep\nbad,a,b,UDP,1,1\n")
    rows = fc.read_events_csv(spark, str(tmp_path / "e.csv")).collect()
    assert rows[0]["timestamp"] == dt.datetime(2024, 1, 1, 0, 0, 1) and rows[1]["timestamp"] is None
    assert [r["packet_count"] for r in rows] == [2.0, 2.0] and rows[0]["duration"] == 1.5 and rows[0]["flow_duration"] == "1.5"
    assert rows[0]["Extra"] == "keep" and rows[0]["src_ip"] == "a" and rows[0]["byte_count"] is None
    with pytest.raises(ValueError, match="the file lacks"):
        fc.read_events_csv(spark, str(tmp_path / "e.csv"), {"src_ip": "nope"}).count()


ZEEK = "#separator \\x09\n#fields\tts\tid.orig_h\tid.resp_h\tproto\torig_pkts\tresp_pkts\n1.5\ta\tb\ttcp\t1\t2\n2.5\ta\tb\tudp\t1\t-\n"


def test_zeek(spark, tmp_path):
    (tmp_path / "conn.log").write_text(ZEEK)
    rows = zk.read_zeek(spark, str(tmp_path / "conn.log")).orderBy("timestamp").collect()
    assert rows[0]["timestamp"] == dt.datetime(1970, 1, 1, 0, 0, 1, 500_000)
    assert [r["packet_count"] for r in rows] == [3, None] and rows[0]["src_port"] is None and rows[0]["source_type"] == "zeek"
    (tmp_path / "conn.json").write_text('\n{"ts": 1.5, "id.orig_h": "a", "orig_bytes": 4, "resp_bytes": 5}\n')
    row = zk.read_zeek(spark, str(tmp_path / "conn.json")).first()
    assert (row["src_ip"], row["byte_count"], row["protocol"]) == ("a", 9, None)
    (tmp_path / "odd.log").write_text("plain text\n")
    with pytest.raises(ValueError, match="cannot tell"):
        zk.read_zeek(spark, str(tmp_path / "odd.log"))
    (tmp_path / "nohead.log").write_text("#path\tconn\n1.0\ta\n")
    with pytest.raises(ValueError, match="#fields"):
        zk.read_zeek(spark, str(tmp_path / "nohead.log"))
    with pytest.raises(ValueError, match="auto, json or tsv"):
        zk.read_zeek(spark, str(tmp_path / "conn.log"), "xml")


def test_zeek_folder(spark, tmp_path):
    """Each file of a folder has its own type and its own #fields line."""
    (tmp_path / "a.log").write_text(ZEEK)
    (tmp_path / "b.log").write_text("#fields\torig_pkts\tid.resp_h\tts\tid.orig_h\n7\td\t3.5\tc\n")
    (tmp_path / "c d.json").write_text('{"ts": 4.5, "id.orig_h": "e", "orig_pkts": 2, "resp_pkts": 2}\n{"ts": 5.5, "orig_pkts": 2}\n')
    rows = zk.read_zeek(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [(r["src_ip"], r["dst_ip"], r["packet_count"]) for r in rows] == [
        ("a", "b", 3), ("a", "b", None), ("c", "d", 7), ("e", None, 4), (None, None, None)]
    with pytest.raises(ValueError, match="cannot tell"):
        zk.detect_zeek_type(spark, str(tmp_path))
    (tmp_path / "b.log").write_text("#fields\tts\n1.0\n#fields\tproto\nudp\n")
    with pytest.raises(ValueError, match="lines differ"):
        zk.read_zeek(spark, str(tmp_path))


def test_raw_flow_lines(spark, tmp_path):
    (tmp_path / "day.csv").write_bytes("\ufeffPort,Timestamp,Label\r\n1,02/01/2018 08:00:00,Benign\r\nPort,Timestamp,Label\r\n2,xx,Bot\r\n"
                                       "3,05/01/1970 00:00:00,Bot\r\n4,02/01/2018 08:00:00\r\n".encode() + b"5,02/01/2018 09:00:00,B\xff\r\n")
    header = ["Port", "Timestamp", "Label"]
    lines = fc.number_rows(fc.read_raw_flow_lines(spark, str(tmp_path)))
    assert [r["row_number"] for r in lines.orderBy("position").collect()] == list(range(7))
    parsed = fc.parse_raw_flows(lines, header)
    reasons = {r["Port"]: r["reason"] for r in parsed.collect()}
    assert reasons == {"1": None, "Port": "repeated_header", "2": "invalid_timestamp", "3": "known_1970_timestamp", "4": "malformed_width", "5": None}
    good, bad = sk.split_rejects(parsed)
    assert good.count() == 2 and bad.count() == 4
    assert good.filter("Port = 5").first()["raw_label"] == "B\ufffd"


def test_raw_flow_files_of_other_widths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Port,Timestamp,Label\n1,02/01/2018 10:00:00,Benign\n")
    (tmp_path / "b.csv").write_text('Flow ID,Label,Timestamp,Port\n"x,""y""",Bot,02/01/2018 10:00:00,2\n,Bot,02/01/2018 10:00:00,3\n'
                                    '4,02/01/2018 10:00:00,Bot\n')
    (tmp_path / "c.csv").write_text("Timestamp,Label\n02/01/2018 10:00:00,Bot\n")
    (tmp_path / "d.csv").write_text('5,02/01/2018 10:00:00,"Web ""x"", y"\n')
    parsed = fc.parse_raw_flows(fc.read_raw_flow_lines(spark, str(tmp_path)), ["Port", "Timestamp", "Label"])
    rows = {(r["source_file"], r["Port"], r["raw_label"], r["reason"]) for r in parsed.collect()}
    assert rows == {("a.csv", "1", "Benign", None), ("b.csv", "2", "Bot", None), ("b.csv", "3", "Bot", None),
                    ("b.csv", None, "02/01/2018 10:00:00", "malformed_width"), ("c.csv", None, "Bot", None),
                    ("d.csv", "5", 'Web "x", y', None)}
    quoted = spark.createDataFrame([('a,"b,c",,"d""e"',), (',x"y,"open',)], "v string").select(fc.split_fields(F.col("v")).alias("f"))
    assert [r["f"] for r in quoted.collect()] == [["a", "b,c", "", 'd"e'], ["", 'x"y', '"open']]


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    table = spark.range(3).withColumn("list", F.array(F.lit(1)))
    for fmt in ("parquet", "json", "csv"):
        sk.write_graph_dataset({"nodes": table}, str(tmp_path / fmt), fmt)
        with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
            sk.write_graph_dataset({"nodes": table}, str(tmp_path / fmt), fmt)
    snapshot = spark.createDataFrame([(0, "edge", "{}")], "window_index long, kind string, payload string")
    sk.write_snapshot(snapshot, str(tmp_path / "snapshot"))
    assert spark.read.json(str(tmp_path / "snapshot")).count() == 1


def test_state_schema_is_checked(spark, tmp_path):
    states = spark.createDataFrame([("a", 1.0, ["x", "y"])], "source_file string, f double, current_attack_types array<string>")
    fc.write_states(states, str(tmp_path / "s"))
    assert fc.read_states(spark, str(tmp_path / "s"), features=1, sources=1).count() == 1
    with pytest.raises(ValueError, match="features"):
        fc.read_states(spark, str(tmp_path / "s"), features=157)
    with pytest.raises(ValueError, match="partitions"):
        fc.read_states(spark, str(tmp_path / "s"), sources=10)
    fc.export_states_csv(states, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["current_attack_types"] == "x;y"


def same_frames(spark, folder, split):
    columns = ["frame_no", "epoch_micros", "wire_length", "link_type", "frame", "cut"]
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    want = sorted(cp.read_capture_frames(spark, folder).select(name, *columns).collect(), key=str)
    got = sorted(cr.read_capture_ranges(spark, folder, split).select(name, *columns).collect(), key=str)
    assert got == want
    return got


def test_ranges_of_captures_equal_whole_files(spark, tmp_path):
    rng = random.Random(3)
    fake = b"".join(struct.pack("<IIII", 9, 9, 20, 20) + b"\1" * 20 for _ in range(12))  # a payload that looks like records
    rows = [(100 + k, k, frame(payload=fake if k % 9 == 4 else bytes(rng.randrange(256) for _ in range(rng.randrange(60))))) for k in range(60)]
    (tmp_path / "little.pcap").write_bytes(capture(rows))
    (tmp_path / "big.pcap").write_bytes(capture([(s, n, f if len(f) < 200 else frame()) for s, n, f in rows], ">", True) + b"\0\0\0tail")
    (tmp_path / "short.pcap").write_bytes(capture([])[:10])
    (tmp_path / "none.pcap").write_bytes(capture([]))
    (tmp_path / "cut.pcap").write_bytes(capture(rows[:9])[:-3])
    for split in (100, 777):
        found = same_frames(spark, str(tmp_path), split)
        assert Counter(r["name"] for r in found) == {"little.pcap": 60, "big.pcap": 61, "short.pcap": 1, "cut.pcap": 9}
    index = cr.capture_index(spark, str(tmp_path / "little.pcap"), 777).collect()
    assert len(index) > 5 and sum(r["frames"] for r in index) == 60


@pytest.mark.parametrize("order", ["<", ">"])
def test_ranges_of_block_captures_know_their_interfaces(spark, tmp_path, order):
    section = block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    packet = lambda port, k: block(order, 6, struct.pack(order + "IIIII", port, 0, k, len(frame()), len(frame())) + frame())
    face = lambda link: block(order, 1, struct.pack(order + "HHI", link, 0, 0))
    data = section + face(1) + b"".join(packet(0, k) for k in range(20)) + face(101) + b"".join(packet(k % 2, k) for k in range(20))
    data += section + face(113) + b"".join(packet(0, k) for k in range(20)) + block(order, 5, b"\0" * 12) + packet(3, 0)
    (tmp_path / "a.pcapng").write_bytes(data)
    (tmp_path / "b.pcapng").write_bytes(data + b"\6\0\0")
    other = "<" if order == ">" else ">"  # a section of the other byte order
    turned = block(other, 0x0A0D0D0A, struct.pack(other + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(other, 1, struct.pack(other + "HHI", 12, 0, 0))
    turned += b"".join(block(other, 6, struct.pack(other + "IIIII", 0, 0, k, 59, 59) + frame()) for k in range(20))
    (tmp_path / "c.pcapng").write_bytes(data + turned)
    found = same_frames(spark, str(tmp_path), 300)
    assert Counter(r["link_type"] for r in found if r["name"] == "a.pcapng") == {1: 31, 101: 10, 113: 20}


def test_ranges_refuse_other_files(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"text, not packets")
    with pytest.raises(Exception, match="no capture file"):
        cr.read_capture_ranges(spark, str(tmp_path)).count()


def test_small_ranges_share_tasks(spark, tmp_path):
    frames = spark.range(4000).select(F.col("id").alias("frame_no"), (F.col("id") * 1000).alias("epoch_micros"), F.lit(64).cast("long").alias("wire_length"),
                                      F.unhex(F.sha2(F.col("id").cast("string"), 512)).alias("frame"))
    folder = f"{tmp_path}/captures"
    cr.write_captures(frames, folder, 1)
    read = cr.read_capture_ranges(spark, folder, 16 << 10)
    assert read.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < (4000 * 80 + 24) // (16 << 10)
    got = read.orderBy("frame_no").collect()
    assert [r["epoch_micros"] for r in got] == [k * 1000 for k in range(4000)] and not any(r["cut"] for r in got)


def test_a_wrong_find_costs_one_range():
    import pandas as pd

    walks = pd.DataFrame([("f", k, 100 * k + 100, 100 * k + 7 if k else 24, 100 * k + 107, False, False, 0) for k in range(6)],
                         columns=["path", "part", "end", "start", "stop", "big", "big_after", "round"])
    told = lambda rows: [tuple(r)[1:] for r in cr._chained(rows).itertuples(index=False)]
    right = [(k, 100 * k + 7 if k else 24, False, False) for k in range(6)]
    assert told(walks) == right
    walks.loc[2, ["start", "stop"]] = 255, 600  # a find within a payload, whose length goes to the file's end
    assert told(walks) == [*right[:2], (2, 207, False, True), *right[3:]]
    again = pd.DataFrame([("f", 2, 300, 207, 307, False, False, 1)], columns=walks.columns)
    assert told(pd.concat([walks, again])) == right
    walks.loc[3, ["start", "stop"]] = -2, 0  # nothing found where the next record goes on
    assert told(pd.concat([walks, again])) == [*right[:3], (3, 307, False, True), *right[4:]]


def test_a_walk_goes_on_to_the_next_ranges(tmp_path):
    import pandas as pd

    (tmp_path / "a.pcap").write_bytes(capture([(k, k, b"\1" * 84) for k in range(20)]))
    row = {"path": f"file:{tmp_path}/a.pcap", "length": 2024, "part": 1, "begin": 300, "end": 600, "start": 324, "stop": 0, "frames": 0, "context": None,
           "section": False, "big": None, "big_after": None}
    rows = next(cr._walked(iter([pd.DataFrame([row])]), 300, 3))
    assert rows[["part", "start", "stop", "frames"]].values.tolist() == [[1, 324, 624, 3], [2, 624, 924, 3], [3, 924, 1224, 3]]
