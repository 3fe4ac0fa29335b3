"""Packet captures: split capture files into frames, decode frames with column expressions."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File signatures.
CLASSIC_MAGICS = {
    "A1B2C3D4": ("big", "micro"), "D4C3B2A1": ("little", "micro"),
    "A1B23C4D": ("big", "nano"), "4D3CB2A1": ("little", "nano"),
}
PCAPNG_MAGIC = "0A0D0D0A"
ETHERTYPE_IPV4, ETHERTYPE_IPV6 = 0x0800, 0x86DD
VLAN_TAGS = (0x8100, 0x88A8, 0x9100)
# Link types; bare IP has no header, the loopback one has four bytes.
ETHERNET, LOOPBACK, COOKED, COOKED_2 = 1, 0, 113, 276
BARE_IP = (12, 14, 101, 228, 229)
# IP protocol numbers and TCP flag letters, lowest bit first.
IP_PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP"}
FLAG_LETTERS = "FSRPAUEC"
FRAME_SCHEMA = "path string, frame_no long, epoch_micros long, wire_length long, link_type int, frame binary, cut boolean"
FRAMES_PER_BATCH = 4096


def sniff_format(content: Column) -> Column:
    """S6. Capture format by its first four bytes."""
    magic = F.hex(F.substring(content, 1, 4))
    chain = F.when(magic == PCAPNG_MAGIC, "pcapng")
    for value, (order, unit) in CLASSIC_MAGICS.items():
        chain = chain.when(magic == value, f"pcap-{order}-{unit}")
    return chain.otherwise("unknown")


Record = tuple[int | None, int | None, int, bytes, bool]  # micros, length on the wire, link type, bytes, cut off


def _classic_records(data: bytes) -> Iterator[Record]:
    order, unit = CLASSIC_MAGICS[data[:4].hex().upper()]
    end = ">" if order == "big" else "<"
    if len(data) < 24:
        yield None, None, ETHERNET, b"", True
        return
    link = struct.unpack_from(end + "I", data, 20)[0] & 0xFFFF
    head, at = struct.Struct(end + "IIII"), 24
    while at < len(data):
        if at + 16 > len(data):
            yield None, None, link, b"", True
            return
        seconds, fraction, kept, wire = head.unpack_from(data, at)
        micros = seconds * 1_000_000 + (fraction // 1000 if unit == "nano" else fraction)
        yield micros, wire, link, data[at + 16:at + 16 + kept], at + 16 + kept > len(data)
        at += 16 + kept


def _ticks_per_second(options: bytes, end: str) -> tuple[int, int]:
    """Time resolution and offset in seconds, from the options of an interface block."""
    per_second, shift, at = 1_000_000, 0, 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(end + "HH", options, at)
        value = options[at + 4:at + 4 + size]
        if code == 0:
            break
        if code == 9 and len(value) == 1:
            per_second = 2 ** (value[0] & 127) if value[0] & 128 else 10 ** value[0]
        if code == 14 and len(value) == 8:
            shift = struct.unpack(end + "q", value)[0]
        at += 4 + (size + 3) // 4 * 4
    return per_second, shift


def _block_records(data: bytes) -> Iterator[Record]:
    """Packets of a block-structured capture; each section has its own byte order and interfaces."""
    end, at, links = "<", 0, []
    while at < len(data):
        if data[at:at + 4] == b"\x0a\x0d\x0d\x0a":
            end, links = (">" if data[at + 8:at + 12] == b"\x1a\x2b\x3c\x4d" else "<"), []
        size = struct.unpack_from(end + "I", data, at + 4)[0] if at + 8 <= len(data) else 0
        if size < 12 or size % 4 or at + size > len(data):  # the rest cannot be cut into blocks
            yield None, None, ETHERNET, b"", True
            return
        kind, body = struct.unpack_from(end + "I", data, at)[0], data[at + 8:at + size - 4]
        at += size
        try:
            if kind == 1:
                link, _, snap = struct.unpack_from(end + "HHI", body)
                links.append((link, snap, *_ticks_per_second(body[8:], end)))
            elif kind in (2, 6):
                port, high, low, kept, wire = struct.unpack_from(end + ("HxxIIII" if kind == 2 else "IIIII"), body)
                link, _, per_second, shift = links[port]
                micros = shift * 1_000_000 + (high << 32 | low) * 1_000_000 // per_second
                yield micros, wire, link, body[20:20 + kept], 20 + kept > len(body)
            elif kind == 3:
                wire, (link, snap, _, _) = struct.unpack_from(end + "I", body)[0], links[0]
                kept = min(wire, snap or wire)
                yield None, wire, link, body[4:4 + kept], 4 + kept > len(body)
        except (struct.error, IndexError):  # a block too short, or an interface never described
            yield None, None, ETHERNET, b"", True


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut capture files into frames, yielding bounded batches."""
    names = [c.split()[0] for c in FRAME_SCHEMA.split(", ")]
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"]):
            records = _block_records if data[:4].hex().upper() == PCAPNG_MAGIC else _classic_records
            numbered = ((path, k, *record) for k, record in enumerate(records(data)))
            while rows := list(islice(numbered, FRAMES_PER_BATCH)):
                yield pd.DataFrame(rows, columns=names).astype({"epoch_micros": "Int64", "wire_length": "Int64"})


def read_capture_frames(spark: SparkSession, path: str) -> DataFrame:
    """S5. Frames of a folder of classic and block-structured captures, one task per file, as capture tools rotate them.

    A record that the file's end cuts off, or a tail that is no record, is a frame with ``cut`` set. A record's place follows from all records before it, so a single file cannot be cut; Spark refuses
    files above ``spark.sql.sources.binaryFile.maxLength`` rather than reading them in part. Frames
    stored as a table need no such limit: pass them to :func:`decode_frames` directly.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content", sniff_format(F.col("content")).alias("format"))
    known = files.select("path", F.when(F.col("format") != "unknown", F.col("content")).otherwise(
        F.raise_error(F.concat(F.lit("no capture file: "), F.col("path")))).alias("content"))
    return known.mapInPandas(_frames, FRAME_SCHEMA)


def number_at(data: Column, offset: Column | int, size: int) -> Column:
    """Big-endian unsigned integer of ``size`` bytes at a 0-based offset; NULL past the end."""
    start = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    part = data.substr(start, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def _address(data: Column, offset: int) -> Column:
    return F.concat_ws(".", *[number_at(data, offset + i, 1).cast("string") for i in range(4)])


def decode_frames(frames: DataFrame) -> DataFrame:
    """S5. Link, IPv4, TCP, UDP and ICMP headers as columns, all in the JVM.

    ``link_type`` says how a frame begins (Ethernet with any number of VLAN tags, bare IP, loopback,
    both cooked forms; others are non_ip); without that column all frames are Ethernet. Frames with
    ``cut`` set are parse_error. ``parse_status`` is ok, ipv6_not_implemented, non_ip or parse_error; only ok rows carry fields.
    """
    raw = F.col("frame")
    link = F.col("link_type") if "link_type" in frames.columns else F.lit(ETHERNET)
    cut = F.coalesce(F.col("cut"), F.lit(False)) if "cut" in frames.columns else F.lit(False)
    tags = "|".join(f"{t:04X}.{{4}}" for t in VLAN_TAGS)
    tagged = F.length(F.regexp_extract(F.hex(raw.substr(F.lit(13), F.lit(65535))), f"^((?:{tags})*)", 1)) / 2
    ethernet_at = F.when(number_at(raw, 12, 2).isin(*VLAN_TAGS), tagged.cast("int") + 14).otherwise(14)
    bare = link.isin(*BARE_IP)
    ip_at = (F.when(link == ETHERNET, ethernet_at).when(bare, 0).when(link == LOOPBACK, 4)
             .when(link == COOKED, 16).when(link == COOKED_2, 20))
    opened = frames.withColumn("__at", ip_at)
    ip_at = F.col("__at")
    version = F.shiftright(number_at(raw, ip_at, 1), 4)
    by_version = F.when(version == 4, ETHERTYPE_IPV4).when(version == 6, ETHERTYPE_IPV6)
    kind = (F.when(bare | (link == LOOPBACK), by_version).when(link == COOKED_2, number_at(raw, 0, 2))
            .otherwise(number_at(raw, ip_at - 2, 2)))
    opened = opened.withColumns({"__type": kind, "__ip": raw.substr(ip_at + 1, F.lit(65535))})
    ip = F.col("__ip")
    first = number_at(ip, 0, 1)
    head = first.bitwiseAND(F.lit(15)) * 4
    opened = opened.withColumns({"__head": head, "__proto": number_at(ip, 9, 1), "__total": number_at(ip, 2, 2)})
    opened = opened.withColumn("__l4", ip.substr(F.col("__head").cast("int") + 1, F.lit(65535)))
    l4, proto = F.col("__l4"), F.col("__proto")
    name = F.coalesce(*[F.when(proto == k, v) for k, v in IP_PROTOCOLS.items()], F.lit("OTHER"))
    tcp, udp = proto == 6, proto == 17
    complete = (F.shiftright(first, 4) == 4) & (F.col("__head") >= 20) & (F.octet_length(ip) >= F.col("__head"))
    status = (F.when(cut, "parse_error").when(F.col("__type") == ETHERTYPE_IPV6, "ipv6_not_implemented")
              .when(F.coalesce(F.col("__type") != ETHERTYPE_IPV4, F.lit(True)), "non_ip")
              .when(F.coalesce(complete, F.lit(False)), "ok").otherwise("parse_error"))
    flags = number_at(l4, 13, 1)
    letters = F.array_join(F.array_compact(F.array(*[
        F.when(flags.bitwiseAND(F.lit(1 << i)) != 0, letter) for i, letter in enumerate(FLAG_LETTERS)])), "")
    l4_head = F.when(tcp, F.shiftright(number_at(l4, 12, 1), 4) * 4).when(udp | (proto == 1), 8)
    fragment = number_at(ip, 6, 2)
    fields = {
        "timestamp": F.timestamp_micros("epoch_micros"), "packet_length": F.col("wire_length"),
        "src_ip": _address(ip, 12), "dst_ip": _address(ip, 16),
        "src_port": F.when(tcp | udp, number_at(l4, 0, 2)), "dst_port": F.when(tcp | udp, number_at(l4, 2, 2)),
        "protocol": name, "ip_protocol": proto, "ttl": number_at(ip, 8, 1),
        "flag_bits": F.when(tcp, flags), "tcp_flags": F.when(tcp, letters), "tcp_seq": F.when(tcp, number_at(l4, 4, 4)),
        "tcp_window_size": F.when(tcp, number_at(l4, 14, 2)),
        "payload_length": F.when(l4_head.isNotNull(), F.greatest(F.lit(0), F.col("__total") - F.col("__head") - l4_head)),
        "more_fragments": fragment.bitwiseAND(F.lit(0x2000)) != 0, "fragment_offset": fragment.bitwiseAND(F.lit(0x1FFF)),
    }
    decoded = opened.withColumn("parse_status", status)
    ok = F.col("parse_status") == "ok"
    kept = [c for c in frames.columns if c not in ("frame", "wire_length", "epoch_micros", "link_type", "cut")]
    timed = {"timestamp", "packet_length"}
    return decoded.select(*kept, "parse_status", *[
        (v if n in timed else F.when(ok, v)).alias(n) for n, v in fields.items()])


def capture_events(decoded: DataFrame, include_non_ip: bool = False) -> DataFrame:
    """S5. Canonical events: one packet each, IPv4 only unless rows without fields are wanted."""
    protocol = F.when(F.col("protocol") == "OTHER", F.col("ip_protocol").cast("string")).otherwise(F.col("protocol"))
    rows = decoded if include_non_ip else decoded.filter("parse_status = 'ok'")
    return rows.select(
        "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", protocol.alias("protocol"),
        F.lit(1).cast("long").alias("packet_count"), F.col("packet_length").cast("double").alias("byte_count"),
        F.lit(0.0).alias("duration"), "tcp_flags", "ttl", "tcp_window_size", F.lit("pcap").alias("source_type"))


def status_counts(decoded: DataFrame) -> DataFrame:
    """S5. Frames per parse status."""
    return decoded.groupBy("parse_status").agg(F.count("*").alias("frames"))


def read_captures(spark: SparkSession, path: str, include_non_ip: bool = False, limit: int | None = None) -> DataFrame:
    """S5. A folder of captures as canonical events in time order, optionally the first ``limit``."""
    events = capture_events(decode_frames(read_capture_frames(spark, path)), include_non_ip).orderBy("timestamp")
    return events if limit is None else events.limit(limit)
