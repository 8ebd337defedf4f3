"""Ethernet frames to packet rows, as arithmetic on binary columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.staging import compute_once

# Link and network layer numbers.
ETHERTYPE_IPV4 = 0x0800
ETHERTYPE_VLAN = 0x8100
TCP, UDP = 6, 17


def _unsigned(frame: Column, offset: Column, width: int) -> Column:
    """Big-endian unsigned integer; null when it would pass the end of the frame."""
    part = F.substring(frame, offset + 1, F.lit(width))
    return F.when(
        F.octet_length(frame) >= offset + width, F.conv(F.hex(part), 16, 10).cast("int")
    )


def _address(frame: Column, offset: Column) -> Column:
    return F.concat_ws(".", *[_unsigned(frame, offset + i, 1).cast("string") for i in range(4)])


def decode_frames(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """TCP and UDP packets over IPv4; one VLAN tag is unwrapped, anything else is dropped.

    Each step filters on what it has just read, so later offsets are only
    computed for frames long enough to hold them.
    """
    raw = F.col(frame)
    size = F.octet_length(raw)
    zero = F.lit(0)
    linked = compute_once(frames, {"__size": size, "__type": _unsigned(raw, zero + 12, 2)})
    tagged = F.col("__type") == ETHERTYPE_VLAN
    linked = compute_once(linked, {
        "__type": F.when(tagged, _unsigned(raw, zero + 16, 2)).otherwise(F.col("__type")),
        "__ip": F.when(tagged, 18).otherwise(14),
    })
    ip = F.col("__ip")
    network = compute_once(
        linked.filter((F.col("__type") == ETHERTYPE_IPV4) & (F.col("__size") >= ip + 20)),
        {"__first": _unsigned(raw, ip, 1)},
    )
    ip_header = F.col("__first").bitwiseAND(0x0F) * 4
    network = network.filter(
        (F.shiftright("__first", 4) == 4) & (F.col("__first").bitwiseAND(0x0F) >= 5) & (F.col("__size") >= ip + ip_header)
    )
    network = compute_once(network, {
        "__ip_header": ip_header,
        "__l4": ip + ip_header,
        "__total": _unsigned(raw, ip + 2, 2),
        "protocol": _unsigned(raw, ip + 9, 1),
    })
    l4 = F.col("__l4")
    is_tcp, is_udp = F.col("protocol") == TCP, F.col("protocol") == UDP
    transport = compute_once(
        network.filter((is_tcp & (F.col("__size") >= l4 + 20)) | (is_udp & (F.col("__size") >= l4 + 8))),
        {"__l4_header": F.when(is_tcp, F.shiftright(_unsigned(raw, l4 + 12, 1), 4) * 4).otherwise(8)},
    )
    transport = transport.filter(
        is_udp | ((F.col("__l4_header") >= 20) & (F.col("__size") >= l4 + F.col("__l4_header")))
    )
    headers = F.col("__ip_header") + F.col("__l4_header")
    return transport.select(
        "window_path", "packet_ordinal", "ts",
        _address(raw, ip + 12).alias("src_ip"),
        _unsigned(raw, l4, 2).alias("src_port"),
        _address(raw, ip + 16).alias("dst_ip"),
        _unsigned(raw, l4 + 2, 2).alias("dst_port"),
        "protocol",
        F.col("__size").alias("packet_length"),
        F.greatest(F.col("__total") - headers, zero).alias("payload_length"),
        headers.alias("header_length"),
        F.when(is_tcp, _unsigned(raw, l4 + 13, 1)).otherwise(0).alias("flags"),
        F.when(is_tcp, _unsigned(raw, l4 + 14, 2)).otherwise(0).alias("window_size"),
    )
