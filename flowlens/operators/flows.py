"""Packets to bidirectional flows with the full feature row.

Everything a flow needs is aggregated for both orientations of its unordered
endpoint pair, so the forward direction (the sender of the first packet in file
order) is picked at the very end and packets are never joined back to flows.

Gaps between packets need an order. Instead of one window per flow, packets are
windowed per (flow, time slice); each slice is reduced to one row, and the gaps
between slices are added from those rows. Any cuts in time give the same flows.
Capture windows with more than ``SLICE_PACKETS`` packets are cut at quantiles of
their own times, and packets of the very time of a cut by their ordinals, so no
slice of a flow is larger than a share of its window, however short that is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.numeric import safe_ratio
from flowlens.operators.ordering import number_rows
from flowlens.operators.staging import lookup
from flowlens.plans.workspace import discard, stored
from flowlens.schemas import ACTIVE_GAP_SECONDS, FEATURE_COLUMNS

TCP, UDP = 6, 17
# TCP flag bits.
FLAG_BITS = {
    "FIN": 0x01, "SYN": 0x02, "RST": 0x04, "PSH": 0x08, "ACK": 0x10, "ECE": 0x40, "CWR": 0x80,
}
COLLECTOR_ID = "offline-window-extractor"
CAPTURE_MODE = "closed-window"

SLICE_PACKETS = 1 << 18
TASK_PACKETS = 1 << 14  # a slice's row is far wider than a packet, so tasks are sized by packets, not by bytes
CUTS = 63  # most cuts of a window
KEY = ("window_path", "end_a", "end_b", "protocol")
SIDES = ("all", "a", "b")


def _side(condition: str, value: Column) -> Column:
    """``value`` on packets of a side, null elsewhere."""
    if condition == "all":
        return value
    from_a = F.col("from_a")
    return F.when(from_a if condition == "a" else ~from_a, value)


def _gap(later: Column, earlier: Column) -> Column:
    """Non-negative gap, null without an earlier time."""
    return F.when(earlier.isNotNull() & later.isNotNull(), F.greatest(later - earlier, F.lit(0.0)))


def _moments(name: str, value: Column) -> list[Column]:
    """Mergeable count, sum, squared deviation, min and max."""
    number = value.cast("double")
    return [
        F.count(number).alias(f"{name}_n"),
        F.sum(number).alias(f"{name}_sum"),
        (F.var_pop(number) * F.count(number)).alias(f"{name}_m2"),
        F.min(number).alias(f"{name}_min"),
        F.max(number).alias(f"{name}_max"),
    ]


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Unordered endpoints and the side of each packet."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    return packets.select(
        "window_path",
        F.least(src, dst).alias("end_a"),
        F.greatest(src, dst).alias("end_b"),
        "protocol",
        (src <= dst).alias("from_a"),
        "packet_ordinal", "ts", "packet_length", "payload_length", "header_length", "flags",
        "window_size",
    )


def time_cuts(packets: DataFrame, slice_packets: int) -> DataFrame | None:
    """(window_path, cuts): quantiles of the packet times of large windows; None if there is none."""
    counts = packets.groupBy("window_path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > slice_packets)
    large = stored(counts.select("window_path"), "large-windows")
    if large.isEmpty():
        discard(large)
        return None
    shares = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    held = packets.select("window_path", "ts").join(lookup(large), "window_path")
    cuts = held.groupBy("window_path").agg(F.array_distinct(F.percentile_approx("ts", shares, 10_000)).alias("cuts"))
    return lookup(stored(cuts, "time-cuts"))


def with_slice(packets: DataFrame, slice_seconds: float, slice_packets: int) -> DataFrame:
    """Add ``slice``, a struct that follows the order of (ts, packet_ordinal) in a window."""
    period = F.floor(F.col("ts") / F.lit(float(slice_seconds))).alias("period")
    cuts = time_cuts(packets, slice_packets)
    if cuts is None:
        return packets.withColumn("slice", F.struct(period, F.lit(0).alias("part"), F.lit(0).cast("long").alias("share")))
    joined = packets.join(cuts, "window_path", "left")
    held = [F.get("cuts", F.lit(i)) for i in range(CUTS)]
    before = sum((F.when(c < F.col("ts"), 1).otherwise(0) for c in held), F.lit(0))
    at = F.coalesce(F.array_contains("cuts", F.col("ts")), F.lit(False))
    # Packets of one and the same time are in order of their ordinals.
    share = F.when(at, F.floor(F.col("packet_ordinal") / slice_packets)).otherwise(F.lit(0)).cast("long")
    part = 2 * before + F.when(at, 1).otherwise(0)
    return joined.withColumn("slice", F.struct(period, part.alias("part"), share.alias("share"))).drop("cuts")


def _slices(keyed: DataFrame, slice_seconds: float, gap_seconds: float, slice_packets: int, tasks: int) -> DataFrame:
    """One row per (flow, time slice) with mergeable statistics."""
    sliced = with_slice(keyed, slice_seconds, slice_packets).repartition(tasks, *KEY, "slice")
    inside = Window.partitionBy(*KEY, "slice").orderBy("ts", "packet_ordinal")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    gaps = sliced.withColumns({
        f"gap_{s}": _side(s, _gap(
            F.col("ts"), F.last(_side(s, F.col("ts")), ignorenulls=True).over(before)
        ))
        for s in SIDES
    })
    breaks = gaps.withColumn("is_break", F.coalesce(F.col("gap_all") > gap_seconds, F.lit(False)))
    # A break closes the activity that began at the previous break of the slice.
    sessions = breaks.withColumns({
        "began": F.last(F.when(F.col("is_break"), F.col("ts")), ignorenulls=True).over(before),
        "previous_ts": F.lag("ts").over(inside),
    })
    closed = F.when(F.col("is_break") & F.col("began").isNotNull(), F.col("previous_ts") - F.col("began"))
    aggregates: list[Column] = [
        F.min_by(F.col("from_a"), F.col("packet_ordinal")).alias("first_from_a"),
        F.min("packet_ordinal").alias("first_ordinal"),
        *_moments("active", closed),
        *_moments("idle", F.when(F.col("is_break"), F.col("gap_all"))),
        F.min(F.when(F.col("is_break"), F.col("ts"))).alias("first_break"),
        F.max(F.when(F.col("is_break"), F.col("ts"))).alias("last_break"),
        F.min_by(
            F.when(F.col("is_break"), F.col("previous_ts")),
            F.when(F.col("is_break"), F.col("ts")),
        ).alias("first_break_end"),
    ]
    for s in SIDES:
        aggregates += [
            F.min(_side(s, F.col("ts"))).alias(f"{s}_first_ts"),
            F.max(_side(s, F.col("ts"))).alias(f"{s}_last_ts"),
            F.sum(_side(s, F.col("payload_length").cast("long"))).alias(f"{s}_payload"),
            F.sum(_side(s, F.col("header_length").cast("long"))).alias(f"{s}_header"),
            F.min(_side(s, F.col("payload_length"))).alias(f"{s}_payload_min"),
            F.max(_side(s, F.when(F.col("window_size") > 0, F.col("window_size")))).alias(f"{s}_window"),
            F.count_if(F.coalesce(_side(s, F.col("payload_length") > 0), F.lit(False))).alias(f"{s}_data"),
            F.count_if(F.coalesce(_side(s, F.col("flags").bitwiseAND(0x08) != 0), F.lit(False))).alias(f"{s}_psh"),
            *_moments(f"{s}_len", _side(s, F.col("packet_length"))),
            *_moments(f"{s}_gap", F.col(f"gap_{s}")),
        ]
    for flag, bit in FLAG_BITS.items():
        aggregates.append(F.count_if(F.col("flags").bitwiseAND(bit) != 0).alias(f"flag_{flag}"))
    return sessions.groupBy(*KEY, "slice").agg(*aggregates)


def _merge_slices(slices: DataFrame, gap_seconds: float, tasks: int) -> DataFrame:
    """Merge the slices of each flow, adding gaps and sessions that cross slices."""
    slices = slices.repartition(tasks, *KEY)
    across = Window.partitionBy(*KEY).orderBy("slice")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*KEY)

    crossing = slices.withColumns({
        f"cross_{s}": _gap(
            F.col(f"{s}_first_ts"), F.last(f"{s}_last_ts", ignorenulls=True).over(earlier)
        )
        for s in SIDES
    })
    crossing = crossing.withColumns({
        "entry_end": F.lag("all_last_ts").over(across),
        "is_entry_break": F.coalesce(F.col("cross_all") > gap_seconds, F.lit(False)),
        "is_head": F.row_number().over(across) == 1,
        "is_tail": F.lead("slice").over(across).isNull(),
    })
    # Start of the activity still open when a slice ends.
    opened = F.coalesce(
        F.col("last_break"),
        F.when(F.col("is_head") | F.col("is_entry_break"), F.col("all_first_ts")),
    )
    crossing = crossing.withColumn("opened", opened)
    crossing = crossing.withColumn("open_before", F.last("opened", ignorenulls=True).over(earlier))
    open_here = F.when(F.col("is_head") | F.col("is_entry_break"), F.col("all_first_ts")).otherwise(
        F.col("open_before")
    )
    crossing = crossing.withColumns({
        "x_entry": F.when(F.col("is_entry_break"), F.col("entry_end") - F.col("open_before")),
        "x_first": F.when(F.col("first_break").isNotNull(), F.col("first_break_end") - open_here),
        "x_tail": F.when(
            F.col("is_tail"), F.col("all_last_ts") - F.coalesce(F.col("last_break"), open_here)
        ),
        "x_idle": F.when(F.col("is_entry_break"), F.col("cross_all")),
    })
    extras = {
        "active": ["x_entry", "x_first", "x_tail"],
        "idle": ["x_idle"],
        **{f"{s}_gap": [f"cross_{s}"] for s in SIDES},
        **{f"{s}_len": [] for s in SIDES},
    }

    def total(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    means = {}
    for name, columns in extras.items():
        top = total(F.col(f"{name}_sum"))
        bottom = F.col(f"{name}_n").cast("double")
        for c in columns:
            top = top + total(F.col(c))
            bottom = bottom + F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)
        means[f"{name}_mean"] = safe_ratio(F.sum(top).over(whole), F.sum(bottom).over(whole))
    centred = crossing.withColumns(means)

    aggregates: list[Column] = [
        F.min_by("first_from_a", "first_ordinal").alias("forward_is_a"),
        F.min("first_ordinal").alias("first_ordinal"),
    ]
    for name, columns in extras.items():
        mean = F.col(f"{name}_mean")
        own = F.col(f"{name}_n")
        square = total(F.col(f"{name}_m2")) + F.when(
            own > 0, own * F.pow(F.col(f"{name}_sum") / own - mean, F.lit(2.0))
        ).otherwise(F.lit(0.0))
        count, low, high, amount = own, F.col(f"{name}_min"), F.col(f"{name}_max"), total(F.col(f"{name}_sum"))
        for c in columns:
            present = F.col(c).isNotNull()
            count = count + F.when(present, 1).otherwise(0)
            square = square + F.when(present, F.pow(F.col(c) - mean, F.lit(2.0))).otherwise(F.lit(0.0))
            amount = amount + total(F.col(c))
            low, high = F.least(low, F.col(c)), F.greatest(high, F.col(c))
        aggregates += [
            F.sum(count).alias(f"{name}_n"),
            F.sum(amount).alias(f"{name}_sum"),
            F.max(mean).alias(f"{name}_mean"),
            F.sum(square).alias(f"{name}_m2"),
            F.min(low).alias(f"{name}_min"),
            F.max(high).alias(f"{name}_max"),
        ]
    for s in SIDES:
        aggregates += [
            F.min(f"{s}_first_ts").alias(f"{s}_first_ts"),
            F.max(f"{s}_last_ts").alias(f"{s}_last_ts"),
            F.min(f"{s}_payload_min").alias(f"{s}_payload_min"),
            F.max(f"{s}_window").alias(f"{s}_window"),
            *[F.coalesce(F.sum(f"{s}_{c}"), F.lit(0)).alias(f"{s}_{c}") for c in ("payload", "header", "data", "psh")],
        ]
    aggregates += [F.sum(f"flag_{f}").alias(f"flag_{f}") for f in FLAG_BITS]
    return centred.groupBy(*KEY).agg(*aggregates)


def _directed(name: str, direction: str) -> Column:
    """Statistic of the forward or backward side."""
    a, b = F.col(f"a_{name}"), F.col(f"b_{name}")
    return F.when(F.col("forward_is_a"), a if direction == "fwd" else b).otherwise(
        b if direction == "fwd" else a
    )


def _std(name: str, direction: str | None = None) -> Column:
    m2 = F.col(f"{name}_m2") if direction is None else _directed(f"{name}_m2", direction)
    n = F.col(f"{name}_n") if direction is None else _directed(f"{name}_n", direction)
    return F.when(n > 0, F.sqrt(m2 / n)).otherwise(F.lit(0.0))


def _zero(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def _six(value: Column) -> Column:
    return F.round(value, 6)


def _features() -> dict[str, Column]:
    duration = F.greatest(F.col("all_last_ts") - F.col("all_first_ts"), F.lit(0.0))

    def rate(amount: Column) -> Column:
        return _six(F.when(duration > 0, amount / duration).otherwise(F.lit(0.0)))

    fwd_n, bwd_n = _directed("len_n", "fwd"), _directed("len_n", "bwd")
    fwd_pay, bwd_pay = _directed("payload", "fwd"), _directed("payload", "bwd")
    bwd_mean_payload = _six(safe_ratio(bwd_pay, bwd_n))
    fwd_end = F.when(F.col("forward_is_a"), F.col("end_a")).otherwise(F.col("end_b"))
    bwd_end = F.when(F.col("forward_is_a"), F.col("end_b")).otherwise(F.col("end_a"))
    out = {
        "Src Port": fwd_end["port"],
        "Dst Port": bwd_end["port"],
        "Protocol": F.col("protocol").cast("double"),
        "Flow Duration": F.round(duration * 1000.0, 3),
        "Total Fwd Packet": fwd_n,
        "Total Bwd packets": bwd_n,
        "Total Length of Fwd Packet": fwd_pay,
        "Total Length of Bwd Packet": bwd_pay,
        "Flow Bytes/s": rate(F.col("all_len_sum")),
        "Flow Packets/s": rate(F.col("all_len_n")),
        "Fwd PSH Flags": _directed("psh", "fwd"),
        "Fwd Header Length": _directed("header", "fwd"),
        "Bwd Header Length": _directed("header", "bwd"),
        "Fwd Packets/s": rate(fwd_n),
        "Bwd Packets/s": rate(bwd_n),
        "Packet Length Min": _zero(F.col("all_len_min")),
        "Packet Length Max": _zero(F.col("all_len_max")),
        "Packet Length Mean": F.col("all_len_mean"),
        "Packet Length Std": _std("all_len"),
        "Packet Length Variance": _six(F.when(F.col("all_len_n") > 0, F.col("all_len_m2") / F.col("all_len_n")).otherwise(0.0)),
        "Down/Up Ratio": safe_ratio(bwd_n, fwd_n),
        "Average Packet Size": _six(F.col("all_len_mean")),
        "Fwd Segment Size Avg": _six(safe_ratio(fwd_pay, fwd_n)),
        "Bwd Segment Size Avg": bwd_mean_payload,
        "Bwd Bytes/Bulk Avg": bwd_mean_payload,
        "Bwd Packet/Bulk Avg": bwd_mean_payload,
        "Bwd Bulk Rate Avg": rate(bwd_pay),
        "Subflow Fwd Packets": fwd_n,
        "Subflow Fwd Bytes": fwd_pay,
        "Subflow Bwd Packets": bwd_n,
        "Subflow Bwd Bytes": bwd_pay,
        "FWD Init Win Bytes": _zero(_directed("window", "fwd")),
        "Bwd Init Win Bytes": _zero(_directed("window", "bwd")),
        "Fwd Act Data Pkts": _directed("data", "fwd"),
        "Fwd Seg Size Min": _zero(_directed("payload_min", "fwd")),
    }
    for label, direction in (("Fwd", "fwd"), ("Bwd", "bwd")):
        out[f"{label} Packet Length Max"] = _zero(_directed("len_max", direction))
        out[f"{label} Packet Length Min"] = _zero(_directed("len_min", direction))
        out[f"{label} Packet Length Mean"] = _zero(_directed("len_mean", direction))
        out[f"{label} Packet Length Std"] = _std("len", direction)
        out[f"{label} IAT Total"] = _six(_zero(_directed("gap_sum", direction)))
        out[f"{label} IAT Mean"] = _six(_zero(_directed("gap_mean", direction)))
        out[f"{label} IAT Std"] = _six(_std("gap", direction))
        out[f"{label} IAT Max"] = _six(_zero(_directed("gap_max", direction)))
        out[f"{label} IAT Min"] = _six(_zero(_directed("gap_min", direction)))
    for label, name in (("Flow IAT", "all_gap"), ("Active", "active"), ("Idle", "idle")):
        out[f"{label} Mean"] = _six(_zero(F.col(f"{name}_mean")))
        out[f"{label} Std"] = _six(_std(name))
        out[f"{label} Max"] = _six(_zero(F.col(f"{name}_max")))
        out[f"{label} Min"] = _six(_zero(F.col(f"{name}_min")))
    for flag in FLAG_BITS:
        out[f"{flag} Flag Count"] = F.col(f"flag_{flag}")
    return {name: out[name] for name in FEATURE_COLUMNS}


def assemble_flows(
    packets: DataFrame,
    slice_seconds: float = 3600.0,
    gap_seconds: float = ACTIVE_GAP_SECONDS,
    index_bucket: int = 1 << 16,
    slice_packets: int = SLICE_PACKETS,
) -> DataFrame:
    """One row per bidirectional flow and window: endpoints, metadata, 72 features.

    Packets are decoded once, into a table with the columns that flows need; the
    merged flows are stored too, before they are numbered per window in the order of
    their first packet, by ordinal ranges of ``index_bucket`` packets.
    """
    keyed = stored(with_flow_key(packets), "packets")
    tasks = keyed.count() // TASK_PACKETS + 1
    slices = _slices(keyed, slice_seconds, gap_seconds, slice_packets, tasks)
    merged = stored(_merge_slices(slices, gap_seconds, tasks), "flows")
    discard(keyed)
    numbered = number_rows(
        merged, ["window_path"], F.floor(F.col("first_ordinal") / index_bucket), [F.col("first_ordinal")], "flow_index",
        partitions=tasks,
    )
    fwd = F.when(F.col("forward_is_a"), F.col("end_a")).otherwise(F.col("end_b"))
    bwd = F.when(F.col("forward_is_a"), F.col("end_b")).otherwise(F.col("end_a"))
    started = F.timestamp_micros(F.round(F.col("all_first_ts") * 1e6).cast("long"))
    whole_second = F.date_format(started, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(started, "SSSSSS")
    captured = F.concat(
        whole_second,
        F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.lit("+00:00"),
    )
    protocol_name = F.when(F.col("protocol") == TCP, "tcp").when(F.col("protocol") == UDP, "udp").otherwise("ip")
    bidirectional = _directed("len_n", "bwd") > 0
    flow_id = F.concat(
        fwd["ip"], F.lit(":"), fwd["port"].cast("string"), F.lit("-"),
        bwd["ip"], F.lit(":"), bwd["port"].cast("string"), F.lit("-"),
        F.format_string("%05d", F.col("flow_index")),
    )
    features = [c.alias(n) for n, c in _features().items()]
    return numbered.select(
        "window_path",
        "flow_index",
        fwd["ip"].alias("src_ip"),
        fwd["port"].alias("src_port"),
        bwd["ip"].alias("dst_ip"),
        bwd["port"].alias("dst_port"),
        F.col("protocol").alias("ip_protocol"),
        F.col("all_first_ts").alias("first_ts"),
        F.col("all_last_ts").alias("last_ts"),
        flow_id.alias("source_flow_id"),
        F.lit(COLLECTOR_ID).alias("source_collector_id"),
        captured.alias("source_timestamp"),
        F.when(bidirectional, "bidirectional").otherwise("unidirectional").alias("flow_family"),
        protocol_name.alias("transport_family"),
        F.lit(CAPTURE_MODE).alias("capture_mode"),
        *features,
    )


def flow_order() -> list[Column]:
    """Deterministic output order of the flows of a window."""
    return [
        F.col(c) for c in ("first_ts", "ip_protocol", "src_ip", "src_port", "dst_ip", "dst_port")
    ]
