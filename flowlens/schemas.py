"""Names, label orders and record schemas.

Everything below the marker is a fixed value: the numbers, names and orders are
part of the data contract and must not change.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values ---------------------------------------------------------

FAMILY_ORDER = (
    "Benign", "BruteForce", "DDoS", "DoS", "Mirai", "Recon", "Spoofing", "Web-Based",
)
OOD_FAMILIES = ("BruteForce", "Recon")
KNOWN_ATTACK_FAMILIES = ("DDoS", "DoS", "Mirai", "Spoofing", "Web-Based")
MULTICLASS_LABELS = ("Benign",) + KNOWN_ATTACK_FAMILIES
SPLITS = ("train", "val", "test", "ood_attack_holdout")
OOD_SPLIT = "ood_attack_holdout"
SPLIT_RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}

LEAKAGE_COLUMNS = ("Flow ID", "Src IP", "Dst IP", "Timestamp", "Label")
METADATA_COLUMNS = (
    "source_file", "attack_family", "attack_scenario",
    "derived_label_binary", "derived_label_family", "split",
)
LABEL_COLUMNS = (
    "attack_family", "attack_scenario", "derived_label_binary", "derived_label_family",
)
EXPECTED_COLUMN_COUNT = 84
EXPECTED_FIRST_COLUMN = "Flow ID"
KNOWN_BAD_FOLDER = "DoS/DoS-TCP_Flood"

FEATURE_COLUMNS = (
    "Src Port", "Dst Port", "Protocol", "Flow Duration",
    "Total Fwd Packet", "Total Bwd packets",
    "Total Length of Fwd Packet", "Total Length of Bwd Packet",
    "Fwd Packet Length Max", "Fwd Packet Length Min",
    "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min",
    "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Fwd Header Length", "Bwd Header Length",
    "Fwd Packets/s", "Bwd Packets/s",
    "Packet Length Min", "Packet Length Max", "Packet Length Mean",
    "Packet Length Std", "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count",
    "ACK Flag Count", "CWR Flag Count", "ECE Flag Count",
    "Down/Up Ratio", "Average Packet Size",
    "Fwd Segment Size Avg", "Bwd Segment Size Avg",
    "Bwd Bytes/Bulk Avg", "Bwd Packet/Bulk Avg", "Bwd Bulk Rate Avg",
    "Subflow Fwd Packets", "Subflow Fwd Bytes",
    "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "FWD Init Win Bytes", "Bwd Init Win Bytes",
    "Fwd Act Data Pkts", "Fwd Seg Size Min",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
)

CONTRACT_ALIASES = {
    "SrcPort": "Src Port",
    "DstPort": "Dst Port",
    "FlowDuration": "Flow Duration",
    "Tot Fwd Pkts": "Total Fwd Packet",
    "Tot Bwd Pkts": "Total Bwd packets",
    "TotLen Fwd Pkts": "Total Length of Fwd Packet",
    "TotLen Bwd Pkts": "Total Length of Bwd Packet",
    "Pkt Len Min": "Packet Length Min",
    "Pkt Len Max": "Packet Length Max",
    "Pkt Len Mean": "Packet Length Mean",
    "Pkt Len Std": "Packet Length Std",
    "Pkt Len Var": "Packet Length Variance",
    "Init Fwd Win Byts": "FWD Init Win Bytes",
    "Init Bwd Win Byts": "Bwd Init Win Bytes",
}
SECONDARY_ALIASES = {
    "SourcePort": "Src Port",
    "DestinationPort": "Dst Port",
    "Duration": "Flow Duration",
    "TotalFwdPackets": "Total Fwd Packet",
    "TotalBwdPackets": "Total Bwd packets",
    "FwdPktsLenTotal": "Total Length of Fwd Packet",
    "BwdPktsLenTotal": "Total Length of Bwd Packet",
    "PacketLenMin": "Packet Length Min",
    "PacketLenMax": "Packet Length Max",
    "PacketLenMean": "Packet Length Mean",
    "PacketLenStd": "Packet Length Std",
    "PacketLenVar": "Packet Length Variance",
    "InitFwdWinBytes": "FWD Init Win Bytes",
    "InitBwdWinBytes": "Bwd Init Win Bytes",
}
PRIMARY_METADATA = {
    "flow_id": "source_flow_id",
    "collector_id": "source_collector_id",
    "captured_at": "source_timestamp",
}
SECONDARY_METADATA = {
    "trace_id": "source_flow_id",
    "sensor_id": "source_collector_id",
    "event_ts": "source_timestamp",
}
PRIMARY_PROFILE_ID = "cicflowmeter_primary_v1"
SECONDARY_PROFILE_ID = "cicflowmeter_secondary_v1"
CONTROLLED_EXTRAS = ("flow_family", "transport_family", "capture_mode")

MAX_JSONL_LINE_LENGTH = 1_048_576
INGEST_ERROR_PREVIEW = 512
DEFAULT_SENSOR_ID = "sensor-local"
TRIAGE_STATES = ("new", "acknowledged", "investigating", "resolved", "false_positive")
SEVERITY_FLOORS = (("critical", 0.995), ("high", 0.9), ("medium", 0.75), ("low", 0.5))
SEVERITY_RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1, "unknown": 0}
FAMILY_STATUSES = ("known", "unknown", "benign")
ACTIVE_GAP_SECONDS = 1.0
FPR_CAPS = (0.005, 0.01, 0.02, 0.05)
TUNING_FPR_CAPS = (0.005, 0.01, 0.02)
GATE_MAX_FPR = 0.02
SWEEP_POINTS = 401
FRESHNESS_SECONDS = 300.0
PROMOTION_PLAN = {"catboost": 2, "random_forest": 1, "hist_gb": 1}

# ---- end of fixed values --------------------------------------------------

PACKET_SCHEMA = T.StructType([
    T.StructField("window_path", T.StringType()),
    T.StructField("packet_ordinal", T.LongType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("packet_length", T.IntegerType()),
    T.StructField("payload_length", T.IntegerType()),
    T.StructField("header_length", T.IntegerType()),
    T.StructField("flags", T.IntegerType()),
    T.StructField("window_size", T.IntegerType()),
])

ALERT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("sensor_id", T.StringType()),
    T.StructField("source_event_id", T.StringType()),
    T.StructField("event_ts", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("payload_json", T.StringType()),
    T.StructField("triage_status", T.StringType()),
    T.StructField("triage_updated_at", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

RULE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("sensor_id", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("match_field", T.StringType()),
    T.StructField("match_value", T.StringType()),
    T.StructField("applies_to", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

OUTBOX_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("alert_id", T.LongType()),
    T.StructField("channel", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("dedupe_key", T.StringType()),
    T.StructField("payload_json", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("attempt_count", T.IntegerType()),
    T.StructField("last_attempt_at", T.StringType()),
    T.StructField("next_attempt_at", T.StringType()),
    T.StructField("last_error", T.StringType()),
    T.StructField("provider_message_id", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])
