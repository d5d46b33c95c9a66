"""Fixed values that give the operators their meaning.

Everything here is data (names, identifiers, vocabularies, thresholds); none of
it is configuration of an installation.  Addresses and credentials never belong
in this module: sinks and allowlists take them from the caller.
"""

# --- fixed values: flow feature contract, in vector order -------------------
FEATURES_78 = [
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s",
    "Min Packet Length", "Max Packet Length", "Packet Length Mean", "Packet Length Std",
    "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count",
    "URG Flag Count", "CWE Flag Count", "ECE Flag Count",
    "Down/Up Ratio", "Average Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    "Fwd Header Length.1",
    "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "Init_Win_bytes_forward", "Init_Win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]

# position of each of the 25 record-level features inside the 78-vector
INDEX_25_IN_78 = [1, 2, 3, 4, 5, 8, 9, 12, 13, 14, 15, 16, 17, 18, 19, 21, 22, 26, 27, 51, 52, 63, 65, 70, 74]
FEATURES_25 = [FEATURES_78[i] for i in INDEX_25_IN_78]

# how each of the 25 is obtained from a flow record
EXACT_25 = [
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Down/Up Ratio", "Average Packet Size", "Subflow Fwd Bytes", "Subflow Bwd Bytes",
]
DERIVED_25 = [
    "Fwd Packet Length Mean", "Bwd Packet Length Mean", "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Fwd IAT Mean", "Bwd IAT Mean",
]
UNAVAILABLE_25 = [f for f in FEATURES_25 if f not in EXACT_25 and f not in DERIVED_25]

# TCP flag bits by feature name
TCP_FLAG_BITS = {
    "FIN Flag Count": 0x01, "SYN Flag Count": 0x02, "RST Flag Count": 0x04, "PSH Flag Count": 0x08,
    "ACK Flag Count": 0x10, "URG Flag Count": 0x20, "CWE Flag Count": 0x80, "ECE Flag Count": 0x40,
}

LABEL_COLUMNS = ["Label", " Label", "label"]
BENIGN = "BENIGN"

# --- fixed values: packet session limits -----------------------------------
IDLE_TIMEOUT_S = 15
ACTIVE_TIMEOUT_S = 600

# --- fixed values: flow alerting --------------------------------------------
DEFAULT_THRESHOLD = 0.1245
WARN_FACTOR = 0.8
EMERGENCY_FACTOR = 2.0
ALERT_COOLDOWN_S = 60
ALERTS_PER_WINDOW = 20
ALERT_WINDOW_S = 60
LIVE_MIN_PACKETS = 3
FILE_MIN_PACKETS = 2
DETECTION_CONFIDENCE = 0.7
LOKI_BATCH_SIZE = 50

# --- fixed values: intrusion-detection signature ids -------------------------
INFRA_SIDS = {
    2016149: "STUN request",
    2016150: "STUN response",
    2033966: "messenger DNS",
    2033967: "messenger TLS",
    2047122: "tunnel DNS",
}
STREAM_SIDS = [2210020, 2210029, 2210044, 2210045, 2210063, 2200011, 2200022, 2260003]

NOTIFY_CLASSES = ["CRITICAL", "WARNING", "HUNTING", "INFO"]
REVIEW_CLASSES = [
    "ACTION_REQUIRED", "REVIEW", "HUNTING", "UNCLASSIFIED", "INFORMATIONAL", "STREAM_NOISE", "KNOWN_INFRA",
]
REVIEW_REASONS = {
    "ACTION_REQUIRED": "High severity -- investigate immediately",
    "REVIEW": "Medium severity -- review when possible",
    "HUNTING": "Threat hunting rule -- context-dependent",
    "UNCLASSIFIED": "Needs manual classification",
    "INFORMATIONAL": "Informational -- low priority",
    "STREAM_NOISE": "TCP/protocol analysis artifact",
}
STREAM_MARKERS = ["SURICATA STREAM", "SURICATA Applayer", "SURICATA IPv"]

# --- fixed values: host-alert triage vocabulary -------------------------------
SEVERITIES = ["critical", "high", "medium", "low", "noise"]
ACTIONS = ["escalate", "investigate", "log", "ignore"]
LEVEL_SEVERITY = {
    0: "noise", 1: "noise", 2: "noise", 3: "low", 4: "low",
    5: "low", 6: "medium", 7: "medium", 8: "medium",
    9: "high", 10: "high", 11: "high",
    12: "critical", 13: "critical", 14: "critical", 15: "critical",
}
ALERT_DATA_KEYS = ["srcip", "dstip", "srcport", "dstport", "title", "file", "command", "uid", "user"]
REVIEW_ANSWER_KEYS = ["verifications", "results", "items", "alerts"]
PROMOTION_THRESHOLD = 3
LESSON_MAX_AGE_DAYS = 90
