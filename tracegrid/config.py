"""Thresholds and weights. Results depend on them."""

from __future__ import annotations

WINDOW_SECONDS = 90
CONFIDENCE_FLOOR = 0.5
SCRIPT_TYPES = ["P2PKH", "P2SH", "P2WPKH", "P2WSH", "P2TR", "OP_RETURN", "MULTISIG_BARE", "NONSTANDARD", "UNKNOWN"]
OFFSHORE = ["PA", "SC", "RU", "CN", "HK", "TR", "UA"]

MAX_EXPORT_NODES = 6000
FOREST_TREES, FOREST_SAMPLE = 200, 256
LOF_NEIGHBOURS, LOF_WEIGHT = 20, 0.35
ANOMALY_QUANTILE = 0.94

PEEL_ASYMMETRY = 0.75
PEEL_MIN_SHARE = 0.03
PEEL_MAX_HOPS, PEEL_MIN_HOPS = 8, 3
PEEL_MIN_RATIO, PEEL_MAX_RATIO = 0.50, 1.02
MIX_INPUTS, MIX_OUTPUTS, MIX_CV = 5, 5, 0.15

COMMON_INPUT_MAX = 5
LOUVAIN_RESOLUTION = 1.0
CLUSTER_REPORT_MAX = 50

DAMPING = 0.85
RISK_DECAY, RISK_MAX_HOPS, HUB_DEGREE = 0.7, 6, 15
RISK_PAGERANK, RISK_PROXIMITY, TX_RISK_BLEND = 0.6, 0.4, 0.55
INHERIT_DISCOUNT, INHERIT_MAX = 0.85, 30

MIN_ALERT_RISK, MAX_ALERTS, PER_CATEGORY, CONFIDENCE_LEAST = 0.50, 60, 2, 0.35
TOP_FEATURES = 5
WEIGHTS = {"peel": 0.22, "mixing": 0.10, "anomaly": 0.20, "risk": 0.34, "cluster": 0.10, "correlation": 0.08}
LADDER = {"risk": 0.95, "peel": 0.85, "mixing": 0.75, "anomaly": 0.70}
