"""Checks of a generated folder, and of a run over it against the planted truth."""

from __future__ import annotations

import csv
import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.generator import audit, grade
from . import pipeline


def _truth(folder: str) -> dict:
    with open(os.path.join(folder, "planted_patterns.json"), encoding="utf-8") as f:
        return json.load(f)


def audit_folder(folder: str) -> dict[str, bool]:
    """The generator's own checks over the files it wrote; such folders are small and local."""
    rows = []
    for name in ("transactions.csv", "network_metadata.csv"):
        with open(os.path.join(folder, name), newline="", encoding="utf-8") as f:
            rows.append(list(csv.DictReader(f)))
    return audit(*rows, _truth(folder))


def validate(spark: SparkSession, folder: str, output_dir: str) -> dict:
    """Of a run over a generated folder, by detector: recall of what was planted, precision, and share of the benign flagged."""
    truth, at = _truth(folder), pipeline.Store(spark, output_dir)
    ids = lambda rows: {r[0] for r in rows.collect()}  # noqa: E731  a generated folder's rows
    chained = ids(at.read("peel_chains").select(F.explode("txids")))
    mixed = ids(at.read("mixing").select("txid"))
    odd = ids(at.read("tx_anomaly").where("is_anomaly").select("txid"))
    leads = ids(at.read("alerts").select("entity"))
    benign = set(truth["benign"])
    hops = {x for chain in truth["peeling_chains"] for x in chain}
    mixes, odds = set(truth["mixing_transactions"]), {x["txid"] for x in truth["anomalous_transactions"]}
    found = {"peeling": grade(chained, hops, benign), "mixing": grade(mixed, mixes, benign), "anomaly": grade(odd, odds, benign)}
    found["signals"] = grade(chained | mixed | odd, hops | mixes | odds, benign)
    found["leads"] = grade(leads, hops | mixes | odds, benign)
    matched = ids(at.read("correlated").where("correlation_method = 'exact'").select("txid").distinct())
    found["correlated"] = {"recall": len(matched & set(truth["correlated"])) / max(1, len(set(truth["correlated"])))}
    return found


def benchmark(spark: SparkSession, folder: str, output_dir: str) -> dict:
    """Seconds of the end-to-end run over a folder, and of a second, warm one."""
    out = {}
    for name in ("cold", "warm"):
        start = time.time()
        found = pipeline.run(spark, folder, output_dir)
        out[name] = {"seconds": round(time.time() - start, 2), "transactions": found["transactions"], "alerts": found["alerts"]}
    return out
