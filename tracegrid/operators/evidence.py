"""Tamper-evident evidence: canonical JSON, digests, and a ledger whose entries seal their predecessors."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

GENESIS = "0" * 64
VOLATILE = ("evidence_hash", "hash_verified_at", "generated_at")


def json_safe(value: Any) -> Any:
    """The value with NaN and infinities as None, at any depth."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [json_safe(v) for v in value]
    if isinstance(value, set | frozenset):
        return sorted(json_safe(v) for v in value)
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def canonical_json(value: Any) -> str:
    return json.dumps(json_safe(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value: Any) -> str:
    data = value if isinstance(value, bytes) else value.encode() if isinstance(value, str) else canonical_json(value).encode()
    return hashlib.sha256(data).hexdigest()


def stamp(alert: dict) -> dict:
    return alert | {"evidence_hash": digest({k: v for k, v in alert.items() if k not in VOLATILE})}


def verify(alert: dict) -> bool:
    return alert.get("evidence_hash") == stamp(alert)["evidence_hash"]


def ledger(alerts: list[dict], timestamp: str) -> list[dict]:
    """Entries for the (few) ranked alerts, each sealed together with the one before."""
    out, before = [], GENESIS
    for a in alerts:
        entry = {"alert_id": a.get("alert_id"), "entity": a.get("entity"), "hash": a.get("evidence_hash"), "timestamp": timestamp, "risk_score": a.get("risk_score"), "prev_hash": before}
        before = digest(entry)
        out.append(entry | {"entry_hash": before})
    return out


def verify_ledger(entries: list[dict]) -> dict:
    """ok, entries and the 1-based places where a link or an entry's own digest doesn't hold."""
    breaks, before = [], GENESIS
    for place, e in enumerate(entries, 1):
        if e.get("prev_hash") != before:
            breaks.append((place, "link"))
        if digest({k: v for k, v in e.items() if k != "entry_hash"}) != e.get("entry_hash"):
            breaks.append((place, "entry"))
        before = e.get("entry_hash")
    return {"entries": len(entries), "ok": not breaks, "breaks": breaks, "first_break": breaks[0][0] if breaks else None}


def tampered(entries: list[dict]) -> list[dict]:
    """A copy whose middle entry says risk 0."""
    middle = len(entries) // 2
    return [e | {"risk_score": 0.0} if i == middle else e for i, e in enumerate(entries)]


# ----------------------------------------------------------------- the same over tables
def evidence_digest(columns: list[str]) -> Column:
    """The evidence hash of rows as a column: canonical JSON of the columns (texts, whole numbers, flags), without volatile ones."""
    fields = [F.col(c) for c in sorted(columns) if c not in VOLATILE]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def entry_digest(position: Column, body: Column, before: Column) -> Column:
    return F.sha2(F.concat_ws("|", position.cast("string"), body, before), 256)


def chain(rows: DataFrame, position: str, body: str) -> DataFrame:
    """(position, body, prev_hash, entry_hash) for rows numbered from 1: a fold over the (bounded) ordered array."""
    ordered = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("position"), F.col(body).alias("body")))).alias("all"))
    entry = "array<struct<position: bigint, body: string, prev_hash: string, entry_hash: string>>"
    fold = f"aggregate(all, cast(array() as {entry}), (a, x) -> concat(a, array(named_struct('position', bigint(x.position), 'body', x.body, 'prev_hash', coalesce(try_element_at(a, -1).entry_hash, '{GENESIS}'), 'entry_hash', sha2(concat_ws('|', string(x.position), x.body, coalesce(try_element_at(a, -1).entry_hash, '{GENESIS}')), 256)))))"
    return ordered.select(F.explode(F.expr(fold)).alias("e")).select("e.*")


def previous(rows: DataFrame, order: str, value: str, out: str, first, ranges: int = 64) -> DataFrame:
    """(order, out): the value of the row before in the order of a number, ``first`` for the first row.

    Rows are cut into ranges of the order; each range starts from the last value of the one before, so no task
    sees all rows.
    """
    cuts = sorted(set(rows.stat.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.005)))
    part = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, c: n + F.when(F.col(order) > c, 1).otherwise(0)) if cuts else F.lit(0)
    rows = rows.withColumn("_part", part)
    ends = rows.groupBy("_part").agg(F.max_by(value, order).alias("_last"))  # one row a range
    ends = ends.select("_part", F.lag("_last", 1, first).over(W.orderBy("_part")).alias("_before"))
    inside = rows.withColumn("_prev", F.lag(value).over(W.partitionBy("_part").orderBy(order)))
    return inside.join(ends, "_part").select(order, F.coalesce("_prev", "_before").alias(out))


def check_links(entries: DataFrame) -> DataFrame:
    """entries with link_ok (prev_hash is the entry before's hash) and entry_ok (its own digest holds)."""
    before = previous(entries.select("position", "entry_hash"), "position", "entry_hash", "_expected", GENESIS)
    out = entries.join(before, "position").withColumn("link_ok", F.col("prev_hash") == F.col("_expected")).drop("_expected")
    return out.withColumn("entry_ok", F.col("entry_hash") == entry_digest(F.col("position"), F.col("body"), F.col("prev_hash")))


def verify_join(alerts: DataFrame, entries: DataFrame) -> DataFrame:
    """alerts (alert_id, evidence_hash, computed) with the ledger's hash and a verdict."""
    e = entries.select("alert_id", F.col("hash").alias("ledger_hash"))
    verdict = F.when(F.col("ledger_hash").isNull(), "untracked").when(F.col("evidence_hash") != F.col("computed"), "altered").when(F.col("evidence_hash") != F.col("ledger_hash"), "differs").otherwise("verified")
    return alerts.join(e, "alert_id", "left").withColumn("verdict", verdict)


def untracked(alerts: DataFrame, entries: DataFrame) -> DataFrame:
    return alerts.join(entries.select("alert_id"), "alert_id", "left_anti")
