"""python -m tracegrid COMMAND PLACES

run INPUT OUTPUT, alerts OUTPUT, alert OUTPUT ID, stats OUTPUT, health OUTPUT, verify OUTPUT, ledger OUTPUT, infrastructure OUTPUT,
graph OUTPUT NODE, case OUTPUT ENTITY, export OUTPUT; generate FOLDER, audit FOLDER, validate FOLDER OUTPUT, benchmark FOLDER OUTPUT.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import casefile
from .plans import answers, pipeline, validation
from .sources.generator import Generator


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["run", "alerts", "alert", "stats", "health", "verify", "ledger", "infrastructure", "graph", "case", "export", "generate", "audit", "validate", "benchmark"])
    p.add_argument("places", nargs="+")
    p.add_argument("--min-risk", type=float, default=0.0)
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("--depth", type=int, default=2)
    p.add_argument("--seed", type=int, default=42)
    a = p.parse_args()
    if a.command == "generate":
        print(json.dumps({k: len(v) for k, v in Generator(seed=a.seed).build().write(a.places[0]).items()}))
        return
    if a.command == "audit":
        print(json.dumps(validation.audit_folder(a.places[0]), indent=1))
        return
    spark = SparkSession.builder.appName("tracegrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "run":
        print(json.dumps(pipeline.run(spark, a.places[0], a.places[1])))
    elif a.command == "alerts":
        pipeline.alerts(spark, a.places[0], a.min_risk, limit=a.limit).select("alert_id", "entity", "risk", "confidence", "category", "action").show(a.limit, truncate=False)
    elif a.command == "stats":
        print(json.dumps(pipeline.stats(spark, a.places[0])))
    elif a.command == "verify":
        print(json.dumps(pipeline.verify_ledger(spark, a.places[0])))
    elif a.command in ("alert", "health", "ledger", "export"):
        answer = {"alert": answers.alert, "health": answers.health, "ledger": answers.ledger_page, "export": answers.export}[a.command]
        print(json.dumps(answer(spark, *a.places), default=str))
    elif a.command == "infrastructure":
        answers.infrastructure(spark, a.places[0]).show(a.limit, truncate=False)
    elif a.command in ("validate", "benchmark"):
        print(json.dumps(getattr(validation, a.command)(spark, *a.places), indent=1))
    elif a.command == "graph":
        pipeline.graph_around(spark, a.places[0], a.places[1], a.depth, a.limit).show(a.limit, truncate=False)
    else:
        row = pipeline.Store(spark, a.places[0]).read("alerts").where(F.col("entity") == a.places[1]).first()
        print(casefile.as_markdown(row.asDict(recursive=True)) if row else "no such alert")


if __name__ == "__main__":
    main()
