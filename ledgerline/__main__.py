"""python -m ledgerline: ingest a root into a store, share it with other machines, report over it, explain one metric, verify totals."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

from pyspark.sql import SparkSession

from .plans.dimensions import PLAN_SCHEMA
from .plans.report import Reports, report_json, report_text, save
from .sources import prices
from .sources.ingest import Ingest
from .sources.store import Versions, upsert


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="ledgerline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("root")
    a.add_argument("store")
    a.add_argument("--run", type=int, required=True, help="number of this run")
    a.add_argument("--kind", choices=("log", "spool"), default="log")
    a.add_argument("--full", action="store_true", help="read every file from its start")
    a = sub.add_parser("report")
    a.add_argument("store")
    a.add_argument("--json", action="store_true")
    a.add_argument("--save", metavar="FOLDER")
    a = sub.add_parser("explain")
    a.add_argument("store")
    a.add_argument("metric")
    a.add_argument("--all", action="store_true", help="show every event, not the first 20")
    a = sub.add_parser("machines")
    a.add_argument("store")
    a.add_argument("folder")
    a.add_argument("--run", type=int, required=True)
    a.add_argument("--id", required=True)
    a.add_argument("--label", required=True)
    a.add_argument("--account", required=True, help="SHA-256 of the account, in hex")
    a = sub.add_parser("verify")
    a.add_argument("store")
    a.add_argument("totals", help="JSON lines of day, model, input, output, cache_read, cache_write and perhaps cost")
    a = sub.add_parser("plan-price")
    a.add_argument("month")
    a.add_argument("usd")
    a.add_argument("name")
    a.add_argument("--store", required=True)
    o = p.parse_args(argv)
    # What a run stores on its way stands beside the store: a folder that every executor that can read it shares.
    spark = SparkSession.builder.appName("ledgerline").getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", o.store.rstrip("/") + "/scratch")
    ingest = Ingest(spark, o.store)
    if o.command == "ingest":
        print(ingest.run(o.root, o.run, full=o.full, below="projects" if o.kind == "log" else "spool", kind=o.kind), "new lines")
        return 0
    if o.command == "machines":
        print(ingest.share(o.folder, o.id, o.label, o.account, o.run, datetime.now()))
        return 0
    if o.command == "plan-price":
        table = Versions(spark, f"{o.store}/plan_prices")
        new = spark.createDataFrame([prices.plan(o.month, o.usd, o.name)], PLAN_SCHEMA)
        old = table.read()
        table.write(new if old is None else upsert(old, new, ["effective_month"]))
        for r in table.read().orderBy("effective_month").toLocalIterator():
            print(r.effective_month, r.usd_per_month, r.plan_name)
        return 0
    reports = Reports(spark, tables=ingest.tables(), views=f"{o.store}/views")
    if o.command == "verify":
        off = reports.verify(spark.read.json(o.totals))
        for r in off.orderBy("day", "model", "field").toLocalIterator():
            print(f"{r.day} {r.model} {r.field}: ours {r.left_value} | theirs {r.right_value}")
        return int(not off.isEmpty())
    if o.command == "explain":
        for r in reports.explain(o.metric).orderBy("grp").toLocalIterator():
            print(f"{r.grp}: report shows {r.value} | from the events {r.resummed}" + ("" if r.agrees else " | DISAGREES"))
        for r in reports.explained_events(o.metric, None if o.all else 20).toLocalIterator():
            print(f"  {r.grp}: {r.contribution}")
        return 0
    now = datetime.now()
    text = report_json(reports, now) if o.json else report_text(reports, now)
    print(save(o.save, text, "json" if o.json else "txt", now) if o.save else text)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
