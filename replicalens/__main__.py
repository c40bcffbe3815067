"""python -m replicalens status|memory|transfer|similar|nudge|doctor|index|bootstrap --local DIR --hub DIR [--state FILE]: reports.

Only ``index --apply`` and ``bootstrap --apply`` write: the indexes of the local folders, and the first state with the
projects' coverage records. Exit codes: 0 fine, 1 error, 2 halt.
"""

from __future__ import annotations

import argparse
import datetime
import os
import socket
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import records
from .plans.replica import ReplicaPair, report
from .sources import sinks, state


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="replicalens", description=__doc__)
    parser.add_argument("what", choices=["status", "memory", "transfer", "similar", "nudge", "doctor", "index", "bootstrap"])
    for name in ("--local", "--hub"):
        parser.add_argument(name, required=True)
    parser.add_argument("--state")
    parser.add_argument("--source", choices=["local", "hub"], default="hub")
    parser.add_argument("--project")
    parser.add_argument("--ignore", action="append", default=[])
    parser.add_argument("--threshold", type=float, default=0.25)
    parser.add_argument("--apply", action="store_true")
    a = parser.parse_args(args)
    if not os.path.isdir(a.hub):
        print("halt: mount-missing")
        return 2
    spark = SparkSession.builder.getOrCreate()
    try:
        pair = ReplicaPair(spark, a.local, a.hub, state.load(a.state) if a.state else None)
        if pair.record and a.what != "bootstrap" and (halts := pair.anomalies().collect()):
            print("\n".join(f"halt: {r.code}" for r in halts))
            return 2
        mine = lambda t: t.where(F.col("project_key") == a.project) if a.project else t
        if a.what == "status":
            print(report(mine(pair.plan()), "sid"))
        elif a.what == "memory":
            print(report(mine(pair.memory_plan()), "name"))
        elif a.what == "transfer":
            print(report(mine(pair.transfer(a.source)), "sid"))
        elif a.what == "similar":
            for r in mine(pair.similar(a.threshold)).orderBy("project_key", F.desc("score"), "a", "b").collect():
                print(f"  - {r.project_key}: {r.a} ~ {r.b} ({r.score})")
        elif a.what == "nudge":
            found = pair.nudge().first()
            if found.updates or found.conflicts:
                print(f"{found.updates} to update, {found.conflicts} to merge")
        elif a.what == "index":
            made = mine(pair.indexes("local"))
            print(report(made.withColumn("name", F.lit("MEMORY.md")), "name", "status"))
            if a.apply:
                new = made.where("status IN ('created', 'rebuilt')").select("project_key", F.lit("MEMORY.md").alias("name"), "content")
                sinks.write_texts(new, a.local, "memory")
        elif a.what == "bootstrap":
            record = pair.first_record(a.ignore)
            print("\n".join(f"  - {p}: {len(record['local_sessions'][p])} here, {len(n)} on the hub" for p, n in sorted(record["known_sessions"].items())))
            if a.apply and a.state:
                now = datetime.datetime.now(datetime.UTC).isoformat().replace("+00:00", "Z")
                sinks.write_texts(records.coverage_files(pair.bound(), socket.gethostname() or "unknown", now), a.hub, ".tombstones", replace=False)
                state.save(a.state, record)
        else:
            mine(pair.health()).orderBy("project_key").show(1000, False)
    except (state.CorruptState, ValueError) as e:
        print(f"error: {e}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
