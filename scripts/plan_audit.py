"""Summarise the physical plan of every registered query.

usage: python scripts/plan_audit.py [sf_dir] [--no-broadcast]

Prints a Markdown table: executed shuffles (by key), reused exchanges, joins
by strategy, scans, and a flag for any cartesian / nested-loop join.  With --no-broadcast, Spark may not
broadcast any side, which is how the plans look when every table is far above
the broadcast threshold (the 100 TB case).
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")
from ridelens.plans import registry  # noqa: E402
from ridelens.session import build_session  # noqa: E402

WRITES = {"csv_roundtrip", "merge_shards", "export_page", "export_all_pages", "driver_summary_stored",
          "panel_signups_stored", "panel_daily_rides_usd_stored", "panel_user_funnel_stored"}  # these store something when called


def summarise(plan: str) -> dict:
    executed = "\n".join(line for line in plan.splitlines() if "ReusedExchange" not in line)
    exchanges = re.findall(r"\bExchange (hashpartitioning\([^)]*\)|rangepartitioning|SinglePartition)",
                           executed)
    keys = sorted({re.sub(r"#\d+L?|, \d+\)$", "", e).replace("hashpartitioning(", "(") for e in exchanges})
    return {
        "shuffles": len(exchanges),
        "single": sum(e == "SinglePartition" for e in exchanges),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "scans": plan.count("FileScan parquet"),
        "reused": plan.count("ReusedExchange"),
        "bad": any(k in plan for k in ("CartesianProduct", "BroadcastNestedLoopJoin")),
        "keys": keys,
    }


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf_dir = args[0] if args else "/root/testdata/sf0.1"
    extra = {"spark.sql.adaptive.enabled": "false"}
    if "--no-broadcast" in sys.argv:
        extra["spark.sql.autoBroadcastJoinThreshold"] = "-1"
    spark = build_session(extra=extra)
    print("| query | shuffles | reused | single-partition | SMJ | BHJ | scans | cartesian/BNLJ | shuffle keys |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in registry.queries().items():
        if name in WRITES:
            continue
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        print(f"| {name} | {s['shuffles']} | {s['reused']} | {s['single']} | {s['smj']} | {s['bhj']} | {s['scans']} | "
              f"{'YES' if s['bad'] else 'no'} | {'; '.join(s['keys'])} |")
    spark.stop()


if __name__ == "__main__":
    main()
