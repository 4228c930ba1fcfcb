"""Write PLANS.md: the physical plan shape of every registered query.

Usage: python tests/plan_report.py [sf_dir] > PLANS.md
Plans are taken with AQE off (the static plan Spark starts from; AQE may
then coalesce partitions, split skewed ones or switch a join to broadcast).
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def shape(plan: str) -> dict:
    scans = []
    for line in plan.splitlines():
        if "FileScan" in line:
            rs = re.search(r"ReadSchema: (struct<[^>]*>)", line)
            pf = re.search(r"PushedFilters: (\[[^\]]*\])", line)
            tbl = re.search(r"\[file:[^\]]*/([^/\]]+)\.parquet\]", line)
            scans.append(f"{tbl.group(1) if tbl else '?'} {rs.group(1) if rs else ''}"
                         + (f" pushed {pf.group(1)}" if pf and pf.group(1) != "[]" else ""))
    body = plan.split("InMemoryRelation")[0]
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)", body)),
        "single": len(re.findall(r"Exchange SinglePartition", body)),
        "broadcasts": body.count("BroadcastExchange"),
        "python": len(re.findall(r"MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython", body)),
        "codegen": len(set(re.findall(r"\*\((\d+)\)", body))),
        "top_n": "TakeOrderedAndProject" in body,
        "scans": sorted(set(scans)),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    import __spark_entry__ as E
    from intentspark.session import build_session
    spark = build_session("local[8]", shuffle_partitions=16)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    out = ["# PLANS", "",
           f"Physical plan shape of every registered query at `{sf_dir}` (static plan, AQE off; generated by",
           "`tests/plan_report.py`). *Shuffles* counts exchanges in the query's own plan (a cached model table's",
           "plan is not repeated); *single* is how many of them gather into one partition (only ever above a",
           "partial aggregate or a top-n); *codegen* is the number of whole-stage-codegen stages.", "",
           "| Query | shuffles | single | broadcasts | Python nodes | codegen stages | top-n | scans (read schema, pushed filters) |",
           "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    for name, fn in E.queries().items():
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        s = shape(plan)
        out.append(f"| `{name}` | {s['shuffles']} | {s['single']} | {s['broadcasts']} | {s['python']} | "
                   f"{s['codegen']} | {'yes' if s['top_n'] else ''} | {'; '.join(s['scans'])} |")
    print("\n".join(out))


if __name__ == "__main__":
    main()
