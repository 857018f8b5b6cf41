"""Physical-plan summary of every registered query (final adaptive plan):
exchanges by kind, joins, sort-based aggregates, Python evaluation and the
columns each scan reads.  Writes a markdown table.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracehound.plans import catalog  # noqa: E402
from tracehound.session import get_session  # noqa: E402


def summarize(plan: str) -> dict:
    final = plan.split("== Initial Plan ==")[0]
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", final)
    return {
        "hash": final.count("Exchange hashpartitioning"),
        "range": final.count("Exchange rangepartitioning"),
        "single": final.count("Exchange SinglePartition"),
        "bhj": final.count("BroadcastHashJoin"),
        "smj": final.count("SortMergeJoin"),
        "shj": final.count("ShuffledHashJoin"),
        "sortagg": final.count("SortAggregate"),
        "objagg": final.count("ObjectHashAggregate"),
        "window": len(re.findall(r"\bWindow\b", final)),
        "python": ("ArrowEvalPython" in final) or ("BatchEvalPython" in final) or ("FlatMapGroupsInPandas" in final),
        "topk": final.count("TakeOrderedAndProject"),
        "reused": final.count("ReusedExchange"),
        "scans": "; ".join(str(len(s.split(","))) for s in scans),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[4]", shuffle_partitions=8)
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    print(f"# Physical plans ({os.path.basename(sf_dir)}, final AQE plans)\n")
    print("hash/range/single = shuffle exchanges by partitioning; reused = exchanges reused by another branch; BHJ/SMJ/SHJ = broadcast-hash / sort-merge / "
          "shuffled-hash joins; sort-agg = sort-based aggregates (struct-valued min/max); obj-agg = aggregates with collected lists; cols = columns read per scan.\n")
    print("| query | hash | range | single | reused | BHJ | SMJ | SHJ | sort-agg | obj-agg | window | top-k | python | cols per scan |")
    print("|---|---|---|---|---|---|---|---|---|---|---|---|---|---|")
    for name, q in catalog.REGISTRY.items():
        df = q(spark, sf_dir)
        df.collect()    # runs the DataFrame's own plan, so AQE finalises it
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        print(f"| {name} | {s['hash']} | {s['range']} | {s['single']} | {s['reused']} | {s['bhj']} | {s['smj']} | {s['shj']} | "
              f"{s['sortagg']} | {s['objagg']} | {s['window']} | {s['topk']} | {'yes' if s['python'] else 'no'} | {s['scans']} |")


if __name__ == "__main__":
    main()
