"""Physical-plan census of every registered query.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md

Automatic broadcasting is switched off so that every data-sized side is
planned as it would be at 100 TB; only broadcasts of literal dimensions
remain.  Gold tables are not written, so each plan holds the whole build.  For each query it counts hash/range/single-partition exchanges,
broadcasts, bucketed scans and scans with pushed filters.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nextbest.plans import registry  # noqa: E402
from nextbest.plans.models import Models  # noqa: E402
from nextbest.session import build_session  # noqa: E402

# their plans start from an ALS fit
FITTED = ("als_top3", "hybrid_recs_als", "als_run_metrics")


def _distinct(plan: str, marker: str) -> int:
    """Distinct physical operators (by plan id) whose line contains ``marker``;
    a subquery printed once per reference still counts once."""
    ids = set()
    for ln in plan.split("\n"):
        if marker in ln:
            m = re.search(r"plan_id=(\d+)", ln)
            ids.add(m.group(1) if m else ln.strip())
    return len(ids)


def census(plan: str) -> dict[str, int]:
    scans = {ln.strip() for ln in plan.split("\n") if "FileScan" in ln}
    return {
        "hash_exchanges": _distinct(plan, "Exchange hashpartitioning"),
        "range_exchanges": _distinct(plan, "Exchange rangepartitioning"),
        "single_partition": _distinct(plan, "Exchange SinglePartition"),
        "broadcasts": _distinct(plan, "BroadcastExchange"),
        "scans": len(scans),
        "tables": len({m for ln in scans for m in re.findall(r"(\w+)\.parquet", ln)}),
        "bucketed_scans": sum("Bucketed: true" in s for s in scans),
        "scans_with_pushed_filters": sum(bool(re.search(r"PushedFilters: \[[^\]]", s)) for s in scans),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 16)
    registry.load_all()
    # nothing is written: a query's plan shows the builds of the gold tables it reads
    models = Models(spark, sf, materialize_models=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = []
    for name, fn in sorted(registry.MODEL_QUERIES.items()):
        if name in FITTED:
            continue
        plan = fn(models)._jdf.queryExecution().executedPlan().toString()
        rows.append((name, census(plan)))
    cols = list(rows[0][1])
    print("# Physical-plan census (automatic broadcast off)\n")
    print("Generated by `tools/plan_report.py` at " + sf + ". Exchange counts are per initial physical plan; "
          "identical exchanges are reused by AQE at run time.\n")
    print("| query | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---" for _ in cols) + " |")
    for name, c in rows:
        print(f"| {name} | " + " | ".join(str(c[k]) for k in cols) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
