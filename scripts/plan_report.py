"""One line per registered query summarising its physical plan.

usage: python scripts/plan_report.py [sf_dir] [name ...]

Columns: shuffle exchanges, broadcast exchanges, join strategies, Python stages
(Arrow / pandas), and whether any Cartesian or nested-loop join appears.  Building a query
may run its eager size checks; the query itself is not executed.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

sys.path.insert(0, ".")


def summarise(plan: str) -> dict:
    lines = plan.splitlines()
    joins = Counter(m.group(1) for l in lines for m in [re.search(r"(\w+Join)\b", l)] if m and "Exchange" not in l)
    return {
        "shuffles": sum(1 for l in lines if re.search(r"\bExchange (hash|range|RoundRobin|SinglePartition)", l)),
        "broadcasts": sum(1 for l in lines if "BroadcastExchange" in l),
        "joins": dict(joins),
        "python": sum(1 for l in lines if re.search(r"ArrowEvalPython|MapInArrow|MapInPandas|BatchEvalPython|FlatMapGroupsInPandas", l)),
        "cartesian": any(k in plan for k in ("CartesianProduct", "BroadcastNestedLoopJoin")),
        "window_group_limit": "WindowGroupLimit" in plan,
    }


def main() -> None:
    from groundeval.plans.catalog import load_all
    from groundeval.session import get_spark

    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = get_spark()
    reg = load_all()
    for name in names or sorted(reg):
        df = reg[name].build(spark, sf_dir)
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        print(f"{name:28s} shuffles={s['shuffles']:2d} broadcasts={s['broadcasts']:2d} python={s['python']} "
              f"wgl={int(s['window_group_limit'])} cartesian={int(s['cartesian'])} joins={s['joins']}")


if __name__ == "__main__":
    main()
