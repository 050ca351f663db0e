"""Summarise the executed (final adaptive) plans of the headline queries into PLANS.md.

For each query: shuffles (exchanges) and how many AQE reused, sort-merge and
broadcast joins, Python evaluation nodes, and every file scan with its read
schema and pushed filters.  Usage: python tools/plan_summary.py [sf_dir]
"""
import re
import sys

sys.path.insert(0, ".")
from bench import HEADLINE  # noqa: E402
from varilens.plans import catalog  # noqa: E402
from varilens.session import local_session  # noqa: E402


def final_plan(df) -> str:
    qe = df._jdf.queryExecution()
    qe.toRdd().count()  # run this very plan, so the adaptive plan is final
    text = qe.executedPlan().toString()
    if "== Final Plan ==" in text:  # keep the final part only, not the initial plan printed after it
        text = text.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    return text


def summarise(plan: str) -> dict:
    lines = plan.splitlines()
    count = lambda pat: sum(1 for l in lines if re.search(pat, l))
    scans = []
    for l in lines:
        if "FileScan" in l:
            table = re.search(r"/([a-z_]+)\.parquet", l)
            schema = re.search(r"ReadSchema: (struct<.*>)\s*$", l)
            pushed = re.search(r"PushedFilters: (\[[^\]]*\])", l)
            scans.append((table.group(1) if table else "?", schema.group(1) if schema else "?",
                          pushed.group(1) if pushed else "[]"))
    return {
        "shuffles": count(r"\bExchange hashpartitioning|\bExchange RoundRobin|\bExchange rangepartitioning|\bExchange SinglePartition"),
        "reused": count(r"ReusedExchange"),
        "smj": count(r"SortMergeJoin"),
        "bhj": count(r"BroadcastHashJoin"),
        "python": count(r"ArrowEvalPython|MapInPandas|MapInArrow|BatchEvalPython"),
        "scans": scans,
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, shuffle_partitions=16)
    out = ["# PLANS", "", f"Executed (final adaptive) plans of the headline queries at `{sf}` "
           "(`python tools/plan_summary.py`). Exchanges include the round-robin spread of single-row-group test files.",
           "", "| query | shuffles | reused | SMJ | BHJ | Python nodes | scans (table: read schema, pushed filters) |",
           "|---|---|---|---|---|---|---|"]
    for name in HEADLINE:
        s = summarise(final_plan(catalog.QUERIES[name](spark, sf)))
        scans = "<br>".join(f"{t}: `{r}` {p}" for t, r, p in s["scans"])
        out.append(f"| {name} | {s['shuffles']} | {s['reused']} | {s['smj']} | {s['bhj']} | {s['python']} | {scans} |")
    with open("PLANS.md", "w") as f:
        f.write("\n".join(out) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
