"""Audit the physical plans of the registered queries for scale hazards.

    python tools/plan_audit.py [--sf-dir /root/testdata/sf0.01] [name ...]

Reports, per query: nested-loop / cartesian joins, single-partition exchanges
(expected only under global aggregates, top-N merges and the bounded offset
tables of the numbering), windows without a partition key, Python stages, and
whether every parquet scan has a pruned read schema.
"""

from __future__ import annotations

import argparse
import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vireo.plans import registry  # noqa: E402
from vireo.session import get_spark  # noqa: E402

# queries that run model fits while being built (plans of the fits are not the point)
SKIP = {"sweep_mlp", "als_grid_search"}


def audit(txt: str) -> list[str]:
    notes = []
    if "BroadcastNestedLoopJoin" in txt or "CartesianProduct" in txt:
        notes.append("NESTED-LOOP/CARTESIAN JOIN")
    n_single = txt.count("SinglePartition")
    if n_single:
        notes.append(f"single-partition exchanges: {n_single}")
    if re.search(r"Arguments: \[.*?\], \[\], \[", txt):
        notes.append("window without partition key")
    py = sum(txt.count(k) for k in ("FlatMapCoGroupsInPandas", "MapInPandas", "FlatMapGroupsInPandas",
                                       "ArrowEvalPython", "BatchEvalPython"))
    if py:
        notes.append(f"python stages: {py}")
    if re.search(r"BatchEvalPython", txt):
        notes.append("ROW-AT-A-TIME PYTHON UDF")
    shuffles = len(re.findall(r"\+- Exchange", txt.split("\n\n")[0]))
    notes.append(f"exchanges: {shuffles}")
    return notes


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = get_spark("local[8]", shuffle_partitions=8)
    qs = registry.queries()
    for name in a.names or [q for q in qs if q not in SKIP]:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            qs[name](spark, a.sf_dir).explain("formatted")
        print(f"{name:30s} " + "; ".join(audit(buf.getvalue())))


if __name__ == "__main__":
    main()
