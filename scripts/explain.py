"""Print the executed physical plan of registered queries (after running them).

usage: python scripts/explain.py [--sf DIR] [--grep WORD ...] [name ...]
With --grep, only report which queries' plans contain each word.
"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rivulet.plans import all_queries  # noqa: E402
from rivulet.session import get_session  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--grep", nargs="*", default=None)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = get_session("local[8]")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="explain-ckpt-"))
    qs = all_queries()
    hits = {}
    for name in a.names or sorted(qs):
        df = qs[name](spark, a.sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        if a.grep is None:
            print(f"===== {name}\n{plan}")
        else:
            for w in a.grep:
                if w in plan:
                    hits.setdefault(w, []).append(name)
    if a.grep is not None:
        for w in a.grep:
            print(w, "->", hits.get(w, []))


if __name__ == "__main__":
    main()
