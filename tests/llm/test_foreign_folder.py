"""Every training-data query on workers that have no copy of this package on their path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from rivulet.session import get_session
from rivulet.llm.queries import QUERIES
spark = get_session("local[4]", 4)
for name, query in QUERIES.items():
    query(spark, sys.argv[1]).write.format("noop").mode("overwrite").save()
    print("RAN", name, flush=True)
"""


def test_all_queries_run_away_from_the_repository(tmp_path, sf_dir):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE, sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    from rivulet.llm.queries import QUERIES

    assert out.stdout.count("RAN") == len(QUERIES), out.stdout[-500:] + out.stderr[-3000:]
