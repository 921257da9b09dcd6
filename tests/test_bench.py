"""The bench prints one JSON line with a time for each query it is given."""

import json
import os
import subprocess
import sys

from conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_times_two_queries():
    env = {**os.environ, "BENCH_SF_DIR": SF_SMALL, "BENCH_CPUS": "2", "BENCH_QUERIES": "target_stats,holdout_split", "LENDFRAME_DRIVER_MEMORY": "1g"}
    done = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    line = json.loads(done.stdout.strip().splitlines()[-1])
    assert set(line["queries"]) == {"target_stats", "holdout_split"} and line["failed"] == [] and line["sf"] == 0.001
    assert line["unit"] == "sec" and abs(line["value"] - sum(line["queries"].values())) < 0.01
