import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "a1_hotel_medians", "e2_landmark_distances"],
                         capture_output=True, text=True, env=env, timeout=600)
    lines = [l for l in out.stdout.splitlines() if l.strip()]
    d = json.loads(lines[-1])
    assert set(d) == {"metric", "value", "unit", "queries", "sf"}
    assert d["unit"] == "sec" and d["sf"] == 0.001
    assert all(v is not None for v in d["queries"].values())
