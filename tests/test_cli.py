"""The command line, end to end."""

import os
import subprocess
import sys

import pytest
from conftest import DATA, ROOT


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_a_query_from_the_command_line(spark, tmp_path):
    out = tmp_path / "out"
    args = [sys.executable, "-m", "emberline", "value_counts", "--data", str(DATA / "sf0.001"), "--out", str(out), "--format", "json"]
    done = subprocess.run(args, cwd=ROOT, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-1500:]
    assert spark.read.json(str(out)).selectExpr("sum(n)").first()[0] == spark.read.parquet(str(DATA / "sf0.001" / "events.parquet")).count()
    bad = subprocess.run([*args[:3], "no_such_query", *args[4:]], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert bad.returncode == 2 and "invalid choice" in bad.stderr
