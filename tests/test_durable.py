"""Written tables: where they lie and when they go."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest
from conftest import ROOT

from emberline.plans import durable


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, named=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    for master in ("spark://h:7077", "yarn", "k8s://h", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            durable.shared_dir(session(master))
        assert durable.shared_dir(session(master, "hdfs://x/y")) == "hdfs://x/y"
    assert durable.shared_dir(session("local[4]")).startswith("file://")


RUN = """
import sys
from pyspark.sql import SparkSession
from emberline.plans import durable
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
a, b = durable.written(s.range(5)), durable.written(s.range(7))
durable.dropped(a)
import os
folder = os.path.join(sys.argv[1], "emberline", s.sparkContext.applicationId)
assert b.count() == 7 and len(os.listdir(folder)) == 1, os.listdir(folder)
durable.release(s)
assert not os.path.exists(folder)
assert durable.written(s.range(3)).count() == 3 and len(os.listdir(folder)) == 1
"""


def test_tables_of_a_named_folder_are_removed(tmp_path):
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    for _ in range(50):  # the JVM ends a moment after Python
        if not os.listdir(tmp_path / "emberline"):
            break
        import time

        time.sleep(0.2)
    assert os.listdir(tmp_path / "emberline") == []
