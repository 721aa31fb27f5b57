"""Shared folders and code shipping."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pyarrow as pa
import pytest

from hushline.session import BATCH, bound_batches, new_folder

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def stub(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            new_folder(stub(master), "x")
        assert new_folder(stub(master, "hdfs://shared/"), "x").startswith("hdfs://shared/x-")
    assert new_folder(stub("local[2]"), "x")


def test_workers_get_the_package_from_any_folder(tmp_path):
    code = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", {REPO!r} + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
print("rows", entry.queries()["t01_stft"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 6006" in out.stdout, out.stderr[-2000:]


def test_arrow_batches_are_bounded(spark):
    """Long arrays come to Python in batches of some megabytes; a session's own bound stays."""
    other = spark.newSession()
    bound_batches(other)
    assert other.conf.get(BATCH) == str(8 << 20)
    rows = other.range(0, 4000, 1, 1).selectExpr("array_repeat(cast(id as double), 1000) as x")
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert max(r["n"] for r in sizes) < 10 << 20
    own = spark.newSession()
    own.conf.set(BATCH, "1m")
    bound_batches(own)
    assert own.conf.get(BATCH) == "1m"
