"""The shared folder: which one it is, what is kept there, and that nothing is left."""

import os
import subprocess
import sys

import pytest

from conftest import ROOT

CODE = """
import sys
from pyspark.sql import SparkSession
from tessera import runtime
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setCheckpointDir(sys.argv[1])
assert runtime.shared_dir(spark).startswith("file://" + sys.argv[1]), runtime.shared_dir(spark)
kept = runtime.Kept(spark, "t")
assert kept.put("a", spark.range(5)).count() == 5 and runtime.cut(spark.range(3)).count() == 3
kept.drop("a")
runtime.close(spark)
"""


def test_the_contexts_folder_is_used_and_left_empty(tmp_path):
    subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], check=True, env=os.environ | {"PYTHONPATH": ROOT}, timeout=120)
    assert [f for _, _, files in os.walk(tmp_path) for f in files] == []


def test_a_cluster_without_a_shared_folder_is_refused():
    from tessera import runtime

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session)
