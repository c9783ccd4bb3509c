"""Arrow UDF queries must work when the driver runs from another directory
(Python workers cannot import the package from the working directory)."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
q = E.queries()
n = q["A15_gae"](spark, "/root/testdata/sf0.001").count() + q["V6_countdown_score"](spark, "/root/testdata/sf0.001").count()
print("ROWS", n)
spark.stop()
"""


def test_udf_queries_from_other_cwd(tmp_path):
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), capture_output=True, text=True, timeout=600)
    assert r.returncode == 0, r.stderr[-2000:]
    assert "ROWS" in r.stdout
