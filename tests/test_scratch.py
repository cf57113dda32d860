"""Intermediate tables where no shared folder is configured."""

import os
import subprocess
import sys

from conftest import ROOT

BARE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from meterlake.sources.scratch import fresh_dir, shared_dir
assert shared_dir(spark) == shared_dir(spark)
where = fresh_dir(spark, "t")
spark.range(3).write.parquet(where)
assert spark.read.parquet(where).count() == 3
from __spark_entry__ import queries
for name in sys.argv[1:]:
    assert queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
"""


def test_no_configured_folder(tmp_path):
    """With an empty configuration directory the operators that write tables choose a folder themselves."""
    conf = tmp_path / "conf"
    conf.mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", BARE, "S7_line_offsets", "T4_deduplicated_stream"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
