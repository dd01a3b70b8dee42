"""A plain local session, without any setting of the machine, runs what writes stages."""

import os
import subprocess
import sys
import time

from lanewright import session

PLAIN = """
from pyspark.sql import SparkSession
import __spark_entry__ as entry_module
from lanewright.session import materialize, shared_folder

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {warehouse!r}).getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(spark).endswith("/_stages")
assert entry_module.entry(spark).count() == 10
assert materialize(spark.range(5)).count() == 5
assert entry_module.queries()["current_snapshot"](spark, "/root/testdata/sf0.001").count() == 1
"""


def test_plain_local_session(tmp_path):
    (tmp_path / "conf").mkdir()
    code = PLAIN.format(warehouse=str(tmp_path / "warehouse"))
    made = subprocess.run([sys.executable, "-c", code], env={**os.environ, "SPARK_CONF_DIR": str(tmp_path / "conf")}, capture_output=True, text=True, cwd=os.getcwd())
    assert made.returncode == 0, made.stderr[-2000:]


ENTRY_WITHOUT = """
import sys
sys.modules["ahocorasick"] = None
import __spark_entry__ as entry_module
names = entry_module.queries()
assert "recommend" in names and "op9_url_filter" not in names
"""


def test_entry_without_an_optional_library():
    made = subprocess.run([sys.executable, "-c", ENTRY_WITHOUT], capture_output=True, text=True, cwd=os.getcwd())
    assert made.returncode == 0, made.stderr[-2000:]


def test_a_stage_leaves_no_shuffle_files(spark):
    """They would lie there until the driver happens to collect its garbage."""
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    before, setting = files(), spark.conf.get(session.CLEANUP, None)
    made = session.materialize(spark.range(2000).repartition(3).groupBy("id").count())
    deadline = time.time() + 20
    while any(name.startswith("shuffle_") for name in files() - before) and time.time() < deadline:
        time.sleep(0.2)
    assert not [name for name in files() - before if name.startswith("shuffle_")]
    assert made.count() == 2000 and spark.conf.get(session.CLEANUP, None) == setting
    session.release(made, None, spark.range(1))
    assert not os.path.exists(made._stage.removeprefix("file:"))
