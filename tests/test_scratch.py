"""Scratch tables go when the driver's process ends, whether the session was stopped before or not."""

import os
import subprocess
import sys
import time
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
from pyspark.sql import SparkSession
from tidelog.sources.scratch import cut
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{folder}").getOrCreate()
assert cut(spark.range(3)).count() == 3
from pathlib import Path
assert list(Path("{folder}").glob("tidelog-*/*"))
{end}
"""


@pytest.mark.parametrize("end", ["spark.stop()", "pass"])
def test_scratch_tables_go(tmp_path, end):
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    subprocess.run([sys.executable, "-c", CODE.format(folder=tmp_path, end=end)], check=True, env=env, capture_output=True)
    for _ in range(100):
        if not list(tmp_path.glob("tidelog-*")):
            break
        time.sleep(0.1)
    assert not list(tmp_path.glob("tidelog-*"))
