"""Queries whose workers cannot import the library: it is found by the driver's path alone."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.checkpoint.dir", {folder!r}).getOrCreate()
)
import __spark_entry__ as entry
for name in {names!r}:
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name

def there(_):
    import importlib.util
    yield importlib.util.find_spec("colloquy") is not None

assert spark.sparkContext.parallelize([0], 1).mapPartitions(there).collect() == [False]
"""


def test_workers_without_the_library(tmp_path):
    names = ["op4_sentencepiece", "op5_quality_classifier", "op11_conversation_trie", "op13_periodic_runs", "op8_chat_format"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=REPO, folder=str(tmp_path / "shared"), names=names)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
