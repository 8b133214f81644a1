"""Tables between steps."""

import subprocess
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from tessera.llm import common


def test_shuffles_behind_a_stored_table_go(spark):
    # the JVM's own count of shuffles whose files are still there
    held = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    spark._jvm.System.gc()
    time.sleep(3)
    before = held.size()
    for k in range(4):
        assert common.stored(spark.range(100).groupBy((F.col("id") % (k + 2)).alias("x")).count()).count() == k + 2
    until = time.time() + 20
    while held.size() > before + 2 and time.time() < until:  # what the counts above have shuffled may still be there
        time.sleep(0.2)
    assert held.size() <= before + 2


#: A session that never deletes shuffles as the JVM collects them.
UNCOLLECTED = """
import sys, time
from pathlib import Path
from pyspark.sql import SparkSession, functions as F
from tessera.llm import common, substrings
folder = Path(sys.argv[1])
settings = {"spark.local.dir": f"{folder}/local", "spark.checkpoint.dir": f"{folder}/shared", "spark.cleaner.referenceTracking": "false", "spark.sql.shuffle.partitions": "3", "spark.ui.enabled": "false"}
spark = SparkSession.builder.master("local[2]").config(map=settings).getOrCreate()
held = lambda: len([*folder.glob("local/**/shuffle_*.data")])
def settled():
    until = time.time() + 10
    while held() and time.time() < until:
        time.sleep(0.2)
    return held()
for was in (None, "false", "true"):
    spark.conf.unset(common.CLEANUP) if was is None else spark.conf.set(common.CLEANUP, was)
    counts = spark.range(100).groupBy((F.col("id") % 7).alias("x")).count()
    out = common.stored(counts.repartition(3, "count"))
    assert settled() == 0, held()
    assert spark.conf.get(common.CLEANUP, None) == was
    assert sorted(r["count"] for r in out.collect()) == [14] * 5 + [15] * 2
spark.conf.unset(common.CLEANUP)
words = " ".join(f"w{i}" for i in range(80))
docs = spark.createDataFrame([(i, f"{words} {i}") for i in range(20)] + [(20, words), (21, words)], "doc_id bigint, text string")
plan = substrings.op8(docs)
assert settled() == 0, held()
assert sorted(r.n_removed for r in plan.collect()) == [0] + [80] * 21
"""


def test_shuffle_files_behind_a_stored_table_go_uncollected(tmp_path):
    done = subprocess.run([sys.executable, "-c", UNCOLLECTED, str(tmp_path)], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
