"""The shared folder and the entry module."""

import os
import subprocess
import sys
import time
from pathlib import Path

import pytest

from weftline.errors import ParametersError
from weftline.session import materialise, release, shared_dir, written

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_release(spark):
    at = written(spark)
    a, b = materialise(spark.range(3), "a"), materialise(spark.range(4), "b")
    assert written(spark) == at + 2
    release(spark, at, but_last=True)
    assert written(spark) == at + 1 and b.count() == 4
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        a.collect()
    release(spark, at)
    assert written(spark) == at


def test_what_a_table_shuffled_goes_with_its_writing(spark):
    where = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {str(p) for d in where for p in Path(d).rglob("shuffle_*.data")}
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    was = spark.conf.get(key)
    a = materialise(spark.range(1000).repartition(3, "id"), "a")
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and a.count() == 1000 and spark.conf.get(key) == was


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        @staticmethod
        def get(key, default):
            return default

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(ParametersError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_the_library_stands_without_the_language_operators():
    code = "import sys; sys.modules['weftline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not [k for k in q if k.startswith('op1')]; print(len(q)); print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0 and "left out" in out.stderr and int(out.stdout.split()[0]) > 90
