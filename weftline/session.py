"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from weftline.errors import ParametersError


def build_session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on and UTC timestamps; ``conf`` overrides any setting."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return b.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only in local mode, where the setting may be absent, a temporary folder of
    this process is taken instead; on a cluster its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ParametersError(f"set spark.checkpoint.dir to a folder that all nodes of {master} share")
    own = getattr(spark, "_weftline_shared", None)
    if own is None:
        path = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        own = f"file://{path}"
        spark._weftline_shared = own
        spark.sparkContext.setCheckpointDir(own)
    return own


#: Folders that ``materialise`` wrote, by application, until they are released.
_written: dict[str, list[str]] = {}


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int):
    """Within the block, what is executed exchanges Arrow batches of at most so many rows with Python."""
    return _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    A lost executor then costs a re-read, never a recomputation, and the files
    stay readable from every node. They stay until ``release``. What was shuffled
    on the way is deleted once they are written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of some tables that ``materialise`` returned, when nothing that reads them is left to run."""
    for df in tables:
        spark, path = df.sparkSession, df._weftline_path
        paths = _written.get(spark.sparkContext.applicationId, [])
        if path in paths:
            paths.remove(path)
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(spark: SparkSession) -> int:
    """How many folders are to be released; pass it to ``release`` to go back to this point."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, but_last: bool = False) -> None:
    """Delete what ``materialise`` has written since a point, when no result that reads it is needed any more.

    ``but_last`` keeps the newest folder, as the result of a stage that has been written.
    """
    paths = _written.get(spark.sparkContext.applicationId, [])
    gone = paths[since : len(paths) - but_last]
    del paths[since : len(paths) - but_last]
    jvm = spark._jvm
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
