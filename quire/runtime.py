"""Session settings that every plan relies on, and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quire.errors import BadSettings

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package, and bound the rows of one Arrow batch where the session hasn't: a row may be a long text."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{have}" if have else ROOT
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default; a choice of the session's own stays
        spark.conf.set(key, "2000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a local session (tests, a laptop) may lack that setting; it gets a folder of its own. On a cluster that would be a
    folder of one machine, so there it is an error.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise BadSettings("spark.checkpoint.dir has to name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='quire-shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df under the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in paths:
        path = hadoop(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Delete the tables that `written` made in this process. DataFrames that read them can't be used any more."""
    _delete(spark, _WRITTEN)
    _WRITTEN.clear()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables that `written` makes within the block when it ends, but for those whose paths are put on the list it gives."""
    before, keep = len(_WRITTEN), []
    try:
        yield keep
    finally:
        made = [p for p in _WRITTEN[before:] if p not in keep]
        _WRITTEN[before:] = [p for p in _WRITTEN[before:] if p in keep]
        _delete(spark, made)


def delete(spark: SparkSession, path: str) -> None:
    """Delete one table that `written` made."""
    _WRITTEN.remove(path)
    _delete(spark, [path])


def last_written() -> str:
    """Where the newest table is."""
    return _WRITTEN[-1]
