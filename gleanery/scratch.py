"""Shared scratch space: every intermediate table lives where all executors can read it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []
_ROOTS: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset a private one in local mode, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        if not _LOCAL_DIR:
            _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="gleanery-"))
        named = _LOCAL_DIR[0]
    return named.rstrip("/")


def _root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = (spark, f"{shared_dir(spark)}/gleanery-{app}")
    return _ROOTS[app][1]


def write_shared(df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at the files. ``by`` is a column of folders."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns]), path


def drop_shared(spark: SparkSession, path: str) -> None:
    """Delete a table of ``write_shared`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def arrow_schema(ddl: str):
    """The Spark schema of ``ddl`` and its Arrow twin for ``mapInArrow`` output."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = T._parse_datatype_string(ddl)
    return spark_schema, to_arrow_schema(spark_schema)


@atexit.register
def _clean() -> None:
    for spark, root in _ROOTS.values():
        try:
            drop_shared(spark, root)
        except Exception:  # the session may be gone already; the folder is the cluster's to purge
            pass


__all__ = ["arrow_schema", "drop_shared", "shared_dir", "write_shared"]
