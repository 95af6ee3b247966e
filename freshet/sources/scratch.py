"""Files that a query writes and reads again, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATH_OF: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share, spark.checkpoint.dir; a temporary folder where all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="spark-freshet-")
    return f"{base.rstrip('/')}/freshet-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read again: what follows is made once, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATH_OF[out] = path
    return out


def deleted(*tables: DataFrame) -> None:
    """Delete tables that ``written`` wrote, once all that reads them is written."""
    for df in tables:
        if where := _PATH_OF.pop(df, None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
