"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of some numbers, or a short vector, that a join may broadcast (at most some 2 MB).
FEW_ROWS = 10_000

#: The folder of local sessions that name none.
_LOCAL: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder will do on one machine (local
    sessions, as in tests); on a cluster executors couldn't see each other's
    files, so that is an error.
    """
    global _LOCAL
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _LOCAL = _LOCAL or f"file://{tempfile.mkdtemp(prefix='fieldglass-')}"
    return _LOCAL


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    This cuts the lineage: what follows survives lost executors without
    computing ``df`` again, and ``df`` is computed once for several uses.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldglass-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fieldglass_path = path
    return out


def by_rows(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` as a side of an equality join: broadcast if it has few rows, else joined by shuffle and sort.

    Spark decides that by a size which it takes from compressed files and from
    the columns' types, and which an explode doesn't raise, so that a table
    many times as large as the driver's memory may seem small. ``most`` is a
    bound of the rows; without it they are counted, which a written table
    answers from its footers.
    """
    return F.broadcast(df) if (df.count() if most is None else most) <= FEW_ROWS else df.hint("merge")


def dropped(df: DataFrame) -> None:
    """Deletes a work table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._fieldglass_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
