"""Session helpers: shared storage and shipping the package to the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers, unless PYTHONPATH does so already."""
    sc = spark.sparkContext
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _PACKAGE.parent in paths or sc.applicationId in _shipped:
        return
    with tempfile.TemporaryDirectory() as d:  # Spark serves its own copy of the file to the executors
        path = os.path.join(d, f"cairn-{uuid.uuid4().hex[:8]}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(_PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(_PACKAGE.parent))
        sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or in its absence on a local master (tests) a new one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="cairn-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: computed once, and safe when executors are lost."""
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._stored_at = path
    return made


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that ``stored`` returned; nothing may read it later."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Ids are broadcast up to this number (about 64 MB with their hash table); beyond it a shuffled join does the same.
BROADCAST_IDS = 2_000_000


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``df`` semi or anti joined with the ids; they are broadcast only if their counted size allows."""
    ids = ids.select(F.col(ids.columns[0]).alias(key))
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def with_ordinals(df: DataFrame, order: list, column: str, first: int = 0) -> DataFrame:
    """Number the rows from ``first`` in the given order, or without one in that of the frame, without a window over all rows.

    The rows are range-sorted and written once; each range is numbered for itself and shifted by the sizes of those before.
    """
    made = stored((df.orderBy(*order) if order else df).withColumn("__m", F.monotonically_increasing_id()), "ordinals")
    made = made.withColumn("__p", F.shiftright("__m", 33)).withColumn("__n", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = made.groupBy("__p").count().select("__p", F.expr("sum(count) over (order by __p) - count").alias("__o"))  # a row a partition
    return made.join(F.broadcast(sizes), "__p").withColumn(column, (F.col("__o") + F.col("__n") + first).cast("long")).drop("__m", "__p", "__n", "__o")
