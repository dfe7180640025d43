"""Session defaults and the shared folder for tables that cut a lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Temporary folders of local masters without spark.checkpoint.dir.
_local: list[str] = []


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; settings given by the cluster are kept."""
    b = SparkSession.builder.appName("emberframe")
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return b.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor can reach.

    Only where the setting is missing, as in tests on one machine, a temporary folder
    is made; a cluster without the setting is refused.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if at is None and held.isDefined():
        return held.get()
    if at is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _local.append(tempfile.mkdtemp(prefix="emberframe-"))
        at = "file://" + _local[-1]
    if held.isEmpty():
        sc.setCheckpointDir(at)
    return at


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    It cuts the lineage like checkpoint(), but keeps columns prunable, filters pushable and
    sizes known. A lost executor costs only the tasks it ran: the files stay. They are
    removed when the driver ends, or before by `discard`.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"emberframe-{uuid.uuid4().hex}")
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a table from `materialize` that nothing will read again, such as a round's once the next is written."""
    path = _path_of.pop(df, None)
    if path is not None:
        _delete(df.sparkSession, path)
        _made.remove((df.sparkSession, path))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that never broadcasts either side.

    Spark takes a table for as large as its compressed files, and counts no rows that an explode adds: a side that it
    takes for a few MB may be a hundred times that in the driver, which builds what is broadcast.
    """
    return df.hint("merge")


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the gateway may be gone already
            break
    for path in _local:
        shutil.rmtree(path, ignore_errors=True)
