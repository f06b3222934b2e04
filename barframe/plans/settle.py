"""Cut lineage with a written table, so lost executors re-read it and Catalyst sees its true size.

A settled table lives in the shared folder named by ``spark.checkpoint.dir``. Reading it back gives the
planner the real byte size, so a join broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``
and falls back to a shuffled, skew-split join above it. No broadcast hint is used anywhere.

All tables of an application lie in one run folder. ``release`` deletes settled tables that nothing reads any more,
``release_all`` the run folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}  # by application: the folder of a local session that has no setting


def shared_dir(spark: SparkSession) -> str:
    """The run folder of this application inside the session's shared folder."""
    configured, app = spark.conf.get(_SETTING, None), spark.sparkContext.applicationId
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {_SETTING} to a folder that the driver and every executor can reach")
        configured = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="barframe-")
    return f"{configured.rstrip('/')}/settled-{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame, sweep: bool = True) -> None:
    """Delete settled tables. Frames built on them can't be read afterwards; ones settled from them can.

    Spark drops the shuffle files of finished jobs when the driver collects garbage, which a large driver heap rarely
    does; ``sweep`` asks for it.
    """
    for t in tables:
        _delete(t.sparkSession, t.settled_path)
    if sweep and tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def release_all(spark: SparkSession) -> None:
    """Delete everything this application has settled."""
    _delete(spark, shared_dir(spark))
