"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: The stand-in folder of each local application without a setting, and where materialized tables lie.
_LOCAL: dict[str, str] = {}
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the setting is absent (a local session, as in tests) a
    temporary folder stands in for it and is removed at exit.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="grainery-")
        atexit.register(shutil.rmtree, _LOCAL[application], ignore_errors=True)
    return _LOCAL[application]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/grainery/{uuid.uuid4().hex}/{label}"


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recompute.
    """
    path = new_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again; other tables are left alone."""
    for table in tables:
        if (path := _WRITTEN.pop(table, None)) is not None:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
