"""What a session needs: the folder all executors share, lineage cut by written tables, and the package on executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset: on one machine a temporary folder; on a cluster
    an error, since executors would write to disks that others can't read."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc._jsc.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="weir-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one, for intermediate tables. It goes when the driver's Python ends
    in good order, or by clear(); the folder of an application that was killed is named by its id."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"{shared_dir(spark)}/weir-{app}"
        atexit.register(_removed_at_end, spark, _own[app])
    return _own[app]


def clear(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application. Results that were not yet read or written are lost."""
    remove(spark, work_dir(spark))


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _removed_at_end(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone first
        remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, without the plan that led to it. Readers read only the
    columns they need."""
    spark, schema = df.sparkSession, df.schema
    path = f"{work_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application: workers need not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="weir-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{here.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(here.rglob("*.py")):
            z.write(file, file.relative_to(here.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
