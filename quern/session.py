"""Session helpers: shipping the package to Python workers, shared scratch tables, dealing out small inputs."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Inputs below this many bytes for each core may come in fewer splits than there are cores.
SMALL = 8 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run; once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="quern-"), "quern.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quern", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._quern_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a temporary folder in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), f"quern-scratch-{os.getuid()}")


#: Tables that results may still be read from; they go when the process ends.
_made: list[tuple[SparkSession, str]] = []


def write_table(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut lineage: df as Parquet in the shared folder, read again. Returns it and its path."""
    path = f"{shared_folder(spark)}/quern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again; drop() removes it before the process ends."""
    out, out.settled_at = write_table(df.sparkSession, df, name)
    return out


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table of write_table() that no later read needs."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made[:] = [x for x in _made if x[1] != path]


def drop(df: DataFrame) -> None:
    drop_table(df.sparkSession, df.settled_at)


@atexit.register
def _tidy() -> None:
    for spark, path in list(_made):
        try:
            if spark.sparkContext._jsc is not None:
                drop_table(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone
            return


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input over all cores: a file of one row group is one task otherwise.

    Inputs of SMALL bytes a core or more have splits enough and are returned as they are, so nothing large is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SMALL * cores else df
