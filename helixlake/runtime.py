"""What every operator needs of the session: tables, a shared folder, lineage cuts and a size check before a broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest relation, in bytes of its optimised plan, that ``broadcast_if_small`` marks for a broadcast.
BROADCAST_BYTES = 32 << 20


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per context, wherever they run and whatever their path is."""
    sc = spark.sparkContext
    if getattr(sc, "_helixlake_shipped", False):
        return
    sc._helixlake_shipped = True
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="helixlake-"), f"{root.name}-{uuid.uuid4().hex}.zip")
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))  # the driver serves it to the executors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local master may fall back to a folder of this machine."""
    sc = spark.sparkContext
    if (set_ := spark.conf.get("spark.checkpoint.dir", None)) or (set_ := sc.getCheckpointDir()):
        return set_
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = Path(tempfile.mkdtemp(prefix="helixlake-")).as_uri()
    sc.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the plan is run once, written to the shared folder and read from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = shared_dir(df.sparkSession)
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, as a compressed columnar table: for frames of which later steps read some columns only."""
    spark = df.sparkSession
    path = scratch(spark, f"helixlake-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for a broadcast if the optimiser's size estimate is within ``limit``, else unchanged (a shuffled join follows)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
