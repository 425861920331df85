"""Session settings, the shared scratch folder and table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset directory; Catalyst prunes its columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; an own one only where that is unset.

    On a cluster (a master that isn't local) the setting is required, as a machine-local
    folder would not be visible to the other machines.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = os.environ.get("PAMPERO_SCRATCH") or tempfile.mkdtemp(prefix="pampero-")
    spark.sparkContext.setCheckpointDir(own)
    return (spark.sparkContext.getCheckpointDir() or own).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; ``clear_scratch`` deletes what a session took."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    spark.sparkContext.__dict__.setdefault("_pampero_scratch", []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the tables that this session wrote to the shared folder; frames that read them can't be used after it."""
    made = spark.sparkContext.__dict__.pop("_pampero_scratch", [])
    for path in made:
        drop_path(spark, path)
    return len(made)


def written(df: DataFrame, name: str) -> DataFrame:
    """Runs the plan once, writes it to the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pampero_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes the tables behind frames of ``written`` that nothing will read again; other frames are passed over."""
    for df in frames:
        path = df.__dict__.pop("_pampero_path", None)
        if path:
            made = df.sparkSession.sparkContext.__dict__.get("_pampero_scratch", [])
            if path in made:
                made.remove(path)
            drop_path(df.sparkSession, path)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path of any Hadoop file system."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(jpath).getLength() if fs.exists(jpath) else 0


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of any Hadoop file system, if it is there."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def changed_at(spark: SparkSession, path: str) -> int:
    """The newest modification time, in milliseconds, of a path or what lies directly in it; 0 where there is none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return 0
    return max([fs.getFileStatus(jpath).getModificationTime(), *[s.getModificationTime() for s in fs.listStatus(jpath)]])


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a path of any Hadoop file system, sorted; none where there is no such path."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(jpath)) if fs.exists(jpath) else []


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Moves a path on its Hadoop file system; raises if the file system refuses."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(Path(new).getParent())
    if not fs.rename(Path(old), Path(new)):
        raise OSError(f"{old} could not be moved to {new}")


def checkpoint_id(spark: SparkSession, path: str) -> str:
    """The id that a stream's checkpoint keeps over restarts."""
    return spark.read.json(f"{path}/metadata").first()["id"]


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context: their Python workers need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_pampero_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="pampero-ship-"), "pampero.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("pampero", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._pampero_shipped = True
