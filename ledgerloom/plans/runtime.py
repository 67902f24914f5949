"""Session helpers: shared storage for intermediate tables, and shipping this package to the executors.

Intermediate tables are the only way this library cuts a lineage. They are ordinary Parquet folders below
``spark.checkpoint.dir``, the folder that a cluster's driver and executors share, so a lost executor never
takes the only copy of a stage with it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


def shared_root(spark: SparkSession) -> str:
    """Folder that all executors see. A local folder is made up only for a one-process local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = f"file://{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, label: str) -> str:
    """A folder name below the shared root that nothing else uses."""
    return f"{shared_root(spark)}/ledgerloom/{uuid.uuid4().hex}/{label}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the result has no lineage beyond those files."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def drop(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target.getParent(), True)


#: Bytes of the batches that go to Python workers, where the session does not say: a task holds several copies of one.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, however the driver came to import it."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH[0], None) is None:
        spark.conf.set(*_BATCH)
    if getattr(context, "_ledgerloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    archive = os.path.join(folder, "ledgerloom_src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    context.addPyFile(archive)
    context._ledgerloom_shipped = True


def publish(spark: SparkSession, body: bytes, path: str, replace: bool = False) -> None:
    """A small file that readers see whole or not at all: written beside its name, then renamed to it.

    Without ``replace`` an existing file stays and FileExistsError is raised; with it the old file is there until the new
    one takes its place. Both are one step where the file system renames in one step, as shared ones that Spark commits to do.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    final, part = hadoop.Path(path), hadoop.Path(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}.part")
    files = final.getFileSystem(conf)
    out = files.create(part, False)
    out.write(bytearray(body))
    out.close()
    if files.getUri().getScheme() == "file":
        _publish_here(Path(part.toUri().getPath()), Path(final.toUri().getPath()), replace)
        return
    option = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE if replace else option.NONE
    try:
        hadoop.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(part), files.makeQualified(final), options)
    except Exception as e:
        files.delete(part, False)
        if not replace and files.exists(final):
            raise FileExistsError(path) from e
        raise


def _publish_here(part: Path, final: Path, replace: bool) -> None:
    """The same on a local file system, whose renames through Hadoop take several steps. Files without a checksum beside them are read as they are."""
    for f in (part, *([final] if replace else [])):
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    try:
        if replace:
            os.replace(part, final)
        else:
            os.link(part, final)  # fails if it is there
    finally:
        part.unlink(missing_ok=True)
