"""Session helpers: defaults, shared storage and shipping the package to executors."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


#: Of written tables. Ids are hashes in hex, of which this halves the bytes and Spark's default hardly any.
COMPRESSION = "zstd"
#: Spark's setting by which a query's shuffle files go when it ends, not when the driver's memory is next collected.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_DROPPING = threading.Lock()
_dropping: dict[int, list] = {}


def local_session(master: str = "local[*]", partitions: int = 8, **extra: str) -> SparkSession:
    """A session with the engine's defaults; a cluster passes its own settings instead."""
    builder = SparkSession.builder.master(master).config(map=DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions)})
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application.

    Python workers unpickle functions by module name; they may run on machines, or in
    folders, where the package isn't on the path.
    """
    context = spark.sparkContext
    if getattr(context, "_loomgraph_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph_src.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._loomgraph_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session that runs in this process (master local or local[...]) gets a folder of its own;
    any other must name one, as its executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_loomgraph_shared", None)
        if found is None:
            found = spark.sparkContext._loomgraph_shared = f"file://{tempfile.mkdtemp(prefix='loomgraph-shared-')}"
    return found.rstrip("/")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in shared storage; its folder is deleted when the application ends."""
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target)
    system.deleteOnExit(target)
    return f"{folder}/data"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df once to shared storage and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with shuffles_dropped(spark):
        df.write.option("compression", COMPRESSION).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomgraph_path = path
    return out


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind; the session's own setting comes back with the last of nested and parallel uses."""
    with _DROPPING:
        uses = _dropping.setdefault(id(spark), [0, None])
        if not uses[0]:
            uses[1] = spark.conf.get(DROP_SHUFFLES, None)
            spark.conf.set(DROP_SHUFFLES, "true")
        uses[0] += 1
    try:
        yield
    finally:
        with _DROPPING:
            uses[0] -= 1
            if not uses[0]:
                del _dropping[id(spark)]
                spark.conf.unset(DROP_SHUFFLES) if uses[1] is None else spark.conf.set(DROP_SHUFFLES, uses[1])


def discard(df: DataFrame) -> None:
    """Deletes the table that `cut` wrote for this DataFrame, once nothing reads it any more."""
    path = getattr(df, "_loomgraph_path", None)
    if path is not None:
        drop_path(df.sparkSession, path.rsplit("/", 1)[0])


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of shared storage through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
