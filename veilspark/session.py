"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g", **config: str) -> SparkSession:
    """A local session with the settings the library is tested under; ``config`` names further ones with ``__`` for dots."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veilspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map={k.replace("__", "."): v for k, v in config.items()})
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path under the folder all executors share (``spark.checkpoint.dir``).

    The setting is read from the session. Where it is unset, a local session
    (single-machine tests) takes a temporary folder; a cluster raises, as what
    one executor writes to a folder of its own is lost to the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = os.path.join(tempfile.gettempdir(), "veilspark")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def clear_shared(spark: SparkSession) -> int:
    """Delete what this driver's queries left in the shared folder; results that still read it must have been saved. Says how many folders went."""
    gone = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as the planner knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A file gives as many tasks as it has row groups, so a small table of few
    files is read by fewer tasks than there are cores, and what follows (regex
    passes, Python workers) is bound by the CPU. Only a table of fewer files
    than cores and of less than one full split (``spark.sql.files.maxPartitionBytes``)
    a core is dealt out. A larger one comes back unchanged however few files it
    has, so what is shuffled here is bounded by that size and no table at scale is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df if input_bytes(df) >= cores * split or len(df._jdf.inputFiles()) >= cores else df.repartition(cores)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, wherever the driver runs from."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="veilspark-")) / "veilspark.zip"  # the driver's own copy; Spark serves it to the executors
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
