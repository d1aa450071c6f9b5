"""Session helpers: settings for local runs, and durable cuts of the lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "panelforge", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    session = builder.getOrCreate()
    if session.sparkContext.getCheckpointDir() is None:  # long fits cut their lineage there
        session.sparkContext.setCheckpointDir(f"{shared_folder(session)}/checkpoints")
    return session


def ship(spark: SparkSession) -> str:
    """Send this package to the Python workers of a cluster on which it is not installed; returns the archive."""
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "panelforge.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(home):
            for name in (n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(home)))
    spark.addArtifact(path, pyfile=True) if hasattr(spark, "_client") else spark.sparkContext.addPyFile(path)
    return path


_MADE: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it; a session without one (a test) uses a
    folder below its warehouse. On a cluster neither may be local storage of
    one machine, so a warehouse without a scheme is refused there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not re.fullmatch(r"local(\[[^,\]]*(,\s*\d+)?\])?", spark.sparkContext.master) and not re.match(r"(?!file:)\w+://", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse.rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; :func:`clear_scratch` removes all that a session asked for."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application, once their results are written or read."""
    _delete(spark, _MADE.pop(spark.sparkContext.applicationId, []))


def discard(spark: SparkSession, path: str) -> None:
    """Delete one scratch table early, which nothing reads any more."""
    _MADE[spark.sparkContext.applicationId].remove(path)
    _delete(spark, [path])


def _delete(spark: SparkSession, paths: Sequence[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in map(jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder of the cluster and read it back.

    Cuts the lineage, survives the loss of executors, and lets later passes
    read only the columns they need.

    Also used for an aggregate that is about to be joined to many rows. The
    planner takes an aggregate to be as large as its input and would shuffle
    the many rows to meet it; of the written copy it knows the size. It
    broadcasts the copy if that is below the limit of the session, and joins by
    a shuffle otherwise, where adaptive execution splits skewed keys. ``path``
    is for a copy that :func:`discard` is to delete.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "durable")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(tasks: Sequence[Callable[[], object]], most: int = 4) -> list:
    """Run independent fits at the same time, so that one fills the gaps between the jobs of another."""
    session = SparkSession.active()
    with ThreadPoolExecutor(most) as pool:
        started = [pool.submit(inheritable_thread_target(session)(task)) for task in tasks]
        return [s.result() for s in started]


def by_group(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partition by the keys of a grouped Python function, which then needs no other shuffle.

    Adaptive execution sizes partitions by bytes and would put many small but
    slow groups into one task; a given number of partitions stays as it is. It
    is twice the usual one, to even out the groups.
    """
    from panelforge.binding import col

    n = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[col(k) for k in keys])


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal the rows out to ``partitions`` tasks before a slow Python function; None leaves them as they are."""
    return df if partitions is None else df.repartition(partitions)
