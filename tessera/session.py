"""Session, table access and materialisation shared by the whole library."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, name: str = "tessera") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset (tests), one is made."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, so a lost executor costs a re-read and not a re-run."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    for scope in _scopes[-1:]:
        scope.append(out)
    return out


#: What ``settle`` calls that have not ended have written.
_scopes: list[list[DataFrame]] = []


def settle(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``materialize`` what ``make`` gives, then remove the tables and shuffle files that it left on the way."""
    _scopes.append(mine := [])
    try:
        out = materialize(make(), label)
    finally:
        _scopes.pop()
    release(*[t for t in mine if t is not out])
    for scope in _scopes[-1:]:
        scope.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Remove a table written by ``materialize`` once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Remove tables written by ``materialize``, and let Spark delete the shuffle files of steps that have ended: it does so
    when the driver collects its garbage, which may be long after executors' disks are full."""
    for t in tables:
        discard(t)
    gc.collect()  # Python holds on to the driver's objects
    spark = SparkSession.getActiveSession()
    if spark:
        spark.sparkContext._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """Let executors and driver collect their garbage and give the heap that is free then back to the system: a JVM keeps what
    an earlier step has grown. A few tasks a core, so that no executor is left out; an executor whose cores are busy is at work."""
    release()
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def ship(spark: SparkSession) -> None:
    """Let the executors' Python import the package: where their path lacks it, it goes along as a zip."""
    home = Path(__file__).resolve().parent.parent
    if any(Path(p or ".").resolve() == home for p in [*os.environ.get("PYTHONPATH", "").split(":"), "."]):
        return
    if str(home) not in getattr(spark.sparkContext, "_tessera_shipped", ()):
        target = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera_code.zip"
        with zipfile.ZipFile(target, "w") as out:
            for f in sorted(home.glob("tessera/**/*.py")):
                out.write(f, f.relative_to(home))
        spark.sparkContext.addPyFile(str(target))
        spark.sparkContext._tessera_shipped = (str(home),)
