"""Session helper, table loader, and shipping of this package to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "corpusloom") -> SparkSession:
    """A local session with the settings that the queries expect (ANSI, UTC, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="corpusloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def read_table(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """One of the driver's parquet tables, with only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir; where that is unset, a temporary one on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(shared_folder, "own", None)
        if root is None:
            root = shared_folder.own = tempfile.mkdtemp(prefix="corpusloom-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what lies there is removed when the Python process ends, unless the session has
    ended before."""
    path = f"{shared_folder(spark)}/corpusloom-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """*df* as a table written to the shared folder, for results that are dear and read more than once."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        if sc._jsc is not None:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


#: Bytes of input of one partition.
_SPLIT = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """*df* over at least as many partitions as there are cores, for steps that cost far more CPU than a shuffle of
    their input.  What has more by its files and their size is left as it is; nothing is planned as an RDD or run."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if max(len(df.inputFiles()), size // _SPLIT) >= cores else df.repartition(cores)
