"""Session helpers: building a local session and cutting lineage."""

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, app: str = "vetline") -> SparkSession:
    """A session for tests and the bench; on a cluster use the one you are given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # The JVM leaves larger methods uncompiled; Spark then runs such a stage operator by operator.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Call sites of single expressions; only wanted when debugging.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, so that functions run in them can import it.

    Once per session; the driver needs no particular working directory for it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_vetline_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="vetline-code-"), "vetline.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for path in sorted(package.rglob("*.py")):
            bundle.write(path, path.relative_to(package.parent))
    sc.addPyFile(target)
    sc._vetline_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a
    cluster a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured is None and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        own = tempfile.mkdtemp(prefix="vetline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured or os.path.dirname(sc.getCheckpointDir())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for a table written in between."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def version_folder(path: str) -> str:
    """A folder of its own for the next version of what is stored at ``path``."""
    return f"{path}/version-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, folder: str) -> None:
    """Make a written version the current one, by one row appended to the list of versions.

    The row appears whole or not at all, and after everything it points to. A writer that stops
    before leaves the version before current.
    """
    listed = read_stored(spark, path, "versions")
    number = 1 + (listed[0].agg(F.max("number")).first()[0] if listed else 0)
    row = spark.createDataFrame([(number, os.path.basename(folder))], "number bigint, folder string")
    row.coalesce(1).write.mode("append").parquet(f"{path}/versions")


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the version published last; None if there is none."""
    listed = read_stored(spark, path, "versions")
    last = listed and listed[0].agg(F.max_by("folder", F.struct("number", "folder"))).first()[0]
    return f"{path}/{last}" if last else None


def write_version(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> None:
    """Write the tables into a new folder, then publish it."""
    folder = version_folder(path)
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    publish(spark, path, folder)


def read_stored(spark: SparkSession, path: str | None, *tables: str) -> list[DataFrame] | None:
    """The Parquet tables below a stored model's folder.

    None where one is missing, empty or not readable as Parquet, or without a folder. Failures that say nothing
    about the files (access denied, a lost connection) are raised.
    """
    if path is None:
        return None
    found = []
    for name in tables:
        try:
            df = spark.read.parquet(f"{path}/{name}")
            if df.isEmpty():
                return None
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        except Exception as e:
            if re.search(r"is not a Parquet file|CANNOT_READ_FILE_FOOTER|CANNOT_READ_FOOTER|FAILED_READ_FILE", str(e)):
                return None
            raise
        found.append(df)
    return found


def stored_at(spark: SparkSession, path: str) -> bool:
    """Whether there are files that Spark can list at a path."""
    try:
        return not spark.read.text(path).isEmpty()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the shared folder, and cut its lineage.

    For compact tables read more than once (counts per distinct value, distinct
    vectors), so that neither reuse nor a lost executor repeats the full scan.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    For wide tables (texts) read more than once: packed, and each reader takes only its columns.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, work: Callable, items: list) -> list:
    """Run independent Spark jobs at once, so that one fills the gaps of another."""
    with ThreadPool(len(items)) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items)
