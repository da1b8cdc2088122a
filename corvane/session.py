"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corvane")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give this package to the executors of a session that has it on the driver only, as a zip file that Spark serves.
    Clusters where it is installed on every machine don't need it."""
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="corvane-ship-")  # read by the driver alone
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "corvane"), "zip", os.path.dirname(here), os.path.basename(here)))
    atexit.register(shutil.rmtree, folder, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the session names one, or the context's checkpoint
    folder. A local session without either gets a temporary folder; on a cluster that would be a different folder on each
    machine, so it is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
    named = "file://" + tempfile.mkdtemp(prefix="corvane-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/corvane/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with the run's other tables."""
    _clear_at_exit(spark)
    return f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends, and a lost executor loses nothing. The folder of
    a run is removed when the driver ends, or by ``clear``."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


_CLEARED_AT_EXIT: set[str] = set()
#: Where the tables are that ``materialize`` returned, as long as somebody holds them.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialize`` returned and that nothing reads any more."""
    if path := _PATHS.pop(df, None):
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this run wrote into the shared folder. Results that weren't written elsewhere can't be read
    after that."""
    _delete(spark, _run_dir(spark))


def _clear_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext.applicationId not in _CLEARED_AT_EXIT:
        _CLEARED_AT_EXIT.add(spark.sparkContext.applicationId)
        atexit.register(_clear_quietly, spark)  # runs before the context's own exit, which was registered earlier


def _clear_quietly(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            clear(spark)
    except Exception:  # the driver is ending and may have lost its JVM
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
