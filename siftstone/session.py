"""Session helpers: a builder with the settings the operators expect, and the
shared folder used for checkpoints and intermediate tables."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "siftstone", master: str | None = None, **conf) -> SparkSession:
    """A session with AQE, skew-join handling, UTC and Arrow on, and no web UI.

    On a cluster leave ``master`` unset; shuffle partitions start high and AQE
    coalesces them, so nothing here depends on the size of the data. The package is
    sent to the workers, where functions that run in Python import it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # reliable checkpoints go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # recording the call site of every column expression costs more than building the plan
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers (once a session)."""
    context = spark.sparkContext
    if getattr(context, "_siftstone_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="siftstone-package-")) / "siftstone.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._siftstone_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session may do without: it gets a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="siftstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder (nothing is created or deleted here)."""
    return f"{shared_folder(spark).rstrip('/')}/siftstone-{label}-{uuid.uuid4().hex}"


#: Rows of a task whose work per row is dear (regular expressions, trees).
SPREAD_ROWS = 20_000


def spread(df: DataFrame, rows: int | None = None, task_rows: int | None = None) -> DataFrame:
    """The same rows in tasks of about ``SPREAD_ROWS``: a small file is one task, however many rows it has. Few rows stay where they are."""
    tasks = math.ceil((df.count() if rows is None else rows) / (task_rows or SPREAD_ROWS))
    return df.repartition(tasks) if tasks > 1 else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
