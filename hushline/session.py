"""Session helpers shared by the tests, the benchmark and interactive use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches to and from Python workers end at this size; 10,000 rows of sample arrays or texts can be far more.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20

#: For tables with rows of megabytes.  Parquet looks at its sizes every 100 rows only: without these, pages and row groups
#: of such rows hold hundreds of megabytes, in writers, readers and the codecs' buffers beside the heap.
LARGE_ROWS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "hushline") -> SparkSession:
    """Local session with settings that also make sense on a cluster (AQE and its skew handling on)."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(BATCH, str(BATCH_BYTES))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the shared place the session names in ``spark.checkpoint.dir``.

    A local session has one machine, so it may fall back on scratch space.  On a cluster the executors would write to
    disks that nobody else reads: there a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="hushline-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str = "stage", options: Mapping[str, object] | None = None) -> DataFrame:
    """Write a hand-over table once and read it back.

    Cuts lineage in storage that outlives any executor, and unlike a row checkpoint keeps columns prunable and
    sizes known to the optimizer.  Steps that read a table several times store it first.
    """
    path = f"{new_folder(df.sparkSession, purpose)}/data"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at a time, unless the session has a bound of its own."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application, whatever folder the job was started from, in bounded batches."""
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="hushline-code-"), "hushline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(home):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("hushline", os.path.relpath(path, home)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
