"""Session settings, scratch space and table materialisation."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: dict[str, str] = {}
_shipping = threading.Lock()


def configure(spark: SparkSession) -> SparkSession:
    """Set the session options that results depend on; sizing stays with the caller.

    Arrow batches are bounded in bytes, so that long texts do not fill a Python worker.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a folder of the
    application beside the warehouse is taken, which executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root; nothing is ever overwritten."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts lineage for iterative jobs: a lost executor re-reads files instead of
    recomputing the joins behind ``df``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str) -> DataFrame:
    """An aggregate that will be joined, as a written table of known size.

    The planner broadcasts it when its files are below the broadcast threshold and
    otherwise shuffles, where adaptive execution splits hot keys. Left unwritten, its
    size would be guessed from its input and the large side shuffled for nothing.
    """
    return materialize(df, name)


def parallelism(spark: SparkSession) -> int:
    """Partitions for CPU-bound work, whose input may be small in bytes."""
    return max(spark.sparkContext.defaultParallelism,
               int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the executors, once per application.

    Arrow functions are pickled by reference, so workers must be able to import them
    wherever the driver was started from. Fits run side by side, and a file that is added
    twice at once fails, so one thread ships and the others wait for it.
    """
    context = spark.sparkContext
    with _shipping:
        if _shipped.get("application") != context.applicationId:
            package = Path(__file__).parent
            target = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
            with zipfile.ZipFile(target, "w") as archive:
                for module in sorted(package.rglob("*.py")):
                    archive.write(module, module.relative_to(package.parent))
            context.addPyFile(str(target))
            _shipped["application"] = context.applicationId
    return spark
