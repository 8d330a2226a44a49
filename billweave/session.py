"""Session settings the operators rely on, and lineage cuts that survive lost executors."""

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a third of all rows may share one key: split it even where that costs an extra exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # texts come in rows of any length: small Arrow batches bound what a task and its Python worker hold
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
    # the JVM never compiles methods above 8000 bytes of code: let long projections be
    # generated in pieces instead of one such method
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; safe to call repeatedly."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The run's folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only a session that runs in this process alone may do without the setting; it gets a
    temporary folder. On a cluster the executors would not see one, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    run = spark.sparkContext.applicationId
    if named is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if run not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[run] = tempfile.mkdtemp(prefix="billweave-")
        named = _LOCAL_FOLDERS[run]
    return f"{named.rstrip('/')}/billweave-{run}"


def drop_intermediate(spark: SparkSession) -> None:
    """Delete what this run has written between jobs; call it when its results are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is written inside, and streams that are started inside, leave no shuffle files behind.

    Otherwise these stay until the driver happens to collect its garbage, so a query of several writes holds the files of all
    of them at once. Only for writes: a table that is collected twice would have to be shuffled twice.
    """
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute once, write to the shared folder, go on from the written table.

    Survives lost executors, runs the plan a single time (a checkpoint would run it
    twice), gives later joins true sizes to choose by, and lets go of what was shuffled for it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with shuffles_released(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
