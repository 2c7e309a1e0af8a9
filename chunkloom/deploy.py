"""What a session needs before a query runs: the package on the executors, and Arrow batches of moderate size."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch, where the session has Spark's own defaults: texts are long rows.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_DEFAULT_ROWS = "10000"
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors (once per application) and bound Arrow batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "chunkloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; only in local mode a folder of this machine may stand in."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "chunkloom")
    return at.rstrip("/")


def prepared(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``query`` (spark, ...) after prepare(spark)."""

    @wraps(query)
    def run(spark: SparkSession, *args, **more) -> DataFrame:
        prepare(spark)
        return query(spark, *args, **more)

    return run
