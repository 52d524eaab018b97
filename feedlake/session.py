"""Session settings and the one way this package cuts a lineage."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "feedlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    ``forceOptimizeSkewedJoin`` lets AQE split a hot join key even where the split costs
    one more shuffle further down.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(module: str) -> None:
    """Send the functions of ``module`` to the Python workers by value, so executors need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Taken from the session. Only a local session without one gets a temporary folder;
    on a cluster a machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="feedlake-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, and later readers still get column
    pruning and filter pushdown.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.feedlake_path = path
    return table


def release(table: DataFrame) -> None:
    """Delete a table ``materialize`` wrote; nothing may read it afterwards."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.feedlake_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep_partitions(df: DataFrame) -> DataFrame:
    """Reliable checkpoint that also keeps the partitions and the row order inside them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
