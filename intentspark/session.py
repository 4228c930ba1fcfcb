"""Session construction and the shared scratch/checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "intentspark",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None, input_bytes: int | None = None,
                  cores: int | None = None) -> SparkSession:
    """A session with the settings this library is tuned for.

    AQE stays on so shuffle partition counts and skewed joins are re-planned
    at run time; the UI is off (no server is opened). Give ``input_bytes``
    and ``cores`` to size partitions for the run (:func:`scale_settings`).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
    }
    if input_bytes and cores:
        conf.update(scale_settings(input_bytes, cores))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scale_settings(input_bytes: int, cores: int, partition_bytes: int = 128 << 20) -> dict:
    """Settings for a run over ``input_bytes`` of input on ``cores`` cores.

    Shuffle partitions start at about one per ``partition_bytes`` of input
    (at least three waves of tasks), and AQE coalesces them to its advisory
    size at run time or splits skewed ones, so a partition fits an
    executor's memory at any scale. For 100 TB on 8,000 cores this gives
    about 800,000 initial partitions; AQE coalesces what the data does not
    need.
    """
    shuffle = max(3 * cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir`` (or an already-set context checkpoint
    folder). Only a local-mode session without either gets a fresh folder of
    its own; a cluster session without one is an error, because a folder on
    one machine is not visible to the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError(
                f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="intentspark-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    # the context appends a random sub-folder; use what it reports
    return (sc.getCheckpointDir() or configured).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared folder for an intermediate table."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: computed once
    however often it is read, kept when executors are lost, nothing cached."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so plain Python can open a local test path."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)


_SHIPPED: set[str] = set()
SHIP_CONF = "spark.intentspark.shipPackage"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers (once per context).

    Workers import it to run generators and to keep per-process caches
    (a model loaded once per worker). Local sessions ship it by default; on a
    cluster install it on the executors (or pass it with ``--py-files``), or
    set ``spark.intentspark.shipPackage=true`` to ship it from the driver.
    """
    sc = spark.sparkContext
    default = "true" if _is_local(spark) else "false"
    if spark.conf.get(SHIP_CONF, default).lower() == "false":
        return
    ident = sc.applicationId
    if ident in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="intentspark-pyfiles-", dir="/tmp")
    zpath = os.path.join(out_dir, "intentspark.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(ident)


def local_table(spark: SparkSession, rows, schema) -> DataFrame:
    """A small DataFrame from driver-side rows (dimension tables, model
    metadata). Goes through pandas and Arrow, so no Python worker has to
    start to deserialize it."""
    import pandas as pd
    from pyspark.sql import types as T
    if not isinstance(schema, T.StructType):
        raise TypeError("schema must be a StructType")
    pdf = pd.DataFrame(list(rows), columns=schema.fieldNames())
    return spark.createDataFrame(pdf, schema)
