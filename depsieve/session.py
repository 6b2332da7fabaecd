"""Session settings and the shared working folder."""

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the plans in this library rely on. None depends on data size.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Objects with repeated keys are read as ECMAScript does: the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# What a Python worker holds at once: the usual 10,000 rows of whole files are hundreds of MB.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

_local_folders: dict[str, str] = {}
_of_thread = threading.local()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that is already running."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "depsieve", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
    )
    for key, value in {**RUNTIME_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="depsieve-")
    return _local_folders[context.applicationId]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/depsieve/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside hands its Python workers batches of bounded size."""
    before = {key: spark.conf.get(key, None) for key in BATCH_CONF}
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a small relation distilled from a very large one has several readers:
    the large one is then read once, and an executor that is lost later costs a
    re-read of the small table, never of the source.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    if (paths := getattr(_of_thread, "paths", None)) is not None:
        paths.append(path)
    with small_batches(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


@contextlib.contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``materialize`` has written inside it, in this thread.

    For work that repeats for ever, such as micro-batches; its results must be written by then.
    """
    outer = getattr(_of_thread, "paths", None)
    _of_thread.paths = []
    try:
        yield
    finally:
        for name in _of_thread.paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _of_thread.paths = outer
