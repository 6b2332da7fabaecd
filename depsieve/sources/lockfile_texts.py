"""Lockfiles in the root folders of projects."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsieve.rules import LOCKFILE_NAMES
from depsieve.sources.packages import below


def read_lockfiles(spark: SparkSession, folder: str) -> DataFrame:
    """``<project>/<lockfile>`` texts; anything deeper or named otherwise is not read.

    ``kind_ord`` gives the order in which a project's lockfiles are reported.
    """
    names = ",".join(LOCKFILE_NAMES)
    raw = spark.read.text(f"{folder.rstrip('/')}/*/{{{names}}}", wholetext=True)
    kinds = F.array(*[F.lit(n) for n in LOCKFILE_NAMES])
    path = below(F.col("_metadata.file_path"), folder)
    return raw.select(path.alias("path"), F.make_valid_utf8("value").alias("content")).select(
        F.substring_index("path", "/", 1).alias("project"),
        "path",
        F.substring_index("path", "/", -1).alias("file_name"),
        "content",
        (F.array_position(kinds, F.substring_index("path", "/", -1)) - 1).cast("int").alias("kind_ord"),
    )
