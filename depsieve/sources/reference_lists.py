"""Popular names and known incidents."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depsieve.rules import KNOWN_BAD_SEED, POPULAR_FALLBACK, POPULAR_LIMIT
from depsieve.schemas import KNOWN_BAD_FEED, POPULAR


def popular_packages(
    spark: SparkSession, downloads: DataFrame | None = None, n: int = POPULAR_LIMIT
) -> DataFrame:
    """The ``n`` most downloaded names with their rank, or a fixed list without a table.

    ``downloads`` has package and downloads, any number of rows per package. The rank
    runs over the ``n`` rows that the top-n has left.
    """
    if downloads is None:
        rows = [(name, rank) for rank, name in enumerate(POPULAR_FALLBACK, 1)]
        return spark.createDataFrame(rows[:n], POPULAR)
    top = (
        downloads.groupBy("package")
        .agg(F.sum("downloads").alias("downloads"))
        .orderBy(F.desc("downloads"), "package")
        .limit(n)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("downloads"), "package"))
    return top.select("package", rank.cast("int").alias("rank"))


def known_bad_rows(feed: DataFrame) -> DataFrame:
    """Incident entries -> one row per (package, version), numbered by ``entry_ord``."""
    return feed.select(
        "package",
        F.explode("versions").alias("version"),
        "incident",
        "date",
        F.col("ioc.description").alias("description"),
        F.col("ioc.maliciousDependencies").alias("malicious_dependencies"),
        F.col("ioc.references").alias("references"),
        "entry_ord",
    )


def known_bad_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The incident table from a JSON feed (with ``entry_ord``), or the built-in seed."""
    if path is None:
        rows = [
            (e["package"], e["versions"], e["incident"], e["date"],
             (e["ioc"].get("maliciousDependencies"), e["ioc"]["description"], e["ioc"].get("references")), i)
            for i, e in enumerate(KNOWN_BAD_SEED)
        ]
        return known_bad_rows(spark.createDataFrame(rows, KNOWN_BAD_FEED + ", entry_ord LONG"))
    return known_bad_rows(spark.read.schema(KNOWN_BAD_FEED + ", entry_ord LONG").json(path))
