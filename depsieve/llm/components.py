"""Connected components of an edge table that is too large for one machine."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long); root is the smallest node reachable.

    Alternates large stars and small stars (Kiveris et al., 2014) until only stars are left: each
    node has one edge to a smaller one, or only edges to larger ones. Each round is written to
    the shared folder; ``edges`` is read several times. Minima are aggregated map-side, and edges
    of a node of very high degree are spread by Spark's skew join. Null ends are left out.
    """
    current = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    turn = 0
    while True:
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        turn += 1
        current = stored(small.where("u <> v").distinct(), f"{label}-{turn}")
        ends = current.select("u", F.lit(1).alias("down")).union(current.select("v", F.lit(0)))
        ends = ends.groupBy("u").agg(F.sum("down").alias("down"), F.count("*").alias("edges"))
        if ends.agg(F.count_if(F.expr("down > 0 and edges > 1"))).first()[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        drop_stored(f"{label}-{turn - 1}", edges.sparkSession)
