"""Merkle manifests of tables: a leaf per row, a tree per group, a tree over the groups.

Each level of a tree is one equijoin of the level with itself: the first node of every run
(slot zero) meets the nodes at the next ``arity - 1`` indices of its group (for a binary
tree that is index XOR 1), and the joined row emits the parent at index ``idx div arity``.
Proof paths are built downwards, one join a level, and a leaf's path is checked by
folding it with ``aggregate``. Leaves are numbered by ``positions`` (range partitions), so
a group with a third of all rows is spread over many tasks, and the level tables shrink by
``arity`` each round; every level is stored, so a lost executor re-reads one level.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import positions, stored

#: Fixed value of the contract: the digest of a node is SHA-256 as lowercase hex.
DIGEST_BITS = 256


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count of the value's text, ``:``, and the text
    (integers in decimal)."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of one row: H of its encoded fields, concatenated in order."""
    return F.sha2(F.concat(*[field(v) for v in values]), DIGEST_BITS)


def fold(leaf: Column, path: Column) -> Column:
    """The root reached from ``leaf`` by the (left, right) siblings of ``path``, lowest first."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), DIGEST_BITS))


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), DIGEST_BITS)


def _empty_path() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def tree(nodes: DataFrame, arity: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Trees over ``nodes`` (_g, idx, h): idx from 0 without gaps inside each group _g.

    Returns (paths, tops): paths (_g, idx, path) of the level-0 nodes, siblings lowest
    level first; tops (_g, top): the digest that remains of each group. While a group
    has several nodes, each run of ``arity`` consecutive ones (the last run may be shorter,
    even one) becomes the H of their digests; a group of one node is its own top.
    """
    if arity < 2:
        raise ValueError("arity must be at least 2")
    spark = nodes.sparkSession
    sizes = nodes.groupBy("_g").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.agg(F.max("size")).first()[0] or 0
    level = nodes.join(sizes, "_g")
    families, tops = [], [level.where("size = 1").select("_g", F.col("h").alias("top"))]
    while largest > 1:
        open_ = level.where("size > 1")
        heads = open_.where(F.col("idx") % arity == 0).select("_g", "idx", "size", F.col("h").alias("h0"))
        for j in range(1, arity):
            shifted = open_.select("_g", (F.col("idx") - j).alias("idx"), F.col("h").alias(f"h{j}"))
            heads = heads.join(shifted, ["_g", "idx"], "left")
        family = stored(heads.select("_g", F.expr(f"idx div {arity}").alias("pidx"), "size", *[f"h{j}" for j in range(arity)]), f"{label}-level")
        families.append(family)
        parent = F.sha2(F.concat(*[F.coalesce(F.col(f"h{j}"), F.lit("")) for j in range(arity)]), DIGEST_BITS)
        up = F.expr(f"cast((size + {arity - 1}) div {arity} as bigint)")
        level = family.select("_g", F.col("pidx").alias("idx"), parent.alias("h"), up.alias("size"))
        tops.append(level.where("size = 1").select("_g", F.col("h").alias("top")))
        largest = -(-largest // arity)
    # Downwards: a node's path is its own siblings, then its parent's path.
    above = None
    for family in reversed(families):
        kids = family.select(
            "_g", "pidx",
            F.explode(F.array(*[
                F.struct(F.lit(s).alias("slot"), F.col(f"h{s}").alias("h"), _join(family, range(s)).alias("left"), _join(family, range(s + 1, arity)).alias("right"))
                for s in range(arity)
            ])).alias("k"),
        ).where(F.col("k.h").isNotNull())
        own = F.array(F.struct(F.col("k.left").alias("left"), F.col("k.right").alias("right")))
        idx = (F.col("pidx") * arity + F.col("k.slot")).alias("idx")
        if above is None:
            above = stored(kids.select("_g", idx, own.alias("path")), f"{label}-path")
        else:
            parents = above.select("_g", F.col("idx").alias("pidx"), F.col("path").alias("up"))
            joined = kids.join(parents, ["_g", "pidx"], "left")
            above = stored(joined.select("_g", idx, F.concat(own, F.coalesce("up", _empty_path())).alias("path")), f"{label}-path")
    if above is None:
        above = spark.createDataFrame([], nodes.select("_g", "idx").schema).withColumn("path", _empty_path())
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return above, top


def _join(family: DataFrame, slots) -> Column:
    parts = [F.coalesce(F.col(f"h{j}"), F.lit("")) for j in slots]
    return F.concat(*parts) if parts else F.lit("")


def manifest(
    df: DataFrame, fields: Sequence[str], group: str, order: str, arity: int = 3, carry: Sequence[str] = (), label: str = "merkle"
) -> DataFrame:
    """One row per row of ``df``: the carried columns, leaf, subroot, root, path, proof_sha256.

    The leaf is ``leaf_of`` the ``fields``. Per value of ``group``, leaves go by ascending
    ``order`` (nulls first, then by leaf digest, so repeated rows are consecutive) into a tree
    of ``arity``; its top is the group's subroot. Subroots go by group (null first, then
    UTF-8 bytewise) into a tree of the same arity, whose top is the root. A leaf's path holds
    the other digests of each run it is in, up to its subroot and on to the root, as
    (left, right) strings; ``proof_sha256`` is H of them all in that order. An empty table
    gives no rows; carried columns named like a result column must be renamed first.
    """
    # Null groups sort first: the key puts "0" before "1" + the value, bytewise.
    key = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    rows = df.select(key.alias("_g"), F.col(order).alias("_o"), leaf_of([F.col(f) for f in fields]).alias("leaf"), *[F.col(c) for c in carry])
    rows = positions(rows, ["_g"], ["_o", "leaf"], f"{label}-leaves").withColumnRenamed("pos", "idx")
    leaf_paths, subroots = tree(rows.select("_g", "idx", F.col("leaf").alias("h")), arity, f"{label}-groups")
    groups = positions(subroots.select(F.lit(0).alias("_c"), "_g", "top"), ["_c"], ["_g"], f"{label}-subroots").withColumnRenamed("pos", "idx")
    group_paths, roots = tree(groups.select(F.col("_c").alias("_g"), "idx", F.col("top").alias("h")), arity, f"{label}-root")
    sub = groups.select("_g", "idx", F.col("top").alias("subroot")).join(group_paths.select("idx", F.col("path").alias("gpath")), "idx", "left")
    # One root for the whole table: a single-row table joined on a constant.
    sub = sub.withColumn("_c", F.lit(0)).join(roots.select(F.col("_g").alias("_c"), F.col("top").alias("root")), "_c").drop("_c", "idx")
    placed = rows.join(leaf_paths, ["_g", "idx"], "left").join(sub, "_g")
    path = F.concat(F.coalesce("path", _empty_path()), F.coalesce("gpath", _empty_path()))
    return placed.select(*carry, "leaf", "subroot", "root", path.alias("path")).withColumn("proof_sha256", proof_digest(F.col("path")))
