"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored, whole_text

PREFIX_CHARS = 128


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, the carried columns, keep_id, group_size, kept.

    Texts are equal when they are the same after lower-casing A-Z. Rows are first grouped
    by length, those in shared lengths by the hash of their first characters, and only rows
    that still have company get a hash (SHA-256) of their whole text. Of equal texts the row
    with the largest id stays.

    Null texts count as empty; null ids rank below all others. Of rows that repeat text and
    id, one stays. A row alone in its length or prefix is its own group. No rows in, no rows
    out. Carried columns named like a result column must be renamed by the caller.
    """
    raw = whole_text(text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.octet_length(raw).alias("_len"),
        F.xxhash64(lower_ascii(F.substring(raw, 1, PREFIX_CHARS))).alias("_prefix"),
        raw.alias("_text"),
        *[F.col(c) for c in carry],
    )
    # Lower-casing A-Z keeps the number of bytes, so the first group needs no text at all.
    lengths = rows.groupBy("_len").count().where("count > 1").select("_len")
    prefixes = rows.join(lengths, "_len", "left_semi").groupBy("_len", "_prefix").count().where("count > 1")
    prefixes = stored(prefixes.select("_len", "_prefix", F.lit(True).alias("_shared")), "op9-prefixes")
    full = F.when(F.col("_shared"), F.unhex(F.sha2(lower_ascii(F.col("_text")).cast("binary"), 256)))
    thin = rows.join(prefixes, ["_len", "_prefix"], "left").select("doc_id", *carry, full.alias("_full"))
    thin = stored(thin.withColumn("_row", F.monotonically_increasing_id()), "op9-rows")

    alone = thin.where("_full is null").select(
        "doc_id", *carry, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    # Counts and the last row are pre-aggregated, so a text in a third of all rows is no hot group.
    last = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"), F.col("doc_id").alias("own"), F.col("_row"))
    groups = (
        thin.where("_full is not null")
        .groupBy("_full")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(last).alias("_last"))
        .select("_full", "group_size", F.col("_last.own").alias("keep_id"), F.col("_last._row").alias("_keep_row"))
    )
    met = thin.where("_full is not null").join(groups, "_full")
    return alone.unionByName(
        met.select("doc_id", *carry, "keep_id", "group_size", (F.col("_row") == F.col("_keep_row")).alias("kept"))
    )
