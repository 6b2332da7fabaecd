"""Look-alike package names."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depsieve.functions.text import round2, utf16_length
from depsieve.rules import (
    TYPOSQUAT_MATCHES_KEPT,
    TYPOSQUAT_MAX_DISTANCE,
    TYPOSQUAT_MIN_SIMILARITY,
)
from depsieve.schemas import alert_rows, details

BROADCAST_NAMES = 1000


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must to tell."""
    return df.limit(rows + 1).count() <= rows


def _letters(name: Column) -> Column:
    """The set of characters of a name, folded into the 64 bits of a long."""
    one = F.lit(1).cast("long")
    return F.aggregate(
        F.split(name, ""),
        F.lit(0).cast("long"),
        lambda seen, char: seen.bitwiseOR(F.call_function("shiftleft", one, F.ascii(char) % 64)),
    )


def _similarity(max_distance: int) -> Column:
    distance = F.levenshtein("package", "popular", max_distance)
    return 1 - distance / F.greatest("package_units", "popular_units")


def _may_be_alike(max_distance: int) -> Column:
    """Cheap bounds: an edit changes the length by at most one, and takes at most one
    character out of the set of characters and puts at most one in."""
    ours, theirs = F.col("package_letters"), F.col("popular_letters")
    missing = lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b))) <= max_distance
    near = F.abs(F.col("package_length") - F.col("popular_length")) <= max_distance
    return near & missing(ours, theirs) & missing(theirs, ours)


def _are_alike(max_distance: int, min_similarity: float) -> Column:
    """The bounded distance is -1 beyond the bound and 0 for equal names."""
    return (F.levenshtein("package", "popular", max_distance) > 0) & (_similarity(max_distance) >= min_similarity)


def _alike(max_distance: int, min_similarity: float) -> Column:
    """Whether two names are near and, for their length, similar enough; cheap tests first,
    as one condition, so that the optimizer keeps this order."""
    return _may_be_alike(max_distance) & _are_alike(max_distance, min_similarity)


def _judged(alike: DataFrame, max_distance: int) -> DataFrame:
    return alike.select(
        "package",
        "popular",
        "rank",
        F.levenshtein("package", "popular", max_distance).alias("distance"),
        round2(_similarity(max_distance)).alias("similarity"),
    )


def _measured(side: DataFrame, name: str) -> DataFrame:
    """Everything the pair tests need of one name, worked out once per name."""
    return side.select(
        "*",
        F.length(name).alias(f"{name}_length"),
        utf16_length(F.col(name)).alias(f"{name}_units"),
        _letters(F.col(name)).alias(f"{name}_letters"),
    )


def _sides(names: DataFrame, popular: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct names and the popular list.

    Names are few bytes but much work each, so they are spread over a fixed number of
    tasks; adaptive execution would merge them into very few by size.
    """
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = names.select("package").distinct().repartition(tasks, "package")
    listed = popular.select(F.col("package").alias("popular"), "rank").distinct()
    return distinct, listed


def typosquat_pairs(
    names: DataFrame,
    popular: DataFrame,
    max_distance: int = TYPOSQUAT_MAX_DISTANCE,
    min_similarity: float = TYPOSQUAT_MIN_SIMILARITY,
    broadcast_names: int = BROADCAST_NAMES,
) -> DataFrame:
    """Pairs of a name and a different popular name within the edit distance.

    A popular list of up to ``broadcast_names`` names (counted first) is compared with
    every name in place; a longer one goes through ``typosquat_pairs_blocked``.
    """
    if not fits(popular, broadcast_names):
        return typosquat_pairs_blocked(names, popular, max_distance, min_similarity)
    left, right = _sides(names, popular)
    alike = _alike(max_distance, min_similarity)
    found = _measured(left, "package").join(F.broadcast(_measured(right, "popular")), alike)
    return _judged(found, max_distance)


def _deletion_keys(name: Column, max_distance: int, min_similarity: float) -> Column:
    """Hashes of all strings left after dropping up to d characters.

    d is the largest distance at which a name of this length can still be similar
    enough to another, so short names get few keys.
    """

    def drop_one(state: Column) -> Column:
        # Later drops only at or after the last one, so each choice is made once.
        text, start = state["text"], state["start"]
        return F.transform(
            F.sequence(start, F.greatest(F.length(text), start)),
            lambda i: F.struct(
                F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))).alias("text"),
                i.alias("start"),
            ),
        )

    level = F.array(F.struct(name.alias("text"), F.lit(1).alias("start")))
    keys = [F.array(F.xxhash64(name))]
    for d in range(1, max_distance + 1):
        # Similarity is by UTF-16 units; d more characters are up to 2 * d units.
        reachable = F.lit(1.0) - F.lit(float(d)) / (utf16_length(name) + 2 * d) >= min_similarity
        level = F.when(reachable, F.flatten(F.transform(level, drop_one)))
        hashed = F.transform(level, lambda state: F.xxhash64(state["text"]))
        keys.append(F.coalesce(hashed, F.array().cast("ARRAY<LONG>")))
    return F.array_distinct(F.concat(*keys))


def typosquat_pairs_blocked(
    names: DataFrame,
    popular: DataFrame,
    max_distance: int = TYPOSQUAT_MAX_DISTANCE,
    min_similarity: float = TYPOSQUAT_MIN_SIMILARITY,
) -> DataFrame:
    """``typosquat_pairs`` as an equi-join, for two large sides.

    Two strings within distance d share a string after at most d deletions on each
    side (the deletion-neighbourhood index of FastSS). The join is on 8-byte hashes of
    those strings; a pair that meets by hash accident fails the distance test.
    """
    left, right = _sides(names, popular)
    key = lambda c: F.explode(_deletion_keys(F.col(c), max_distance, min_similarity)).alias("key")
    # Lengths and letters are worked out once per name, before its keys multiply it.
    ours, theirs = (_measured(side, c).select("*", key(c)) for side, c in ((left, "package"), (right, "popular")))
    met = ours.join(theirs, "key").where(_may_be_alike(max_distance))
    # A pair meets on many keys: it is made one row first, and only then are distances
    # worked out. The units come out of the aggregation, so that test can't be moved below it.
    pairs = met.groupBy("package", "popular", "rank").agg(
        F.max("package_units").alias("package_units"), F.max("popular_units").alias("popular_units")
    )
    exact = F.when(F.col("package_units") + F.col("popular_units") >= 0, _are_alike(max_distance, min_similarity))
    return _judged(pairs.where(exact), max_distance)


def typosquat_alerts(
    pairs: DataFrame, keep: int = TYPOSQUAT_MATCHES_KEPT, requests: DataFrame | None = None
) -> DataFrame:
    """One alert per suspicious name, or per requested version of it.

    Nearest matches first, equal distances in popularity order; the best match sets
    severity and message.
    """
    rank = F.row_number().over(Window.partitionBy("package").orderBy("distance", "rank"))
    best = (
        pairs.withColumn("place", rank)
        .where(F.col("place") <= keep)
        .groupBy("package")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("place", F.col("popular").alias("name"), "distance", "similarity")
                )
            ).alias("matches")
        )
    )
    if requests is None:
        suspects = best.withColumn("version", F.lit(None).cast("string"))
    else:
        suspects = requests.select("package", "version").distinct().join(best, "package")
    top = F.col("matches")[0]
    message = F.concat(
        F.lit('Potential typosquat of popular package "'), top["name"],
        F.lit('" (distance: '), top["distance"].cast("string"), F.lit(")"),
    )
    listed = F.transform(
        "matches", lambda m: F.struct(m["name"].alias("package"), m["distance"], m["similarity"])
    )
    return alert_rows(
        suspects,
        "typosquat",
        F.when(top["distance"] == 1, "high").otherwise("medium"),
        message,
        details(suspicious_matches=listed, target_package=F.col("package")),
    )
