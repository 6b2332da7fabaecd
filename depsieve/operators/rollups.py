"""From hits to one alert per package version and detector."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depsieve.functions.entropy import shannon_entropy
from depsieve.functions.text import round2, utf16_length
from depsieve.operators.content import (
    ENTROPY,
    FAMILIES,
    FILESYSTEM,
    INSTALL,
    MANIFEST_PATH,
    NETWORK,
    SHELL,
    family_array,
    tagged_hit,
    unfold,
)
from depsieve.operators.files import in_walk, source_files
from depsieve.operators.install import script_alerts
from depsieve.rules import ENTROPY_MIN_UNITS, ENTROPY_THRESHOLD, SHELL_HITS_KEPT
from depsieve.schemas import alert_rows, details
from depsieve.session import materialize

PART_LIMIT = 1000
_SALTS = 64


def pack_in_parts(
    rows: DataFrame, keys: list[str], order: str, limit: int = PART_LIMIT
) -> DataFrame:
    """Collect the ``order`` column of each group into sorted arrays of bounded size.

    Returns keys, part, total and items. A group of up to ``limit`` rows gives one row
    (part 0). A larger one is cut into consecutive ranges of ``limit`` rows: part 0 holds
    the first ones, and all parts one after another are the whole group in order.

    Ranks of large groups are found in two steps, so no task holds a whole one: rows are
    range-partitioned by order and ranked inside their range, and the sizes of the ranges
    before are added. The rows are written once, as they are read for sizes and for arrays.
    """
    rows = materialize(rows, "packing")
    sizes = rows.groupBy(*keys).agg(F.count(order).alias("total"))
    large = sizes.where(F.col("total") > limit).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(order), F.lit(_SALTS)).cast("int"))
    collected = F.sort_array(F.collect_list(order)).alias("items")
    small = salted.join(large, [*keys, "salt"], "left_anti").groupBy(*keys).agg(collected)
    small = small.select(*keys, F.lit(0).cast("long").alias("part"), F.size("items").cast("long").alias("total"), "items")

    spread = salted.join(large, [*keys, "salt"]).where(F.col(order).isNotNull()).select(*keys, order, "total")
    spread = spread.repartitionByRange(*keys, order).withColumn("range", F.spark_partition_id())
    spread = materialize(spread, "ranges")
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        spread.groupBy(*keys, "range")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .drop("n")
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "range").orderBy(order)) + F.col("before")
    parts = (
        spread.join(before, [*keys, "range"])
        .withColumn("part", F.floor((rank - 1) / limit))
        .groupBy(*keys, "part")
        .agg(F.max("total").alias("total"), collected)
    )
    return small.unionByName(parts).withColumn("part", F.col("part").cast("int"))


# --- entropy ---------------------------------------------------------------------


def char_entropy(texts: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """Entropy of each text, next to its key columns."""
    keys = [key] if isinstance(key, str) else key
    return texts.select(*keys, shannon_entropy(F.col(text)).alias("entropy"))


def _at_least(text: Column, units: int) -> Column:
    """UTF-16 length of at least ``units``; only texts with fewer code points are counted in full."""
    return (F.length(text) >= units) | (utf16_length(text) >= units)


def obfuscated_files(
    files: DataFrame, threshold: float = ENTROPY_THRESHOLD, min_units: int = ENTROPY_MIN_UNITS
) -> DataFrame:
    """Code files of at least ``min_units`` UTF-16 units whose entropy exceeds ``threshold``."""
    long_enough = source_files(files).where(_at_least(F.col("content"), min_units))
    return (
        char_entropy(long_enough, ["package", "version", "path"], "content")
        .where(F.col("entropy") > threshold)
        .select("package", "version", F.col("path").alias("file"), round2(F.col("entropy")).alias("entropy"))
    )


# --- distinct hits ---------------------------------------------------------------


def file_hits(
    files: DataFrame,
    families: tuple[str, ...] = FAMILIES,
    threshold: float = ENTROPY_THRESHOLD,
    min_units: int = ENTROPY_MIN_UNITS,
) -> DataFrame:
    """One pass over the files: a row per file and distinct hit, for all families at once.

    (package, version, family, path, rule_ord, pos, hit, text, value); ``value`` is the
    entropy of a high-entropy file, ``text`` the command of an install script.
    """
    path, content = F.col("path"), F.col("content")
    # The key tests are those a later join would push down on one of its sides only,
    # which would make two scans of what is one.
    keyed = F.col("package").isNotNull() & F.col("version").isNotNull() & content.isNotNull()
    walked = in_walk(path, "hidden_pruned") | in_walk(path, "git_pruned")
    if INSTALL in families:
        walked = walked | (path == MANIFEST_PATH)
    base = files.where(keyed & walked).select("package", "version", "path", "content")
    hits = family_array(path, content, families)
    value = F.lit(None).cast("double")
    if ENTROPY in families:
        measured = F.when(in_walk(path, "hidden_pruned") & _at_least(content, min_units), content)
        base = base.withColumn("entropy", shannon_entropy(measured))
        flagged = F.array(tagged_hit(ENTROPY, F.lit(0), F.lit(0), path))
        hits = F.concat(hits, F.filter(flagged, lambda _: F.col("entropy") > threshold))
        value = F.when(F.col("family") == ENTROPY, F.col("entropy"))
    kept = [c for c in base.columns if c != "content"]
    return unfold(base.select(*kept, hits.alias("hits"))).select(
        "package", "version", "family", "path", "rule_ord", "pos", "hit", "text", value.alias("value")
    )


def distinct_hits(hits: DataFrame) -> DataFrame:
    """Each distinct hit of a package version with its first occurrence.

    The grouping key holds the hit itself, so one huge package version is spread over
    all tasks, and repeats are merged before the shuffle.
    """
    seen = F.struct("path", "rule_ord", "pos", "hit", "text", "value")
    return hits.groupBy("package", "version", "family", "hit").agg(F.min(seen).alias("seen"))


def _of(source: DataFrame, family: str) -> DataFrame:
    """Distinct hits of one family, from distinct hits or from package files."""
    if "seen" in source.columns:
        return source.where(F.col("family") == family)
    return distinct_hits(file_hits(source, (family,)))


def _pattern_alerts(source: DataFrame, family: str, alert_type: str, message: str) -> DataFrame:
    packed = pack_in_parts(_of(source, family), ["package", "version"], "seen")
    detail = details(patterns=F.col("items.hit"), count=F.col("total"))
    return alert_rows(packed, alert_type, "medium", message, detail, part=F.col("part"))


# --- alerts: each takes package files, or distinct hits worked out before --------


def network_alerts(source: DataFrame) -> DataFrame:
    return _pattern_alerts(source, NETWORK, "network_access", "Package makes network requests")


def filesystem_alerts(source: DataFrame) -> DataFrame:
    return _pattern_alerts(source, FILESYSTEM, "filesystem_access", "Package accesses the filesystem")


def shell_alerts(source: DataFrame, keep: int = SHELL_HITS_KEPT) -> DataFrame:
    """The first ``keep`` distinct hits of each version, and how many there are in all.

    Spark trims each task's output to ``keep`` rows per version before the shuffle
    (WindowGroupLimit), and the count is summed up from partial counts.
    """
    hits = _of(source, SHELL)
    keys = ["package", "version"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("seen"))
    first = (
        hits.withColumn("rank", rank)
        .where(F.col("rank") <= keep)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("seen")).alias("items"))
    )
    counts = hits.groupBy(*keys).agg(F.count("seen").alias("total"))
    detail = details(patterns=F.col("items.hit"), count=F.col("total"))
    return alert_rows(first.join(counts, keys), "shell_access", "high", "Package executes shell commands", detail)


def obfuscation_alerts(source: DataFrame, threshold: float = ENTROPY_THRESHOLD) -> DataFrame:
    """The high-entropy files of each version. ``threshold`` must be the one ``source`` was built with."""
    if "seen" in source.columns:
        hits = source.where(F.col("family") == ENTROPY)
    else:
        hits = distinct_hits(file_hits(source, (ENTROPY,), threshold))
    packed = pack_in_parts(hits, ["package", "version"], "seen")
    flagged: Column = F.transform(
        "items", lambda i: F.struct(i["path"].alias("file"), round2(i["value"]).alias("entropy"))
    )
    detail = details(files=flagged, threshold=F.lit(threshold))
    message = "Package contains obfuscated code with high entropy"
    return alert_rows(packed, "obfuscated_code", "high", message, detail, part=F.col("part"))


def manifest_script_alerts(source: DataFrame) -> DataFrame:
    """Install-script alerts from the root manifests among the package files."""
    pairs = F.sort_array(F.collect_list(F.struct("seen.rule_ord", "seen.hit", "seen.text")))
    scripts = _of(source, INSTALL).groupBy("package", "version").agg(pairs.alias("pairs"))
    return script_alerts(
        scripts.select(
            "package",
            "version",
            F.col("pairs.hit").alias("names"),
            F.map_from_arrays(F.col("pairs.hit"), F.col("pairs.text")).alias("scripts"),
        )
    )
