"""Document fingerprints by spot signatures (SpotSigs), in built-in expressions only.

Common words are anchors. After each anchor, the next ``chain`` content words (words that
are no anchors) within ``span`` words form a signature ``anchor:w1:w2:...``; a text's
fingerprint is the set of its signatures, each as a 64-bit hash, sorted. Chains stand in
the running text around common words, so boilerplate without them (menus, lists of
names) gives no signatures, and a local edit changes only the chains it touches.

Two fingerprints are compared by Jaccard likeness. For a search among many documents,
``similar_pairs`` partitions fingerprints by set size: a pair can reach likeness ``t``
only if the smaller set holds at least ``t`` of the larger, so only partitions of
compatible sizes meet, and inside them a signature prefix prunes (a pair must share one
of the first ``|A| - ceil(t |A|) + 1`` signatures of A); the survivors are compared exactly.

Everything is a regex, an array function or a join: no Python runs in the tasks.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\u0001"


@dataclass(frozen=True)
class Settings:
    #: Content words in a signature after its anchor.
    chain: int = 3
    #: Words after an anchor within which the chain must be complete.
    span: int = 8
    #: Anchors: the most frequent words of the corpus.
    anchors: int = 24


def normal_words(text: Column) -> Column:
    """The text lower-cased, runs of letters and digits joined by single spaces; null is empty."""
    lowered = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.trim(F.regexp_replace(lowered, r"[^\p{L}\p{N}]+", " "))


def common_words(docs: DataFrame, count: int, text: str = "text") -> list[str]:
    """The ``count`` most frequent words over all texts (ties by word), counted map-side first.

    Only these few words come to the driver."""
    words = docs.select(F.explode(F.split(normal_words(F.col(text)), " ")).alias("w")).where(F.col("w") != "")
    top = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(count)
    return [r["w"] for r in top.collect()]


def signatures(text: Column, anchors: Sequence[str], settings: Settings = Settings()) -> Column:
    """The sorted distinct 64-bit hashes of the text's spot signatures (array<long>).

    A text without anchors, or with no anchor followed by ``chain`` content words within
    ``span`` words, has none."""
    if not anchors:
        return F.array().cast("array<long>")
    words = normal_words(text)
    alternatives = "|".join(sorted(anchors, key=lambda a: (-len(a), a)))
    # Anchors are marked where they stand as whole words; then every mark starts one look-ahead.
    marked = F.regexp_replace(words, f"(?<![^ ])({alternatives})(?![^ ])", MARK + "$1")
    spots = F.regexp_extract_all(marked, F.lit(f"{MARK}(?=([^ ]+(?: [^ ]+){{0,{settings.span}}}))"), 1)

    def signature(spot: Column) -> Column:
        parts = F.split(spot, " ")
        content = F.filter(F.slice(parts, 2, settings.span), lambda w: ~w.startswith(MARK))
        whole = F.concat_ws(":", F.get(parts, 0), F.array_join(F.slice(content, 1, settings.chain), ":"))
        return F.when(F.size(content) >= settings.chain, F.xxhash64(whole))

    hashed = F.filter(F.transform(spots, signature), lambda h: h.isNotNull())
    return F.sort_array(F.array_distinct(hashed))


def fingerprint_text(sigs: Column) -> Column:
    """A fingerprint as text: its hashes as 16 hex digits, ascending, separated by spaces."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets; 0.0 where both are empty (nothing to compare)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union).cast("double")


def similar_pairs(prints: DataFrame, threshold: float, key: str = "doc_id", sigs: str = "sigs") -> tuple[DataFrame, DataFrame]:
    """Near-duplicate fingerprints: (members, pairs).

    members (key, rep): each row with a non-empty fingerprint and the smallest key of the
    rows with the same fingerprint (copies are never paired with each other). pairs (a, b,
    likeness), a < b, between representatives of different fingerprints with likeness >=
    ``threshold`` (> 0). Empty fingerprints pair with nothing.

    Size partitions: a meets b only if |b| * t <= |a| and |a| * t <= |b|. Prefix: each
    fingerprint indexes its first |s| - ceil(t |s|) + 1 hashes; two sets of likeness >= t
    share one of them (the prefix filter of sorted sets). Survivors are compared exactly.
    """
    t = float(threshold)
    own = prints.select(F.col(key).alias("_k"), F.col(sigs).alias("_s")).where(F.size("_s") > 0)
    # Copies first: one row per distinct fingerprint, pre-aggregated, so a hot group is one row.
    reps = own.groupBy("_s").agg(F.min("_k").alias("_k"))
    members = own.join(reps.select("_s", F.col("_k").alias("rep")), "_s").select(F.col("_k").alias(key), "rep")
    rows = reps.withColumn("_n", F.size("_s"))
    prefix = (F.col("_n") - F.ceil(F.col("_n") * t) + 1).cast("int")
    index = rows.select("_k", "_n", F.explode(F.slice("_s", 1, prefix)).alias("_h"))
    a, b = index.alias("a"), index.alias("b")
    fits = (F.col("a._k") < F.col("b._k")) & (F.col("a._n") >= F.col("b._n") * t - 1e-9) & (F.col("b._n") >= F.col("a._n") * t - 1e-9)
    pairs = a.join(b, (F.col("a._h") == F.col("b._h")) & fits).select(F.col("a._k").alias("a"), F.col("b._k").alias("b")).distinct()
    left, right = rows.select(F.col("_k").alias("a"), F.col("_s").alias("sa")), rows.select(F.col("_k").alias("b"), F.col("_s").alias("sb"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return members, scored.where(F.col("likeness") >= t - 1e-12)
