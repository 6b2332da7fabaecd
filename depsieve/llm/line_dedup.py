"""Removal of passages that repeat across documents, by content-defined chunks of lines.

Lines are hashed, the line hashes pick boundary lines (the smallest of each ``window``
neighbours; there is no rolling hash), and the lines between boundaries form chunks. Boundaries
depend on the lines around them only, so text put in or taken out elsewhere does not shift
them, and two copies of a passage are cut alike. Everything is built-in Spark expressions.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, whole_text

#: A line of so many words is a chunk of its own.
LONG_LINE_WORDS = 50


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def _boundaries(hashes: Column, long_lines: Column, window: int) -> Column:
    """Whether each line is the smallest of some ``window`` consecutive ones, the last on ties."""

    def at(i: Column) -> Column:
        return F.get(hashes, i)

    def is_boundary(_, i):
        runs = F.lit(False)
        # The window may begin up to window - 1 lines before this one.
        for back in range(window):
            held = F.lit(True)
            for k in range(-back, window - back):
                if k:
                    near = at(i + k)
                    smaller = at(i) <= near if k < 0 else at(i) < near
                    held = held & (i + k >= 0) & F.coalesce(smaller, F.lit(False))
            runs = runs | held
        return runs | F.get(long_lines, i)

    return F.transform(hashes, is_boundary)


def _pieces(window: int) -> Column:
    """Chunk pieces: first and last line, their hashes (the key) and word counts.

    A piece runs from a line to the next boundary or from the last boundary to a line; whole
    chunks are among them. A passage begins and ends in the middle of chunks; its first
    lines are a piece up to a boundary and its last ones a piece from a boundary, so they are
    found too. With ``window`` neighbours to choose from, the next boundary is never further
    than ``window`` lines away.
    """
    hashes, counts, bounds, long_lines = (F.col(c) for c in ("_h", "_n", "_bounds", "_long"))

    def piece(first: Column, last: Column) -> Column:
        size = last - first + 1
        return F.struct(
            first.cast("int").alias("first"),
            last.cast("int").alias("last"),
            F.slice(hashes, first + 1, size).alias("key"),
            F.slice(counts, first + 1, size).alias("n"),
        )

    def of_line(_, i):
        ahead, behind = F.lit(None).cast("int"), F.lit(None).cast("int")
        for k in range(window, 0, -1):
            ahead = F.when(F.get(bounds, i + k), i + k).otherwise(ahead)
            behind = F.when((i >= k) & F.get(bounds, i - k), i - k).otherwise(behind)
        return F.array(
            F.when(~F.get(bounds, i) & ahead.isNotNull(), piece(i, ahead)),
            F.when(behind.isNotNull(), piece(behind, i)),
            F.when(F.get(long_lines, i), piece(i, i)),
        )

    return F.filter(F.flatten(F.transform(hashes, of_line)), lambda p: p.isNotNull())


def _same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["_id"].eqNullSafe(right["_id"]) & (left["_hash"] == right["_hash"])


def remove_repeated_passages(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 50, window: int = 2
) -> DataFrame:
    """The input with its repeated passages cut out of the text; columns and their order stay.

    Lines end at a line feed. A piece (two or more lines, or one line of at least
    LONG_LINE_WORDS words) that occurs elsewhere with the same bytes, in another document or
    further up in the same one, is removable; the first occurrence, by document id and
    line, stays. Neighbouring removable lines form a passage, which goes if it has at least
    ``min_words`` words. Shorter repeats, such as one licence line, stay.

    A document of which no line is left is dropped, as all of it stands elsewhere; one that
    has no repeated passage stays as it is (null and empty texts too). Null ids rank before
    all others; ids are whole numbers. Rows that repeat an id are treated alike.
    Further columns are kept, but for names that begin with an underscore. No rows in, no
    rows out.
    """
    raw = whole_text(text)
    keys = (F.col(doc_id).alias("_id"), F.xxhash64(raw).alias("_hash"))
    cut = (
        docs.select(*keys, F.split(raw, "\n", -1).alias("_lines"))
        .select(
            "_id",
            "_hash",
            F.transform("_lines", lambda x: F.xxhash64(x)).alias("_h"),
            F.transform("_lines", _words).alias("_n"),
        )
        .withColumn("_long", F.transform("_n", lambda n: n >= LONG_LINE_WORDS))
        .withColumn("_bounds", _boundaries(F.col("_h"), F.col("_long"), window))
    )
    pieces = cut.select("_id", "_hash", F.inline(_pieces(window)))

    # One row per key after map-side aggregation, however many documents share the passage.
    # A place is one number: id and line, which a hash aggregate keeps in place.
    before_all = F.lit("-10000000000000000000").cast("decimal(20,0)")
    place = F.coalesce(F.col("_id").cast("decimal(20,0)"), before_all) * F.lit("10000000000").cast("decimal(11,0)") + F.col("first")
    pieces = pieces.withColumn("_place", place.cast("decimal(38,0)"))
    repeated = pieces.groupBy("key").agg(F.min("_place").alias("_keep"), F.max("_place").alias("_other")).where("_keep <> _other")
    spans = pieces.join(repeated.drop("_other"), "key").select(
        "_id", "_hash", "first", "last", "key", "n", (F.col("_place") != F.col("_keep")).alias("removable")
    )
    spans = stored(spans, "op2-spans")
    different = stored(_different_lines(docs.select(*keys, raw.alias("_text")), spans), "op2-different")
    if not different.isEmpty():
        # Pieces with a line whose hash stands for several texts don't count as repeated.
        bad = spans.select("key", F.explode("key").alias("_h")).join(different, "_h", "left_semi").select("key").distinct()
        spans = spans.join(bad, "key", "left_anti")

    lines = spans.where("removable").select(
        "_id", "_hash", F.posexplode("n").alias("_k", "n"), (F.col("first") + F.col("_k")).alias("line")
    )
    lines = lines.select("_id", "_hash", "line", "n").distinct()
    in_order = Window.partitionBy("_id", "_hash").orderBy("line")
    runs = (
        lines.withColumn("_run", F.col("line") - F.row_number().over(in_order))
        .groupBy("_id", "_hash", "_run")
        .agg(F.min("line").alias("first"), F.max("line").alias("last"), F.sum("n").alias("n"))
        .where(F.col("n") >= min_words)
        .groupBy("_id", "_hash")
        .agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_runs"))
    )
    keyed = docs.select("*", *keys)
    met = keyed.join(runs, _same_document(keyed, runs), "left").select(*[keyed[c] for c in docs.columns], runs["_runs"])
    met = met.withColumn("_lines", F.when(F.col("_runs").isNotNull(), F.split(raw, "\n", -1)))
    met = met.withColumn("_kept", _lines_between_runs())
    cut_text = F.when(F.col("_runs").isNull(), F.col(text)).otherwise(F.array_join("_kept", "\n"))
    return met.where("_runs is null or size(_kept) > 0").select(
        *[cut_text.alias(c) if c.lower() == text.lower() else F.col(c) for c in docs.columns]
    )


def _lines_between_runs() -> Column:
    """The lines of _lines that no interval of _runs covers, in order and in linear time."""

    def before(k: Column) -> Column:
        first = F.coalesce(F.get("_runs", k - 1)["last"] + 1, F.lit(0))
        end = F.coalesce(F.get("_runs", k)["first"], F.size("_lines"))
        return F.slice("_lines", first + 1, end - first)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size("_runs")), before))


def _different_lines(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Byte comparison: line hashes (_h) that stand for more than one text in the spans."""
    numbers = (
        spans.select("_id", "_hash", F.explode(F.sequence("first", "last")).alias("line"))
        .groupBy("_id", "_hash")
        .agg(F.collect_set("line").alias("_numbers"))
    )
    met = texts.join(numbers, _same_document(texts, numbers)).select(
        F.split("_text", "\n", -1).alias("_lines"), "_numbers"
    )
    lines = met.select(F.explode(F.transform("_numbers", lambda i: F.get("_lines", i))).alias("_line"))
    return lines.select(F.xxhash64("_line").alias("_h"), "_line").distinct().groupBy("_h").count().where("count > 1").select("_h")
