"""Small helpers shared by the corpus operators."""

import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql import types as T

from depsieve.session import new_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"

_scratch: list[str] = []
_memo: dict = {}
_left: dict[str, list[str]] = {}


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; no other character changes."""
    return F.translate(text, UPPER, LOWER)


def whole_text(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def crc_bucket(doc_id: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id falls in bucket 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % buckets, F.lit(0))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the folder all executors share, and read back.

    Cuts the lineage: a lost executor later costs a re-read of files, not a re-run.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    _scratch.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_of(owner: str):
    """Wraps functions that come one after another, each reading only what its predecessor
    wrote: what the predecessor of the same owner had stored is deleted at the next call."""

    def wrap(function):
        @functools.wraps(function)
        def call(spark: SparkSession, *args):
            for path in _left.pop(owner, []):
                _delete(spark, path)
            before = len(_scratch)
            found = function(spark, *args)
            _left[owner] = _scratch[before:]
            del _scratch[before:]
            return found

        return call

    return wrap


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(label: str, spark: SparkSession) -> None:
    """Delete the stored tables of one label, once their last reader has run."""
    for name in [p for p in _scratch if p.rpartition("/")[2].rpartition("-")[0] == label]:
        _scratch.remove(name)
        _delete(spark, name)


def worker_memo(key, make: Callable):
    """What ``make`` has built in this Python worker under ``key``, for later tasks too.

    A worker serves one operator after another; only the last one's is kept.
    """
    if key not in _memo:
        _memo.clear()
        _memo[key] = make()
    return _memo[key]


#: What a task works on at once, however many rows and bytes Spark hands over together.
PART_ROWS, PART_BYTES = 500, 4 << 20


def in_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in parts of bounded size; a larger row is a part of its own.

    What an operator makes of a batch is a multiple of its texts, and workers keep the memory
    they once had. The pool's unused memory is given back when a task ends.
    """
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, PART_ROWS)
            while part.num_rows > 1 and part.nbytes > PART_BYTES:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows
    pa.default_memory_pool().release_unused()


def drop_memos() -> None:
    """For operators that keep nothing in a Python worker: what earlier ones have kept goes."""
    _memo.clear()


def without(schema: T.StructType, names: Iterable[str]) -> T.StructType:
    """The schema less some columns, compared as Spark does (no case)."""
    gone = {n.lower() for n in names}
    return T.StructType([f for f in schema if f.name.lower() not in gone])


def add_columns(batch: pa.RecordBatch, keep: list[str], **new) -> pa.RecordBatch:
    """The kept columns of a batch and the new ones."""
    names = batch.schema.names
    kept = [batch.column(names.index(k)) for k in keep]
    return pa.RecordBatch.from_arrays(kept + list(new.values()), names=keep + list(new))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column, empty where null."""
    return [t or "" for t in column.to_pylist()]


def positions(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` with ``pos`` (long, from 0): the row's place among rows of equal ``keys`` by ``order``.

    The rows are range-partitioned by keys and order, numbered inside each partition and
    shifted by the counts of the same keys in earlier partitions, so a key with a third of all
    rows is spread over many tasks and no window holds a whole group. The numbered rows are
    stored before use: a retry cannot number them anew. Key columns must not be null (give
    callers' nulls a sort key of their own); rows equal in keys and order get consecutive places
    in an order that is arbitrary but fixed once stored.
    """
    ranked = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranked = stored(ranked.withColumn("_mid", F.monotonically_increasing_id()), label)
    part = F.shiftright("_mid", 33).alias("_part")
    # One row per partition and key: at most partitions + keys rows, whatever the skew.
    firsts = ranked.groupBy(part, *keys).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")
    firsts = firsts.select("_part", *keys, "_first", before.alias("_before"))
    placed = ranked.withColumn("_part", F.shiftright("_mid", 33)).join(firsts, ["_part", *keys])
    return placed.withColumn("pos", F.col("_before") + F.col("_mid") - F.col("_first")).drop("_part", "_first", "_before", "_mid")
