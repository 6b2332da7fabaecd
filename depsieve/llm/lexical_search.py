"""Ranked lexical search with integer BM25 impacts, pruned by norm buckets (LEMP style).

Every document becomes an impact vector: one integer per term it holds. A query is the
vector of its term counts, and a score is their inner product, so the exact top k of a
query is an inner-product search. As in LEMP, the document vectors are ordered by
length (their Euclidean norm) into buckets of nearly equal norm:

1. a lower bound ``theta`` of each query's k-th score comes from exact scores of the
   longest vectors, and rises with the best ones found in a task;
2. a bucket is skipped for a query when the Cauchy-Schwarz bound (query norm times the
   bucket's largest norm) or the bucket's coordinate bound (query counts times the
   bucket's largest impact per term) is below ``theta``;
3. inside a kept bucket, coordinate bounds filter: terms whose bounds together stay below
   ``theta`` are not essential, and only documents with an essential term whose impact
   closes the gap left by the other terms' bounds are candidates;
4. candidates are scored exactly, in 64-bit integers, and ranked.

Every bound is an upper bound of the exact score, and buckets and candidates are dropped
only below ``theta``, so the result equals the exhaustive ranking. A vector is one row: its
terms are never dealt out, only whole vectors are, once, by range of norm. A range is a run of
buckets and one task's work; what leaves a task are its best documents for each query.
"""

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_memos, drop_stored, in_parts, lower_ascii, stored

# Fixed values of the scoring contract: a term is a maximal run of characters outside these
# ASCII ranges (so ASCII letters, digits and every non-ASCII character), A-Z lower-cased;
# b = 25/100 and k1 = 12/10 in BM25's length norm, impacts scaled by 10^9 and weights by 1000.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LENGTH_SHARE, LENGTH_WHOLE, K1_TENTHS, IMPACT_SCALE, WEIGHT_SCALE = 25, 100, 12, 1_000_000_000, 1000

#: The same terms in UTF-8, where characters beyond ASCII have no byte below 0x80.
_TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes of a text up to which its terms are listed at once.
_LIST_BYTES = 4 << 20
#: Products of counts and impacts that are worked out at once.
_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Settings:
    #: Documents returned per query.
    k: int = 20
    #: Buckets hold norms within a factor of ``bucket_ratio``; smaller factors prune finer.
    bucket_ratio: float = 1.25
    #: The longest vectors, whose exact scores give the first lower bounds.
    seeds: int = 1000
    #: Queries that are broadcast together; more take turns over the documents.
    items_at_once: int = 1000


def terms_of(text: Column) -> Column:
    """The terms of a text, in order, repeats kept; none for null."""
    return F.regexp_extract_all(lower_ascii(whole_text_of(text)), F.lit(TERM), 0)


def whole_text_of(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _term_counts(text: bytes, ids: dict[bytes, int]) -> tuple[int, Counter]:
    """How many terms a text has, and how often each of the known ones."""
    if len(text) <= _LIST_BYTES:
        terms = _TERM_BYTES.findall(text.lower())
        return len(terms), Counter(i for i in map(ids.get, terms) if i is not None)
    n, found = 0, Counter()
    for match in _TERM_BYTES.finditer(text.lower()):
        n += 1
        if (i := ids.get(match.group())) is not None:
            found[i] += 1
    return n, found


def _lists(counts: list[int], flat: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(flat, kind))


def term_vectors(docs: DataFrame, vocabulary: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: _d (row key), doc_id, n (all its terms, with repeats), and
    the places in ``vocabulary`` of the terms it holds of that (ascending) with their numbers.

    Rows are told apart by the stored row key, so repeated doc_ids stay separate documents.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({term.encode(): i for i, term in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memos()
        for batch in in_parts(batches):
            found = [_term_counts(t, shared.value) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            held = [sorted(c.items()) for _, c in found]
            flat = np.array([x for h in held for x in h], np.int32).reshape(-1, 2)
            sizes = list(map(len, held))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), _lists(sizes, flat[:, 0], pa.int32()), _lists(sizes, flat[:, 1], pa.int32())],
                names=["_d", "doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("_d"), F.col(doc_id).cast("long").alias("doc_id"), whole_text_of(F.col(text)).alias("_text"))
    return stored(rows.mapInArrow(run, "_d long, doc_id long, n long, terms array<int>, tfs array<int>"), "op11-vectors")


def _flat(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    """The values of list columns, and the row of each value."""
    columns = [batch.column(batch.schema.names.index(n)) for n in names]
    sizes = columns[0].value_lengths().to_numpy(zero_copy_only=False)
    return *(c.flatten().to_numpy() for c in columns), np.repeat(np.arange(batch.num_rows), sizes)


def impact_vectors(vectors: DataFrame, n_terms: int) -> DataFrame:
    """One row per row of ``vectors`` that holds a term: _d, doc_id, terms, impacts (long), norm.

    ``N`` counts rows with a term, ``L`` all their terms. A term's weight is
    floor(1000 * ln((2N+2)/(2df+1))); a row's length norm m = 75 + (25 n N) div L; the impact
    of a term with tf occurrences is weight * ((10^9 tf) div (1000 tf + 12 m)). Norms are those
    of the vocabulary's part of each vector, which bounds scores against queries of that
    vocabulary as tightly as the whole (tighter). Weights are one number per vocabulary term.
    """
    spark = vectors.sparkSession
    big_n, big_l = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(float(WEIGHT_SCALE)) * F.log((F.lit(2.0 * big_n + 2.0)) / (F.lit(2.0) * F.col("df") + F.lit(1.0))))
    known = df.select("term", weight.cast("long").alias("w")).toArrow()
    weights = np.zeros(n_terms, np.int64)
    weights[known.column("term").to_numpy()] = known.column("w").to_numpy()
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            terms, tfs, row = _flat(batch, "terms", "tfs")
            tf, m = tfs.astype(np.int64), batch.column(2).to_numpy()[row]
            impacts = shared.value[terms] * ((IMPACT_SCALE * tf) // (WEIGHT_SCALE * tf + K1_TENTHS * m))
            norms = np.sqrt(np.bincount(row, impacts.astype(float) ** 2, batch.num_rows))
            ends = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), _lists(ends.tolist(), impacts, pa.int64()), pa.array(norms)],
                names=["_d", "doc_id", "terms", "impacts", "norm"],
            )

    # 25 n N can pass 2^63 on a large corpus: decimal(38) until the division.
    m = (F.lit(LENGTH_WHOLE - LENGTH_SHARE) + F.expr(f"(cast({LENGTH_SHARE} as decimal(38,0)) * n * {big_n}) div {max(big_l, 1)}")).cast("long")
    rows = vectors.where(F.size("terms") > 0).select("_d", "doc_id", m.alias("m"), "terms", "tfs")
    return stored(rows.mapInArrow(run, "_d long, doc_id long, terms array<int>, impacts array<long>, norm double"), "op11-impacts")


def query_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(_q, item_id, term, q): the count of each term in each query row."""
    rows = items.select(F.col(item_id).alias("item_id"), terms_of(F.col(text)).alias("_t")).withColumn("_q", F.monotonically_increasing_id())
    counts = rows.select("_q", "item_id", F.explode("_t").alias("term")).groupBy("_q", "item_id", "term").agg(F.count(F.lit(1)).alias("q"))
    return stored(counts, "op11-queries")


class _Queries:
    """Entries (query, term, count) ordered by query; every query has one at least."""

    def __init__(self, query: np.ndarray, term: np.ndarray, count: np.ndarray):
        order = np.lexsort((term, query))
        self.keys, self.query = np.unique(query[order], return_inverse=True)
        self.term, self.count = term[order], count[order].astype(np.int64)
        self.begins = np.searchsorted(self.query, np.arange(len(self.keys)))
        self.norms = np.sqrt(np.add.reduceat(self.count.astype(float) ** 2, self.begins))
        self.n_terms = int(term.max()) + 1


class _Best:
    """The k best documents of each query among those offered, and the bound ``theta`` they give."""

    def __init__(self, theta: np.ndarray, k: int):
        self.theta, self.k = theta.copy(), k
        # query, score, 0 for a null doc_id, doc_id, row key
        self.rows = [np.empty(0, np.int64) for _ in range(5)]

    def offer(self, *columns: np.ndarray) -> None:
        rows = [np.concatenate(x) for x in zip(self.rows, columns, strict=True)]
        order = np.lexsort((rows[4], rows[3], rows[2], -rows[1], rows[0]))
        query = rows[0][order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.rows = [x[order[place < self.k]] for x in rows]
        last = order[place == self.k - 1]
        self.theta[rows[0][last]] = np.maximum(self.theta[rows[0][last]], rows[1][last])


def _expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places start, start + 1, ... of each run."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def _search_bucket(terms: np.ndarray, impacts: np.ndarray, row: np.ndarray, n_rows: int, top_norm: float, queries: _Queries, theta: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, score) of all rows of a bucket that reach ``theta``, by groups of queries."""
    tops = np.zeros(queries.n_terms, np.int64)
    np.maximum.at(tops, terms, impacts)
    gain = queries.count * tops[queries.term]
    coord = np.add.reduceat(gain, queries.begins)
    # Doubles may round either way: the norm bound gets a margin before it may prune.
    kept = (coord >= theta) & (queries.norms * top_norm * (1.0 + 1e-9) + 1.0 >= theta)
    if not kept.any():
        return
    # MaxScore on the coordinate bounds: by ascending bound, the query's terms whose bounds sum
    # below theta cannot lift a document to theta on their own, so only documents holding one of
    # the other, essential terms are candidates; and a document with term t scores at most
    # q_t * impact + (coord - bound of t), which must still reach theta.
    order = np.lexsort((gain, queries.query))
    sums = np.cumsum(gain[order])
    sums -= np.repeat(sums[queries.begins] - gain[order][queries.begins], np.diff(np.append(queries.begins, len(gain))))
    essential = np.zeros(len(gain), bool)
    essential[order] = sums >= theta[queries.query[order]]
    least = -((coord[queries.query] - theta[queries.query] - gain) // queries.count)

    by_term = np.argsort(terms, kind="stable")
    impacts, row = impacts[by_term], row[by_term]
    held = np.bincount(terms, minlength=queries.n_terms)
    starts = np.concatenate([[0], np.cumsum(held)[:-1]])
    counts = np.where(kept[queries.query], held[queries.term], 0)
    group = np.cumsum(np.add.reduceat(counts, queries.begins)) // _AT_ONCE
    for g in np.unique(group[kept]):
        own = np.flatnonzero((group[queries.query] == g) & (counts > 0))
        entry = np.repeat(own, counts[own])
        at = _expanded(starts[queries.term[own]], counts[own])
        members, query = np.unique(queries.query[own], return_inverse=True)
        pair = np.repeat(query, counts[own]) * n_rows + row[at]
        candidate = np.zeros(len(members) * n_rows, bool)
        candidate[pair[essential[entry] & (impacts[at] >= least[entry])]] = True
        asked = candidate[pair]
        scores = np.zeros(len(candidate), np.int64)
        np.add.at(scores, pair[asked], queries.count[entry[asked]] * impacts[at[asked]])
        hits = np.flatnonzero(candidate & (scores >= np.repeat(theta[members], n_rows)))
        yield members[hits // n_rows], hits % n_rows, scores[hits]


def _best_of_tasks(vectors: DataFrame, queries: _Queries, theta: np.ndarray, s: Settings) -> DataFrame:
    """(_q, _d, doc_id, score): of each task its best documents for each query, none below theta.

    Vectors come by descending norm for the pruning to bite; the result holds in any order.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((queries, theta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, theta = shared.value
        best = _Best(theta, s.k)
        for batch in in_parts(batches):
            norms = batch.column(4).to_numpy()
            factors = np.floor(np.log(np.maximum(norms, 1e-300)) / math.log(s.bucket_ratio))
            cuts = [0, *(np.flatnonzero(np.diff(factors)) + 1).tolist(), len(norms)]
            for a, b in zip(cuts, cuts[1:]):
                bucket = batch.slice(a, b - a)
                terms, impacts, row = _flat(bucket, "terms", "impacts")
                null = bucket.column(1).is_null().to_numpy(zero_copy_only=False)
                doc_id, key = bucket.column(1).fill_null(0).to_numpy(), bucket.column(0).to_numpy()
                for query, at, score in _search_bucket(terms, impacts, row, b - a, norms[a:b].max(), queries, best.theta):
                    best.offer(query, score, (~null[at]).astype(np.int64), doc_id[at], key[at])
        query, score, known, doc_id, key = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(queries.keys[query]), pa.array(key), pa.array(doc_id, mask=known == 0), pa.array(score)], names=["_q", "_d", "doc_id", "score"])

    return vectors.mapInArrow(run, "_q long, _d long, doc_id long, score long")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "_d")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(docs: DataFrame, query: DataFrame, s: Settings) -> DataFrame:
    """(_q, doc_id, score, rank) of some queries, whose entries one machine holds."""
    spark = docs.sparkSession
    entries = query.select("_q", "term", "q").toArrow()
    vocabulary, place = np.unique(np.array(entries.column("term").to_pylist(), object), return_inverse=True)
    queries = _Queries(entries.column("_q").to_numpy(), place.astype(np.int64), entries.column("q").to_numpy())
    vectors = impact_vectors(term_vectors(docs, vocabulary.tolist()), len(vocabulary))
    drop_stored("op11-vectors", spark)

    # Scores above 0 count, so 1 is a bound; the longest vectors give better ones.
    theta = np.ones(len(queries.keys), np.int64)
    if longest := vectors.select("norm", "_d").orderBy(F.desc("norm"), "_d").limit(s.seeds).agg(F.min(F.struct(F.col("norm"), -F.col("_d")))).first()[0]:
        norm, key = longest
        seeds = vectors.where((F.col("norm") > norm) | ((F.col("norm") == norm) & (F.col("_d") <= -key)))
        kth = _ranked(_best_of_tasks(seeds, queries, theta, s), s.k).where(F.col("rank") == s.k).select("_q", "score").toArrow()
        at = np.searchsorted(queries.keys, kth.column("_q").to_numpy())
        theta[at] = np.maximum(theta[at], kth.column("score").to_numpy())
    by_norm = vectors.repartitionByRange(F.desc("norm"), "_d").sortWithinPartitions(F.desc("norm"), "_d")
    return _ranked(_best_of_tasks(by_norm, queries, theta, s), s.k).select("_q", "doc_id", "score", "rank")


def top_k(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """For each row of ``items``, its ``k`` best rows of ``docs``: item_id, rank (int, from 1),
    doc_id (long), score (long).

    Only scores above 0 count; equal scores go by ascending doc_id (then by row). Null or
    termless texts match nothing; an item without terms has no rows; repeated doc_ids and
    item_ids are separate rows. No documents or no items: no rows. Other columns of the
    inputs are not carried, so their names cannot clash.
    """
    s = settings
    query = query_terms(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    block = F.pmod(F.xxhash64("_q"), F.lit(max(1, -(-query.select("_q").distinct().count() // s.items_at_once))))
    turns = [r[0] for r in query.select(block).distinct().collect()]
    if not turns:
        return query.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    ranked = functools.reduce(DataFrame.unionByName, [_search(rows, query.where(block == turn), s) for turn in turns])
    named = ranked.join(query.select("_q", "item_id").distinct(), "_q")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
