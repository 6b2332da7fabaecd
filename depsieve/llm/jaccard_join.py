"""Jaccard self-join of word-shingle sets by token-combination prefixes, exact.

Tokens (shingles) have one global order: those outside a bounded table of frequent tokens come
first, by hash; then the frequent ones. A set's prefix must cover one more token than a partner
above the threshold may miss. A rare token covers 1 and is indexed alone. Frequent tokens are
dealt to classes by hash; m tokens of one class cover m - 1, and all pairs of them are indexed,
so the prefix is extended until enough is covered. Two sets above the threshold then share a
rare token or a pair of frequent ones (Wang et al., Local Similarity Search for Unstructured
Text, 2016). Which tokens are frequent bears on speed only, never on the result.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_memos, drop_stored, in_parts, stored
from .components import connected_components
from .words import mix, shingle_hashes, word_hashes


@dataclass(frozen=True)
class Settings:
    words: int = 5
    #: Sets are linked when 100 * intersection >= percent * union.
    percent: int = 80
    #: The most tokens in the table of frequent ones, and the count from which one is frequent.
    frequent_entries: int = 1 << 16
    frequent_from: int = 48
    #: Sets of fewer tokens are indexed by single tokens only.
    short: int = 16


def _band(n: np.ndarray | int, percent: int):
    """Sets whose sizes may be within the threshold are in the same or in neighbouring bands."""
    return np.floor(np.log(n) / -math.log(percent / 100 - 0.01)).astype(np.int64)


def _classes(band: int, s: Settings) -> int:
    """Classes of frequent tokens in a band: 0 means single tokens, else about one per 8 tokens."""
    least = (s.percent / 100 - 0.01) ** -band
    return 0 if least < s.short else 4 ** int(math.log(max(least / 8, 1), 4))


def _set_id(tokens: np.ndarray) -> np.uint64:
    return mix(np.array([mix(tokens + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + np.uint64(len(tokens))]))[0]


def _token_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    hashes, ends = word_hashes(texts)
    for i in range(len(texts)):
        yield np.unique(shingle_hashes(hashes[ends[i] : ends[i + 1]], words))


def _pairs_within(tokens: np.ndarray, classes: np.ndarray, n_classes: int) -> list[np.ndarray]:
    order = np.argsort(classes, kind="stable")
    cuts = np.flatnonzero(np.diff(classes[order])) + 1
    found = []
    for own in np.split(tokens[order], cuts):
        i, j = np.triu_indices(len(own), 1)
        found.append(mix(own[i] * np.uint64(0x9E3779B97F4A7C15) + own[j] + np.uint64(n_classes)))
    return found


def signatures(tokens: np.ndarray, is_frequent: np.ndarray, s: Settings) -> np.ndarray:
    """What a set is indexed by; signatures of single rare tokens are odd, all others even."""
    n, one = len(tokens), np.uint64(1)
    must_cover = n - -(-s.percent * n // 100) + 1
    rare = tokens[~is_frequent]
    if len(rare) >= must_cover:
        return rare[:must_cover] | one
    found, left, frequent = [], must_cover - len(rare), tokens[is_frequent]
    band = int(_band(n, s.percent))
    for n_classes in {_classes(band, s), _classes(band + 1, s)}:
        if not n_classes:
            found.append(frequent[:left])
            continue
        classes = (frequent >> np.uint64(13)) % np.uint64(n_classes)
        # The first of each class covers nothing, every further one covers 1.
        first = np.zeros(len(frequent), bool)
        first[np.unique(classes, return_index=True)[1]] = True
        stop = int(np.searchsorted(np.cumsum(~first), left)) + 1
        found += _pairs_within(frequent[:stop], classes[:stop], n_classes)
    return np.unique(np.concatenate([rare | one, *[f & ~one for f in found]]))


class _FrequentTokens:
    """Misra-Gries counts: a bounded table over all tokens seen that holds every frequent one."""

    def __init__(self, entries: int):
        self.entries, self.tokens, self.counts = entries, np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append(tokens)
        self.size += len(tokens)
        if self.size > 8 * self.entries:
            self.settle()

    def settle(self) -> None:
        tokens, counts = np.unique(np.concatenate([*self.waiting, np.empty(0, np.uint64)]), return_counts=True)
        self.waiting, self.size = [], 0
        both = np.concatenate([self.tokens, tokens])
        self.tokens, where = np.unique(both, return_inverse=True)
        self.counts = np.bincount(where, np.concatenate([self.counts, counts]), len(self.tokens)).astype(np.int64)
        if len(self.tokens) > self.entries:
            self.counts = self.counts - np.partition(self.counts, -self.entries - 1)[-self.entries - 1]
            self.tokens, self.counts = self.tokens[self.counts > 0], self.counts[self.counts > 0]


#: Bins of a 128th of all hashes in which a set's own tokens are counted, and the depth of sets
#: whose rare tokens are all indexed.
_BINS, _WHOLE = 32, 128

_DESCRIBED = "doc_id long, n_shingles long, set_id long, histogram array<smallint>, token long, count long"


def _histogram(tokens: np.ndarray) -> np.ndarray:
    """Tokens by the top bits of their hash; about one bin for four to eight tokens."""
    bits = max((len(tokens) // 4).bit_length() - 1, 1)
    counts = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 32767).astype(np.int16)


def _describe(docs: DataFrame, s: Settings) -> DataFrame:
    """A row per document with its set, and rows (token, count) of what is frequent in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = _FrequentTokens(s.frequent_entries), set()
        names = ["doc_id", "n_shingles", "set_id", "histogram", "token", "count"]
        drop_memos()
        for batch in in_parts(batches):
            sizes, ids, bins = [], [], []
            for tokens in _token_sets(batch.column(1), s.words):
                own = int(_set_id(tokens).astype(np.int64))
                sizes.append(len(tokens))
                ids.append(own)
                bins.append(None)
                if own not in seen:  # copies of one set count once in a task
                    seen.add(own)
                    frequent.add(tokens)
                    bins[-1] = _histogram(tokens)
            empty = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(bins, pa.list_(pa.int16())), empty, empty], names=names)
        frequent.settle()
        keep = frequent.counts >= 2
        empty = pa.nulls(int(keep.sum()), pa.int64())
        none = pa.nulls(len(empty), pa.list_(pa.int16()))
        yield pa.RecordBatch.from_arrays([empty, empty, empty, none, pa.array(frequent.tokens[keep].view(np.int64)), pa.array(frequent.counts[keep])], names=names)

    return docs.mapInArrow(run, _DESCRIBED)


def _index(docs: DataFrame, frequent: np.ndarray, s: Settings) -> DataFrame:
    """Rows (sig, set_id), and a row without sig for each set; each set once in a task.

    odd counts a set's tokens that aren't frequent, singles its single rare tokens below each
    bin of hashes, and all its rare tokens below the bin ``depth`` are indexed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, one = shared.value, set(), np.uint64(1)
        names = ["sig", "set_id", "n", "odd", "singles", "depth"]
        for batch in in_parts(batches):
            sigs, ids, sizes, odd, bins, depths = [], [], [], [], [], []
            for tokens in _token_sets(batch.column(1), s.words):
                own = _set_id(tokens)
                if not len(tokens) or own in seen:
                    continue
                seen.add(own)
                if len(table):
                    is_frequent = table[np.minimum(np.searchsorted(table, tokens), len(table) - 1)] == tokens
                else:
                    is_frequent = np.zeros(len(tokens), bool)
                sigs.append(signatures(tokens, is_frequent, s))
                ids.append(own)
                sizes.append(len(tokens))
                rare = tokens[~is_frequent]
                odd.append(len(rare))
                singles = sigs[-1][(sigs[-1] & one) == one]
                bins.append(np.searchsorted(singles >> np.uint64(57), np.arange(1, _BINS + 1, dtype=np.uint64)).astype(np.int16))
                depths.append(_WHOLE if len(singles) >= len(rare) else int(singles[-1] >> np.uint64(57)))
            empty = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([empty, pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(odd, pa.int32()), pa.array(bins, pa.list_(pa.int16())), pa.array(depths, pa.int32())], names=names)
            many = [len(x) for x in sigs]
            flat = np.concatenate([*sigs, np.empty(0, np.uint64)]).view(np.int64)
            ids = np.repeat(np.array(ids, np.uint64), many).view(np.int64)
            for at in range(0, max(len(flat), 1), 100_000):
                part = slice(at, at + 100_000)
                none = pa.nulls(len(flat[part]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(flat[part]), pa.array(ids[part]), none, none, pa.nulls(len(none), pa.list_(pa.int16())), none], names=names)

    return docs.mapInArrow(run, "sig long, set_id long, n int, odd int, singles array<smallint>, depth int")


def _whole_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """(set_id, tokens) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            sets = list(_token_sets(batch.column(1), s.words))
            ids = np.array([_set_id(t) for t in sets], np.uint64).view(np.int64)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["set_id", "tokens"])

    return docs.mapInArrow(run, "set_id long, tokens array<long>")


def _most_common(x: Column, y: Column) -> Column:
    """The most tokens two sets can share, by their histograms; the finer one is folded."""

    def folded(h: Column, size: Column) -> Column:
        each = (F.size(h) / size).cast("int")
        return F.transform(F.sequence(F.lit(1), size), lambda i: F.aggregate(F.slice(h, (i - 1) * each + 1, each), F.lit(0), lambda a, c: a + c))

    size = F.least(F.size(x), F.size(y))
    both = F.zip_with(folded(x, size), folded(y, size), lambda a, b: F.least(a, b))
    return F.aggregate(both, F.lit(0), lambda a, c: a + c)


def _likely(pairs: DataFrame, facts: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) that their own tokens and their histograms allow to be linked; no link is
    lost. first_a and first_b are documents that hold the sets.

    A token that only one set has indexed cannot be in another set that would have indexed it:
    one whose depth is beyond that token. So only tokens below the other's depth count. A bin of
    a histogram stops counting at 32,767, so where one is full it tells nothing.
    """
    x, y = ([F.col("set_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "own", "own_below", "depth", "histogram", "first")]] for k in "ab")
    met = pairs.join(facts.select(*x), "a").join(facts.select(*y), "b")

    def linked_with(both):
        return 100 * both >= s.percent * (F.col("n_a") + F.col("n_b") - both)

    def without_own(k, other):
        depth = F.col(f"depth_{other}")
        below = F.coalesce(F.get(f"own_below_{k}", F.least(depth, F.lit(_BINS)) - 1), F.lit(0))
        return F.col(f"n_{k}") - F.when(depth == _WHOLE, F.col(f"own_{k}")).otherwise(below)

    # In one condition, so that histograms are looked at last, and once for each pair left.
    own_allow = linked_with(F.least(without_own("a", "b"), without_own("b", "a")))
    full = (F.array_max("histogram_a") == 32767) | (F.array_max("histogram_b") == 32767)
    met = met.where(own_allow & (full | F.exists(F.array(_most_common(F.col("histogram_a"), F.col("histogram_b"))), linked_with)))
    return met.select("a", "first_a", "b", "first_b")


def _links(postings: DataFrame, facts: DataFrame, whole_sets, s: Settings) -> DataFrame | None:
    """(node, root) of the sets that are linked with others.

    All members of a posting list would make pairs by the square of its length. Instead a few
    leaders of each list are compared with its other members; who is linked with them, in
    however many steps, is joined to their component, and only members of different components
    still have to be compared. Leaders are then done with and leave the list. The first leader
    is the member with the fewest tokens of its own: of a group of edited copies that is the
    text they were made from, which is linked with most of them. Each round then allows 64 times
    as many: lists of no more members have all of them as leaders and end with the round, longer
    ones a random share. So the rounds are few, whatever the lists' lengths, and a round makes
    no more than its leaders for each row. A list also ends when one component is left.

    ``own`` counts tokens of a set that no other set has indexed, or in a list of frequent tokens
    its rare ones: pairs that share one of those are met elsewhere. Among sets that have indexed
    all their rare tokens it bounds what a pair can share, and so the size of any partner:
    where a list has such sets only, members without a possible partner leave early. Edited
    copies too far from the text they were made from share its frequent tokens only, so that
    bound keeps them from being compared with all its other copies.
    """
    # From 100 * both >= percent * (n + m - both) and both <= n - own.
    largest = F.floor((100 + s.percent) * (F.col("n") - F.col("own")) / s.percent - F.col("n") + 1e-6)
    both = F.least(F.col("n") - F.when(F.col("lead_whole"), F.col("own")).otherwise(0), F.col("m") - F.when(F.col("whole"), F.col("lead_own")).otherwise(0))
    fits = (100 * both >= s.percent * (F.col("n") + F.col("m") - both)) & (F.col("root") != F.col("lead_root"))
    joined, tested, turn = None, None, 0
    while True:
        leaders = postings.where("leads").select("sig", *[F.col(a).alias(b) for a, b in (("set_id", "lead"), ("n", "m"), ("own", "lead_own"), ("whole", "lead_whole"), ("root", "lead_root"))])
        # Of two leaders one compares.
        pairs = postings.join(leaders, "sig").where(fits & (~F.col("leads") | (F.col("set_id") < F.col("lead"))))
        pairs = pairs.select(F.least("set_id", "lead").alias("a"), F.greatest("set_id", "lead").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, f"op3-pairs-{turn}")
        found = None if pairs.isEmpty() else _linked(pairs, facts, whole_sets, turn, s)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if found is not None:
            # Components so far are stars; with the new links they are few steps from new stars.
            edges = found if joined is None else found.union(joined.select("node", "root"))
            joined = connected_components(edges, f"op3-components-{turn}")
        rest = postings.where("not leads")
        if rest.isEmpty():
            return joined
        if joined is not None:
            rest = rest.drop("root").join(joined.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        rest = rest.withColumn("_largest", largest)
        open_lists = rest.groupBy("sig").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.min("n").alias("_low"), F.max("_largest").alias("_high"), F.min("whole").alias("_all"), F.count("*").alias("_members"))
        turn += 1
        rest = rest.join(open_lists.where("_a <> _b"), "sig").where("not _all or (_largest >= _low and n <= _high)")
        leads = F.pmod(F.xxhash64("set_id", F.lit(turn)), F.col("_members")) < 64**turn
        rest = rest.select("sig", "set_id", "n", "own", "whole", "root", leads.alias("leads"))
        postings = stored(rest, f"op3-postings-{turn}")
        for label in ("postings", "likely", "first", "sets"):
            drop_stored(f"op3-{label}-{turn - 1}", postings.sparkSession)
        if postings.isEmpty():
            return joined


def _linked(pairs: DataFrame, facts: DataFrame, whole_sets, turn: int, s: Settings) -> DataFrame | None:
    """The linked ones of some pairs, (a, b); None if there are none."""
    likely = stored(_likely(pairs, facts, s), f"op3-likely-{turn}")
    if likely.isEmpty():
        return None
    sets = whole_sets(likely.select("first_a").union(likely.select("first_b")).distinct(), turn)
    met = likely.join(sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("x")), "a")
    met = met.join(sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    found = stored(met.where(100 * both >= s.percent * (F.size("x") + F.size("y") - both)).select("a", "b").distinct(), f"op3-links-{turn}")
    return None if found.isEmpty() else found


def jaccard_components(docs: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_shingles (size of its set), component_id.

    component_id is the smallest doc_id reachable by links, the row's own included. Words are
    runs of characters other than ASCII white space, A-Z lower-cased; a text of fewer words
    than a shingle has one shingle, its whole sequence. Null and empty texts and texts without
    words have an empty set: they are linked with nothing. Rows with equal sets (copies) are
    one set, known by a 64-bit fingerprint and their size. Null ids are no component's smallest unless all are
    null. Further columns are not looked at. No rows in, no rows out.
    """
    s = settings
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    described = stored(_describe(rows, s), "op3-described")
    frequent = (
        described.where("token is not null").groupBy("token").agg(F.sum("count").alias("c")).where(F.col("c") >= s.frequent_from)
        .orderBy(F.desc("c"), "token").limit(s.frequent_entries).select("token").toPandas()["token"]
    )
    table = np.sort(frequent.to_numpy(np.int64, copy=True).view(np.uint64))
    own = described.where("set_id is not null").select("doc_id", "n_shingles", "set_id")

    index = stored(_index(rows, table, s), "op3-index")
    rows_of_sigs = index.where("sig is not null").select("sig", "set_id")
    several = rows_of_sigs.groupBy("sig").agg(F.min("set_id").alias("_a"), F.max("set_id").alias("_b")).where("_a <> _b").select("sig")
    shared = stored(rows_of_sigs.join(several, "sig").distinct(), "op3-shared")
    # A set's own tokens are the single rare ones that no other set has indexed.
    single, slot = F.col("sig").bitwiseAND(1) == 1, F.shiftrightunsigned("sig", 57)
    met = shared.groupBy("set_id").agg(F.count_if(single).alias("_met"), F.array(*[F.count_if(single & (slot < k)) for k in range(1, _BINS + 1)]).alias("_below"))
    about = index.where("sig is null").drop("sig").dropDuplicates(["set_id"])
    # Copies in different tasks have left equal rows: any of them.
    histograms = described.where("histogram is not null").select("set_id", "histogram").dropDuplicates(["set_id"])
    smallest = own.groupBy("set_id").agg(F.min("doc_id").alias("first"))
    must_cover = F.col("n") - F.floor((s.percent * F.col("n") + 99) / 100) + 1
    facts = about.join(met, "set_id").join(histograms, "set_id").join(smallest, "set_id").select(
        "set_id", "n", "odd", "depth", "histogram", "first",
        (F.least(F.col("odd"), must_cover) - F.col("_met")).cast("int").alias("own"),
        F.zip_with("singles", "_below", lambda a, b: (a - b).cast("int")).alias("own_below"),
    )
    facts = stored(facts, "op3-facts")
    postings = shared.join(facts.select("set_id", "n", "odd", "own", (F.col("depth") == _WHOLE).alias("whole")), "set_id")
    # Lists are split by size band: partners are in the same band or the next.
    band = F.floor(F.log(F.col("n")) / -math.log(s.percent / 100 - 0.01))
    # Two sets with a rare token in common meet in that token's list, if both have indexed all of
    # theirs. So in a list of frequent tokens (even) all rare tokens of a set count as its own.
    own_here = F.when((F.col("sig").bitwiseAND(1) == 1) | ~F.col("whole"), F.col("own")).otherwise(F.col("odd")).alias("own")
    postings = postings.select("set_id", "n", "odd", own_here, "whole", "sig", F.explode(F.array(band, band + 1)).alias("_band"))
    postings = stored(postings.select(F.xxhash64("sig", "_band").alias("sig"), "set_id", "n", "odd", "own", "whole", F.col("set_id").alias("root")), "op3-banded")
    several = postings.groupBy("sig").agg(F.min("set_id").alias("_a"), F.max("set_id").alias("_b"), F.min(F.struct("odd", "set_id")).alias("_lead")).where("_a <> _b")
    leads = (F.col("set_id") == F.col("_lead.set_id")).alias("leads")
    postings = stored(postings.join(several, "sig").select("sig", "set_id", "n", "own", "whole", "root", leads), "op3-postings-0")
    for label in ("index", "shared", "banded"):
        drop_stored(f"op3-{label}", docs.sparkSession)

    def whole_sets(needed: DataFrame, turn: int) -> DataFrame:
        """Tokens of the sets that have to be compared, from one document of each."""
        first = stored(needed.toDF("_id"), f"op3-first-{turn}")
        texts = rows.join(first, rows["doc_id"].eqNullSafe(first["_id"]), "left_semi")
        # An id that several documents share brings in the sets of all; repeats and sets that
        # nobody asked for do no harm, as the links found are made distinct.
        return stored(_whole_sets(texts, s), f"op3-sets-{turn}")

    joined = _links(postings, facts, whole_sets, s)

    smallest = smallest.withColumnRenamed("first", "smallest")
    if joined is not None:
        rooted = smallest.join(joined.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        of_root = rooted.groupBy("root").agg(F.min("smallest").alias("_least"))
        smallest = rooted.join(of_root, "root").select("set_id", F.col("_least").alias("smallest"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("smallest"))
    return own.join(stored(smallest, "op3-smallest"), "set_id").select("doc_id", "n_shingles", component.alias("component_id"))
