"""Benchmark decontamination: every passage of every document queries a BM25 index of test items.

The index is built over the items, with weights divided by the item's score for its own text,
so 1 is a full match. Items are in blocks, and each block has the largest weight of each term.
As in block-max WAND, a passage looks into a block only if the sum of these maxima over its
terms can reach the threshold: the commonest terms of a block are left out of that sum as
long as together they stay below a slack, which is added instead. All items that reach the
threshold are retrieved, and then verified: question and answer must both be in the passage,
by their shingles or as a run of words that few edits turn into them.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_memos, in_parts, stored
from .words import shingle_hashes, word_hashes


@dataclass(frozen=True)
class Settings:
    #: The share of an item's own BM25 score from which a passage is looked at, or the share
    #: that is left without the words that verification allows to be missing, if it is smaller.
    score: float = 0.5
    shingle: int = 5
    #: The share of an item's question shingles, and of its answer's, that a passage must hold;
    #: or else the share of words that edits leave of each.
    overlap: float = 0.8
    k1: float = 1.2
    b: float = 0.75
    block: int = 4
    slack: float = 0.25
    #: Bytes of item texts in one index; more items are matched in several indexes, one after another.
    index_bytes: int = 4_000_000


_SENTENCE_END = re.compile(r"[.?!:][)\"']*\s+|\n+")


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence or line is the answer, what is before it the question; one alone is both."""
    text = text.strip()
    ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, text)


def _words_of(text: str) -> np.ndarray:
    return word_hashes(pa.array([text]), punctuation=False)[0]


def edited_at(part: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each end in ``words``, the fewest edits that turn a run of words ending there into the part.

    An edit replaces, drops or inserts one word.
    """
    steps = np.arange(len(words) + 1)
    fewest = np.zeros(len(words) + 1, np.int64)
    for i, word in enumerate(part, 1):
        new = np.empty_like(fewest)
        new[0] = i
        new[1:] = np.minimum(fewest[:-1] + (words != word), fewest[1:] + 1)
        # Words inserted after any earlier end.
        fewest = np.minimum.accumulate(new - steps) + steps
    return fewest


def _common(x: list, y: list) -> int:
    """The length of the longest common subsequence."""
    row = [0] * (len(y) + 1)
    for a in x:
        row, last = [0], row
        for k, b in enumerate(y):
            row.append(last[k] + 1 if a == b else max(last[k + 1], row[k]))
    return row[-1]


def _beside(part: np.ndarray, other: np.ndarray, words: np.ndarray) -> float:
    """The largest share of a short part that follows the places where the other part is best met."""
    ends = edited_at(other, words)
    best = np.flatnonzero(ends == ends.min())
    return max(_common(part.tolist(), words[e : e + len(part) + 1].tolist()) for e in best) / len(part)


@dataclass
class _Class:
    """The items of similar length: passages are two cells of ``stride`` words."""

    stride: int
    items: list[int]  # places in the index's item list
    n_blocks: int
    pairs_from: np.ndarray  # by term: where its (block, maximum) pairs begin
    pair_block: np.ndarray
    pair_most: np.ndarray
    slack: np.ndarray  # by block: the bound of the terms that have no pairs
    block_terms: list[np.ndarray]
    block_weights: list[np.ndarray]  # by block: terms x items


class Index:
    """BM25 weights of one set of items."""

    def __init__(self, items: list[tuple[object, str]], frequency: dict[int, int], n_items: int, mean_words: float, s: Settings):
        self.settings, self.ids, self.parts, self.scale = s, [], [], []
        lengths, weights = [], []
        for item_id, text in items:
            words = _words_of(text)
            if not len(words):
                continue
            own = {}
            for w, tf in Counter(words.tolist()).items():
                df = frequency[w]
                idf = math.log(1 + (n_items - df + 0.5) / (df + 0.5))
                own[w] = idf * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * len(words) / mean_words))
            total = sum(own.values())
            self.ids.append(item_id)
            lengths.append(len(words))
            parts = [p for p in map(_words_of, question_and_answer(text)) if len(p)]
            self.parts.append([(min(s.shingle, len(p)), np.unique(shingle_hashes(p, s.shingle)), p) for p in parts])
            share = {w: v / total for w, v in own.items()}
            # Weights are scaled so that all items have the same threshold.
            self.scale.append(s.score / min(s.score, max(1 - self._missing(self.parts[-1], share), 0.01)))
            weights.append({w: v * self.scale[-1] for w, v in share.items()})
            # Words that edits may insert are in one passage with the others.
            lengths[-1] += sum(int((1 - s.overlap) * len(p) + 1e-9) for p in parts)
        self.vocabulary = np.unique(np.array([w for own in weights for w in own], np.uint64))
        place = {w: i for i, w in enumerate(self.vocabulary.tolist())}
        by_class: dict[int, list[int]] = {}
        for i, n in enumerate(lengths):
            by_class.setdefault(max(32, 1 << (n - 1).bit_length()), []).append(i)
        self.marks = np.zeros(len(self.vocabulary) + 1, bool)
        self.places = np.full(len(self.vocabulary) + 1, -1, np.int32)
        self.classes = [self._class(stride, own, weights, place) for stride, own in sorted(by_class.items())]

    def _missing(self, parts: list[tuple], share: dict[int, float]) -> float:
        """The most of an item's score that a verified passage may lack."""
        s, lost = self.settings, 0.0
        if len(parts) == 2 and np.array_equal(parts[0][2], parts[1][2]):
            parts = parts[:1]
        for size, shingles, own in parts:
            edits = int((1 - s.overlap) * len(own) + 1e-9)
            if len(parts) > 1 and 1 < len(own) < s.shingle:
                edits = 1
            # Each missing word is in a missing shingle of its own, as its first or its last
            # word; with repeated shingles two words may share one.
            gone = int((1 - s.overlap) * len(shingles) + 1e-9) * (1 if len(shingles) == len(own) - size + 1 else 2)
            lost += sum(sorted((share[w] for w in set(own.tolist())), reverse=True)[: max(edits, gone)])
        return lost

    def _class(self, stride, items, weights, place) -> _Class:
        s, rows, slack, block_terms, block_weights = self.settings, [], [], [], []
        for b, at in enumerate(range(0, len(items), s.block)):
            part = items[at : at + s.block]
            terms = sorted({place[w] for i in part for w in weights[i]})
            of_term = {t: k for k, t in enumerate(terms)}
            table = np.zeros((len(terms), len(part)))
            for k, i in enumerate(part):
                for w, v in weights[i].items():
                    table[of_term[place[w]], k] = v
            most, common = table.max(1), (table > 0).sum(1)
            order = np.lexsort((most, -common))
            rest = np.cumsum(most[order]) <= s.slack
            slack.append(most[order][rest].sum())
            rows += [(terms[k], b, most[k]) for k in order[~rest]]
            block_terms.append(np.array(terms))
            block_weights.append(table)
        rows.sort()
        terms = np.array([r[0] for r in rows], np.int64)
        return _Class(
            stride, items, len(slack), np.searchsorted(terms, np.arange(len(place) + 1)), np.array([r[1] for r in rows], np.int64),
            np.array([r[2] for r in rows]), np.array(slack), block_terms, block_weights,
        )

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item, best score, question overlap, answer overlap) of verified matches."""
        words, ends = word_hashes(texts, punctuation=False)
        if not len(words) or not len(self.vocabulary):
            return
        term = np.searchsorted(self.vocabulary, words)
        known = self.vocabulary[np.minimum(term, len(self.vocabulary) - 1)] == words
        term[~known] = -1
        row_of = np.repeat(np.arange(len(texts)), np.diff(ends))
        for c in self.classes:
            yield from self._hits_of_class(c, words, ends, term, row_of)

    def _hits_of_class(self, c: _Class, words, ends, term, row_of):
        s = self.settings
        # Cells do not cross texts; each text has an empty one at its end.
        cells_before = np.concatenate([[0], np.cumsum(-(-np.diff(ends) // c.stride) + 1)])
        places = np.flatnonzero(term >= 0)
        places = places[c.pairs_from[term[places] + 1] > c.pairs_from[term[places]]]
        cells = cells_before[row_of[places]] + (places - ends[row_of[places]]) // c.stride
        # As many cells at a time as keep the table of sums small.
        step = max(min(1_000_000 // c.n_blocks, int(cells_before[-1])), 1)
        found: dict[tuple[int, int], tuple] = {}
        for low in range(0, int(cells_before[-1]), step):
            here = slice(*np.searchsorted(cells, [low, low + step + 1]))
            own, at = term[places[here]], cells[here] - low
            many = c.pairs_from[own + 1] - c.pairs_from[own]
            if not many.sum():
                continue
            pair = np.repeat(c.pairs_from[own] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            sums = np.bincount(np.repeat(at, many) * c.n_blocks + c.pair_block[pair], c.pair_most[pair], (step + 2) * c.n_blocks).reshape(-1, c.n_blocks)
            both = sums[:step] + sums[1 : step + 1]
            near, blocks = np.nonzero(both + c.slack >= s.score - 1e-9)
            near += low
            rows = np.searchsorted(cells_before, near, "right") - 1
            near, blocks, rows = (x[rows < len(ends) - 1] for x in (near, blocks, rows))
            firsts = ends[rows] + (near - cells_before[rows]) * c.stride
            stops = np.minimum(firsts + 2 * c.stride, ends[rows + 1])
            for i in self._reaching(c, blocks, firsts, stops, term):
                row, block, window = int(rows[i]), blocks[i], slice(firsts[i], stops[i])
                for item, score, overlaps in self._look(c, int(block), words[window], term[window]):
                    if (row, item) not in found or found[row, item] < (score, *overlaps):
                        found[row, item] = (score, *overlaps)
        for (row, item), values in sorted(found.items()):
            yield row, item, *values

    def _reaching(self, c: _Class, blocks: np.ndarray, firsts: np.ndarray, stops: np.ndarray, term: np.ndarray) -> Iterator[int]:
        """The places of those passages in which an item of the block beside them may reach the threshold.

        Scores of many passages are summed at once, so in another order than one alone: the
        threshold is a little lower here.
        """
        order = np.argsort(blocks, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
            if not len(own):
                continue
            terms, weights = c.block_terms[blocks[own[0]]], c.block_weights[blocks[own[0]]]
            # The last place takes the words that no item has.
            self.places[terms] = np.arange(len(terms))
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                many = np.maximum(stops[part] - firsts[part], 0)
                begins = np.cumsum(many) - many
                here = self.places[term[np.repeat(firsts[part] - begins, many) + np.arange(many.sum())]]
                held = np.zeros((len(part), len(terms)), bool)
                held[np.repeat(np.arange(len(part)), many)[here >= 0], here[here >= 0]] = True
                passage, which = np.nonzero(held)
                best = np.max([np.bincount(passage, weight[which], len(part)) for weight in weights.T], axis=0)
                yield from part[best >= self.settings.score - 1e-8].tolist()
            self.places[terms] = -1

    def _look(self, c: _Class, block: int, words: np.ndarray, term: np.ndarray):
        """Items of a block that reach the threshold in one passage and are verified."""
        s = self.settings
        # The last place of the marks takes the words that no item has.
        self.marks[term] = True
        scores = self.marks[c.block_terms[block]] @ c.block_weights[block]
        self.marks[term] = False
        for k in np.flatnonzero(scores >= s.score - 1e-9):
            item = c.items[block * s.block + int(k)]
            overlaps = self._overlaps(self.parts[item], words)
            if overlaps:
                yield item, float(scores[k]) / self.scale[item], (overlaps[0], overlaps[-1])

    def _overlaps(self, parts: list[tuple], words: np.ndarray) -> list[float]:
        """The share of each part that a passage holds; none if one of them is not verified.

        A part of fewer words than a shingle may lack one of them right beside the other part.
        """
        s, found = self.settings, []
        for size, shingles, own in parts:
            there = shingle_hashes(words, size) if len(words) >= size else words[:0]
            share = float(np.isin(shingles, there).mean())
            if share < s.overlap and np.isin(own, words).mean() >= s.overlap - 1e-9:
                share = max(share, float(1 - edited_at(own, words).min() / len(own)))
            found.append(share)
        missing = [k for k, share in enumerate(found) if share < s.overlap - 1e-9]
        if not missing:
            return found
        if len(missing) > 1 or len(parts) == 1:
            return []
        (k,) = missing
        own, other = parts[k][2], parts[1 - k][2]
        if not 1 < len(own) < s.shingle:
            return []
        # A question is in front of its answer, so there both are read backwards.
        share = _beside(own, other, words) if k else _beside(own[::-1], other[::-1], words[::-1])
        found[k] = max(found[k], share)
        return found if share >= 1 - 1 / len(own) - 1e-9 else []


def _indexes(benchmark: DataFrame, s: Settings, text: str, item_id: str) -> Iterator[Index]:
    """Indexes of a bounded number of bytes each, with the statistics of all items."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ends = word_hashes(batch.column(1), punctuation=False)
            own = [np.unique(words[ends[i] : ends[i + 1]]).view(np.int64) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.int64())), pa.array(np.diff(ends))], names=["item_id", "item", "terms", "n"])

    kind = benchmark.schema[item_id].dataType.simpleString()
    items = benchmark.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("item"))
    items = stored(items.mapInArrow(terms, f"item_id {kind}, item string, terms array<long>, n long").where("n > 0"), "op10-items")
    frequency = stored(items.select(F.explode("terms").alias("term")).groupBy("term").count(), "op10-terms")
    total, n_items, n_words = items.agg(F.sum(F.octet_length("item")), F.count("*"), F.sum("n")).first()
    shards = -(-(total or 0) // s.index_bytes)
    shard = F.pmod(F.xxhash64("item_id", "item"), F.lit(max(shards, 1)))
    for k in range(shards):
        own = items.where(shard == k)
        met = own.select(F.explode("terms").alias("term")).distinct().join(frequency, "term").toPandas()
        counts = dict(zip(met["term"].to_numpy(np.int64).view(np.uint64).tolist(), met["count"].tolist(), strict=True))
        rows = sorted(own.select("item_id", "item").collect(), key=lambda r: (str(r[0]), r[1]))
        yield Index([(r[0], r[1]) for r in rows], counts, n_items, n_words / n_items, s)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id"
) -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap): items held by documents.

    Words are runs without ASCII white space and punctuation, A-Z lower-cased. A document is
    read whole, in overlapping passages that are at least twice as long as the item. Null and
    empty texts and items match nothing. Repeated documents and items give repeated rows.
    A part of an item is met by 0.8 of its shingles, or if at most a fifth of its words are
    edited (replaced, dropped or inserted); of a part of two to four words one word may be
    missing right beside the other part, a single word must occur. The overlaps are the shares
    met. Further columns are not looked at. No documents or no items: no rows.
    """
    id_kind, item_kind = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {id_kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for index in _indexes(benchmark, settings, "text", item_id):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            drop_memos()
            for batch in in_parts(batches):
                hits = list(shared.value.hits(batch.column(1)))
                at = pa.array([h[0] for h in hits], pa.int64())
                items = pa.array([shared.value.ids[h[1]] for h in hits], batch_item_type)
                rest = [pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), items, *rest], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        batch_item_type = pa.string() if item_kind == "string" else pa.int64() if item_kind == "bigint" else pa.int32()
        found = found.unionByName(rows.mapInArrow(run, schema))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The documents that hold no test item, as find_contamination sees it; columns stay."""
    for index in _indexes(benchmark, settings, "text", item_id):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            drop_memos()
            for batch in in_parts(batches):
                clean = np.ones(batch.num_rows, bool)
                clean[[h[0] for h in shared.value.hits(batch.column(batch.schema.names.index(text)).cast(pa.string()))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
