"""Language-model scores from a subword lattice.

A word's lattice has an arc for every vocabulary piece (and every byte) in it, and one arc for
the whole word where the training texts have it. Piece weights start from the scores of an
existing vocabulary and are fitted to the training words by expectation maximisation; the
arc of the whole word has its discounted share of the training tokens, and what the discount
leaves is the weight of the pieces. The forward recursion in log space sums over all
segmentations. Words come in bursts: a text draws its words from an urn that holds the lattice
distribution and, after each draw, one more ball of the word drawn (Dirichlet compound
multinomial). The probability of the text depends on the counts of its words only.

Texts are gathered in blocks of a bounded size. A block keeps its texts as numbers of its
own words; only (block, word) rows travel, once to be counted and once to bring back scores.
"""

import math
import os
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts_of, whole_text

LN10 = math.log(10)


@dataclass(frozen=True)
class Settings:
    block_bytes: int = 12_000_000
    #: Taken from the count of each training word and given to the pieces.
    discount: float = 0.5
    #: Rounds of expectation maximisation, and the weight of the vocabulary's own scores in them.
    rounds: int = 3
    prior: float = 1000.0
    #: How many words of its own a text must have to weigh as much as the lattice.
    concentration: float = 1000.0
    #: The smoothing of the base model.
    added: float = 0.1


_POWER = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary as byte strings with a weight each; single bytes are always in it."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        weight: dict[bytes, float] = {bytes([b]): 1e-4 for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                piece = model.id_to_piece(i).replace("▁", "").encode()
                if piece:
                    # Scores fall with the rank of a piece; a share by rank is what they stand for.
                    weight[piece] = max(weight.get(piece, 0), 1 / (1 + abs(model.get_score(i))))
        self.longest = max(map(len, weight))
        self.tables: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
        names = sorted(weight, key=lambda p: (len(p), p))
        for size in range(1, self.longest + 1):
            own = [i for i, p in enumerate(names) if len(p) == size]
            hashes = np.array([self._hash(names[i]) for i in own], np.uint64)
            order = np.argsort(hashes)
            self.tables.append((hashes[order], np.array(own, np.int64)[order]))
        total = sum(weight.values())
        self.start = np.array([weight[p] / total for p in names])

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_POWER) + b + 1) % 2**64
        return h

    def arcs(self, data: np.ndarray) -> list[np.ndarray]:
        """For each size (from 1) the pieces of words (rows of bytes) by start; -1 where none."""
        rows, length = data.shape
        found, h = [], np.zeros((rows, length), np.uint64)
        for size in range(1, min(self.longest, length) + 1):
            n = length - size + 1
            h = h[:, :n] * _POWER + data[:, size - 1 : size - 1 + n] + np.uint64(1)
            hashes, own = self.tables[size]
            if not len(hashes):
                found.append(np.full((rows, n), -1))
                continue
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            found.append(np.where(hashes[at] == h, own[at], -1))
        return found


def _log_gamma(z: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up."""
    down = sum(np.log(z + k) for k in range(8))
    y = z + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - down


def _urn(mass: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Log of mass * (mass + 1) * ... with as many factors as times."""
    out, more = np.log(mass), times > 1
    out[more] = _log_gamma(mass[more] + times[more]) - _log_gamma(mass[more])
    return out


def _logsum(parts: list[np.ndarray]) -> np.ndarray:
    stack = np.stack(parts)
    top = stack.max(0)
    return top + np.log(np.exp(stack - top).sum(0))


def _forward(arcs: list[np.ndarray], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """Log probability of all ways to each place. weights: by piece, and -inf at the end for none."""
    ways = [np.zeros(len(arcs[0]))]
    for end in range(1, length + 1):
        ways.append(_logsum([ways[end - k] + weights[arcs[k - 1][:, end - k]] for k in range(1, min(len(arcs), end) + 1)]))
    return ways


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows of bytes) of words of one length, some thousands at a time."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        length = int(sizes[own[0]])
        step = max(4096 // max(length // 16, 1), 1)
        for at in range(0, len(own), step):
            part = own[at : at + step]
            if length:
                data = np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), length)
                yield part, data.astype(np.uint64)


def word_log_probabilities(words: list[bytes], pieces: Pieces, log_share: np.ndarray, log_stop: float) -> np.ndarray:
    """Natural log of the sum over all segmentations of each word, its end included."""
    weights = np.append(log_share, -np.inf)
    out = np.full(len(words), log_stop)
    for part, data in _by_length(words):
        out[part] += _forward(pieces.arcs(data), weights, data.shape[1])[-1]
    return out


def expected_counts(words: list[bytes], pieces: Pieces, log_share: np.ndarray) -> np.ndarray:
    """How often each piece is used, over all segmentations of the words by their probability."""
    weights = np.append(log_share, -np.inf)
    total = np.zeros(len(log_share) + 1)
    for _, data in _by_length(words):
        length = data.shape[1]
        arcs = pieces.arcs(data)
        ahead = _forward(arcs, weights, length)
        back = [None] * length + [np.zeros(len(data))]
        for start in range(length - 1, -1, -1):
            back[start] = _logsum([weights[arcs[k - 1][:, start]] + back[start + k] for k in range(1, min(len(arcs), length - start) + 1)])
        for k, own in enumerate(arcs, 1):
            ways = np.stack(ahead[: own.shape[1]], 1) + weights[own] + np.stack(back[k:], 1) - ahead[-1][:, None]
            total += np.bincount(own.ravel() % len(total), np.exp(ways).ravel(), len(total))
    return total[:-1]


def _blocks(rows: DataFrame, s: Settings) -> DataFrame:
    """A row per block: its documents, its distinct words and the numbers of each text."""

    def pack(ids, held, texts) -> pa.RecordBatch:
        index: dict[bytes, int] = defaultdict(count().__next__)
        each = [np.fromiter(map(index.__getitem__, t.encode("utf-8", "replace").lower().split()), np.int32) for t in texts]
        train = np.zeros(len(index), np.int64)
        numbers, times, sizes = [], [], []
        for tokens, out in zip(each, held, strict=True):
            own, often = np.unique(tokens, return_counts=True)
            if not out:
                train[own] += often
            numbers.append(np.diff(own, prepend=0).astype(np.int32))
            times.append(often.astype(np.int32))
            sizes.append(len(own))
        squeeze = zstandard.ZstdCompressor(level=1).compress
        packed = [squeeze(np.concatenate([*x, np.empty(0, np.int32)]).tobytes()) for x in (numbers, times)]
        columns = {
            "block": pa.array([int.from_bytes(os.urandom(8), "little", signed=True)], pa.int64()),
            "doc_ids": pa.array([ids], pa.list_(pa.int64())),
            "held_out": pa.array([held], pa.list_(pa.bool_())),
            "n_words": pa.array([[len(t) for t in each]], pa.list_(pa.int64())),
            "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "numbers": pa.array([packed[0]], pa.binary()),
            "times": pa.array([packed[1]], pa.binary()),
            "words": pa.array([list(index)], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
            "train": pa.array([train], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                ids.append(i)
                held.append(h)
                texts.append(t)
                size += len(t) + 16
                if size >= s.block_bytes:
                    yield pack(ids, held, texts)
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield pack(ids, held, texts)

    schema = (
        "block long, doc_ids array<long>, held_out array<boolean>, n_words array<long>, sizes array<long>, numbers binary, times binary, "
        "words array<string>, train array<long>"
    )
    return rows.mapInArrow(run, schema)


def _fit_pieces(words: DataFrame, pieces: Pieces, s: Settings) -> tuple[np.ndarray, float]:
    """(log share of each piece, log share of the end) after some rounds over all training words."""
    spark, share = words.sparkSession, pieces.start
    n_words = words.count()
    stop = 0.3
    for _ in range(s.rounds if n_words else 0):
        shared = spark.sparkContext.broadcast((pieces, np.log(share)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                total = total + expected_counts([w.encode() for w in batch.column(0).to_pylist()], *shared.value)
            used = np.flatnonzero(total) if not np.isscalar(total) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used] if len(used) else np.empty(0))], names=["piece", "n"])

        # At most one row for each piece of the vocabulary.
        counts = words.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        fitted = s.prior * pieces.start
        np.add.at(fitted, counts["piece"].to_numpy(), counts["n"].to_numpy())
        stop = n_words / (n_words + counts["n"].sum())
        share = fitted / fitted.sum()
    return np.log(share) + math.log(1 - stop), math.log(stop) - math.log(1 - stop)


def score_texts(docs: DataFrame, held_out, vocabulary_path: str, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a boolean column: the model learns from all other rows. Words are runs
    without ASCII white space, A-Z lower-cased; each text ends in one more token. base_score is
    that of a unigram model with ``added`` smoothing, score that of the lattice; both are
    log10 of the text's probability. Null and empty texts consist of their end. Without
    training rows there are no whole-word arcs and half the weight is the end's. Rows that
    repeat are scored alike, each counting in training. Further columns are not looked at.
    No rows in, no rows out.
    """
    s, spark = settings, docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), whole_text(text).alias("text"))
    blocks = stored(_blocks(rows, s), "op7-blocks")
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("place", "w")).select("block", "place", "w.words", "w.train")
    counted = stored(words.groupBy("words").agg(F.sum("train").alias("c")), "op7-words")
    n_ends = blocks.select(F.explode("held_out").alias("h")).where("not h").count()
    n_seen, kinds = counted.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n_seen + n_ends, kinds + (n_ends > 0)

    pieces = Pieces(vocabulary_path)
    log_share, log_stop = _fit_pieces(counted.where("c > 0").select("words"), pieces, s)
    left = s.discount * kinds / n if n_seen else 0.5  # the pieces' part
    shared = spark.sparkContext.broadcast((pieces, log_share, log_stop))

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = word_log_probabilities([w.encode() for w in batch.column(0).to_pylist()], *shared.value)
            c = batch.column(1).to_numpy()
            whole = np.maximum(c - s.discount, 0) / max(n, 1)
            both = np.logaddexp(np.log(np.maximum(whole, 1e-300)), math.log(left) + found) / LN10
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(both)], names=["words", "c", "p"])

    scored = counted.mapInArrow(score_words, "words string, c long, p double")
    below = math.log10(n + s.added * (v + 1)) if n + v else 0.0
    base = lambda c: np.log10(c + s.added) - below
    end_score = math.log10(n_ends / n) if n_ends else math.log10(0.5)
    end = (float(base(n_ends)), end_score, int(n_ends > 0))

    def gather(block: pa.Table, met: pa.Table) -> pa.Table:
        out = {}
        order = np.argsort(met.column("place").to_numpy())
        c, p = met.column("c").to_numpy()[order], met.column("p").to_numpy()[order]
        row = {k: block.column(k)[0] for k in ("doc_ids", "held_out", "n_words", "sizes", "numbers", "times")}
        unpack = lambda k: np.frombuffer(zstandard.decompress(row[k].as_py()), np.int32)
        deltas, times = unpack("numbers").astype(np.int64), unpack("times").astype(np.float64)
        sizes = np.array(row["sizes"].as_py(), np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        running = np.concatenate([[0], np.cumsum(deltas)])
        numbers = running[1:] - np.repeat(running[ends[:-1]], sizes)
        each = np.repeat(np.arange(len(sizes)), sizes)
        total = lambda x: np.bincount(each, x, len(sizes))
        out["doc_id"], out["held_out"] = pa.array(row["doc_ids"].as_py(), pa.int64()), pa.array(row["held_out"].as_py())
        out["n_tokens"] = pa.array(np.array(row["n_words"].as_py(), np.int64) + 1)
        out["n_known"] = pa.array(total(times * (c[numbers] > 0)).astype(np.int64) + end[2])
        out["train_tokens"] = pa.array(np.full(len(sizes), n, np.int64))
        out["base_score"] = pa.array(total(times * base(c[numbers])) + end[0])
        size = s.concentration
        n_tokens = np.array(row["n_words"].as_py(), np.int64) + 1.0
        own = total(_urn(size * 10 ** p[numbers], times)) + math.log(size) + end[1] * LN10
        out["score"] = pa.array((own - _log_gamma(size + n_tokens) + _log_gamma(np.array([size]))) / LN10)
        return pa.table(out)

    met = words.select(F.col("block").alias("of_block"), "place", "words").join(scored, "words").select("of_block", "place", "c", "p")
    own = blocks.select("block", "doc_ids", "held_out", "n_words", "sizes", "numbers", "times")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return own.groupBy("block").cogroup(met.groupBy("of_block")).applyInArrow(gather, schema)
