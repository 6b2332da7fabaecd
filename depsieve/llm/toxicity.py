"""Toxicity by a bag of subwords: averaged n-gram embeddings under a linear softmax.

Every word contributes its character n-grams (with word edges marked), hashed into a fixed
number of rows of an embedding table. A text is the mean of its rows, a
word weighing by the square root of its number, so that a text that repeats one word is not
judged by it alone; a linear softmax over
that mean gives the two classes. Table and softmax are trained together in numpy. A word that
was never seen still shares n-grams with words that were, which is what catches misspellings.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, drop_memos, in_parts, texts_of, without, worker_memo

#: Distinct words whose sums a worker keeps; it starts anew when there are more.
MEMO_WORDS = 200_000
#: Words whose n-grams are worked out together.
WORDS_AT_ONCE = 20_000


@dataclass(frozen=True)
class Settings:
    #: The bound on labelled texts that are gathered in one task for training.
    sample_docs: int = 7_000
    buckets: int = 1 << 17
    dimensions: int = 8
    shortest: int = 3
    longest: int = 5
    epochs: int = 6
    batch: int = 64
    rate: float = 1.5
    #: How much more an error on a toxic text costs in training.
    toxic_weight: float = 3.0
    seed: int = 11


def subwords(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of the words, and the place of the word each comes from.

    FNV-1a over the bytes, with '<' and '>' at the edges of a word.
    """
    data = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes up to the word's end
    rows, owners = [], []
    h = np.full(len(data), 14695981039346656037, np.uint64)
    for n in range(1, s.longest + 1):
        m = max(len(data) - n + 1, 0)
        h = (h[:m] ^ data[n - 1 : n - 1 + m]) * np.uint64(1099511628211)
        if n >= s.shortest:
            inside = left[:m] >= n
            own = h[inside]
            rows.append(((own ^ (own >> np.uint64(29))) % np.uint64(s.buckets)).astype(np.int64))
            owners.append(word[:m][inside])
    return np.concatenate(rows), np.concatenate(owners)


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def _features(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a text and their weights: a word counts by the root of its number."""
    words = Counter(_words(text))
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    rows, owners = subwords(list(words), s)
    rows, where = np.unique(rows, return_inverse=True)
    return rows, np.bincount(where, np.sqrt(list(words.values()))[owners])


#: Weights travel as whole numbers of this part of a word.
_STEPS = 16


def _rows_of(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memos()
        for batch in in_parts(batches):
            rows, weights = zip(*[_features(t, s) for t in texts_of(batch.column(0))], strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([np.minimum(w * _STEPS + 0.5, 32767).astype(np.int16) for w in weights], pa.list_(pa.int16())), batch.column(1)],
                names=["rows", "weights", "toxic"],
            )

    return run


@dataclass(frozen=True)
class Model:
    settings: Settings
    #: Per table row, what it adds to the difference of the two classes before averaging.
    weight: np.ndarray
    bias: float


def in_order(bags: list[tuple[np.ndarray, np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Bags by kind, size and content, whatever order they came in.

    Contents are copied for comparison only among bags of one kind and size.
    """
    found = []
    for _, alike in groupby(sorted(bags, key=lambda b: (b[2], len(b[0]))), key=lambda b: (b[2], len(b[0]))):
        found += sorted(alike, key=lambda b: (b[0].tobytes(), b[1].tobytes()))
    return found


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> Model:
    """Joint training of table and softmax by minibatch AdaGrad on the cross entropy."""
    rng = np.random.default_rng(s.seed)
    table = rng.normal(0, 0.1, (s.buckets, s.dimensions)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (s.dimensions, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_t, seen_s, seen_b = np.full(s.buckets, 1e-8, np.float32), np.full_like(soft, 1e-8), np.full(2, 1e-8, np.float32)
    bags = [b for b in bags if len(b[0])]
    for _ in range(s.epochs):
        for at in range(0, len(bags), s.batch):
            if at == 0:
                order = rng.permutation(len(bags))
            part = [bags[i] for i in order[at : at + s.batch]]
            sizes = np.array([len(b[0]) for b in part])
            rows = np.concatenate([b[0] for b in part])
            share = np.concatenate([b[1] / b[1].sum() for b in part]).astype(np.float32)
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(table[rows] * share[:, None], begins, axis=0)
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            off = p.copy()
            off[np.arange(len(part)), [b[2] for b in part]] -= 1
            off *= np.array([s.toxic_weight if b[2] else 1.0 for b in part])[:, None]
            to_mean = off @ soft.T
            each = np.repeat(np.arange(len(part)), sizes)
            distinct, where = np.unique(rows, return_inverse=True)
            grad = np.stack([np.bincount(where, share * to_mean[each, k], len(distinct)) for k in range(s.dimensions)], 1).astype(np.float32)
            seen_t[distinct] += (grad**2).mean(1)
            table[distinct] -= s.rate * grad / np.sqrt(seen_t[distinct])[:, None]
            g = mean.T @ off / len(part)
            seen_s += g**2
            soft -= s.rate * g / np.sqrt(seen_s)
            g = off.mean(0)
            seen_b += g**2
            bias -= s.rate * g / np.sqrt(seen_b)
    return Model(s, (table @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> Model:
    """Learn from at most ``settings.sample_docs`` labelled texts, picked by the hash of their id.

    ``labels`` has doc_id and toxic (0 or 1); null labels and ids without a text are left out,
    of an id with several labels the larger counts, of an id with several texts the smallest
    text. With no labelled text, or labels of one kind only, every score is that kind's share.
    """
    picked = (
        labels.where(f"{doc_id} is not null and toxic is not null")
        .groupBy(doc_id)
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64(doc_id), doc_id)
        .limit(settings.sample_docs)
    )
    # Broadcast of ids and labels: at most sample_docs rows of two numbers.
    met = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(picked), doc_id)
    met = met.groupBy(doc_id, "toxic").agg(F.min("_text").alias("_text")).select("_text", "toxic")
    bags = met.mapInArrow(_rows_of(settings), "rows array<int>, weights array<smallint>, toxic int")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_memos()
        known = []
        for batch in batches:
            for rows, weights, toxic in zip(*batch.columns, strict=True):
                known.append((rows.values.to_numpy(), weights.values.to_numpy(), min(max(toxic.as_py(), 0), 1)))
        model = train(in_order(known), settings)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight], pa.list_(pa.float64())), pa.array([model.bias])], names=["weight", "bias"])

    # One task, and so one machine, for at most sample_docs texts.
    found = bags.repartition(1).mapInArrow(learn, "weight array<double>, bias double").toArrow()
    return Model(settings, found.column("weight")[0].values.to_numpy(), found.column("bias")[0].as_py())


def score(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = False, output: str = "score") -> DataFrame:
    """The input with ``output``, the score between 0 and 1, of every whole text.

    Null and empty texts have no subwords: their score is that of the bias alone. A
    column of that name is replaced. The broadcast model has one number per table row.
    """
    s = model.settings
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    kept = without(docs.schema, (output, *([text] if drop_text else [])))
    schema = T.StructType([*kept, T.StructField(output, T.DoubleType())])
    names = kept.names
    key = f"{hash(model.weight.tobytes())} {model.bias}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value

        def sums(words: list[bytes]) -> Iterator[complex]:
            """For each word the sum of its rows' weights, and their number."""
            for at in range(0, len(words), WORDS_AT_ONCE):
                part = words[at : at + WORDS_AT_ONCE]
                rows, owners = subwords(part, s)
                total = np.bincount(owners, weight[rows], len(part)) + 1j * np.bincount(owners, minlength=len(part))
                yield from total.tolist()

        memo = worker_memo(("toxicity", key), dict)
        for batch in in_parts(batches):
            out = np.full(batch.num_rows, bias)
            for i, t in enumerate(texts_of(batch.column(batch.schema.names.index(text)))):
                if not (words := Counter(_words(t))):
                    continue
                new = [w for w in words if w not in memo]
                if len(memo) + len(new) > MEMO_WORDS:
                    memo.clear()
                    new = list(words)
                memo.update(zip(new, sums(new), strict=True))
                each = np.fromiter(map(memo.__getitem__, words), np.complex128, len(words))
                total = (each * np.sqrt(np.fromiter(words.values(), float, len(words)))).sum()
                out[i] += total.real / total.imag
            yield add_columns(batch, names, **{output: pa.array(1 / (1 + np.exp(-np.clip(out, -700, 700))))})

    return docs.mapInArrow(run, schema)
