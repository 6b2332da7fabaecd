"""Word-piece lengths of texts by a linear longest-match automaton.

The automaton is the trie of the vocabulary with failure links, as published by Song et al.
(Fast WordPiece Tokenization, 2021). Where the trie cannot go on, the failure link says where
matching resumes, and the number of pieces popped on the way was worked out beforehand: the
count needs no pieces and never goes back over a character.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, texts_of, without, worker_memo

WORD_START = "▁"
#: Distinct words whose counts a worker keeps; it starts anew when there are more.
MEMO_WORDS = 400_000
NONE = -1


@dataclass(frozen=True)
class PieceAutomaton:
    """Transitions by (state, character), failure links and the counts popped along them."""

    go: dict[tuple[int, str], int]
    fail: list[int]
    pops: list[int]
    inner: int  # the state between two pieces of one word

    def count(self, word: str) -> int:
        """Pieces of a word, greedily the longest first; -1 if it can't be cut up."""
        go, fail, pops = self.go, self.fail, self.pops
        state, pieces = 0, 0
        for char in word:
            following = go.get((state, char), NONE)
            while following == NONE:
                pieces += pops[state]
                state = fail[state]
                if state == NONE:
                    return -1
                following = go.get((state, char), NONE)
            state = following
        while state not in (self.inner, 0):
            pieces += pops[state]
            state = fail[state]
            if state == NONE:
                return -1
        return pieces


def build_automaton(first: set[str], later: set[str]) -> PieceAutomaton:
    """From the pieces that may start a word and those that may follow."""
    go: dict[tuple[int, str], int] = {}
    is_piece = [False, False]
    children: list[list[tuple[str, int]]] = [[], []]
    for root, pieces in ((0, first), (1, later)):
        for piece in pieces:
            state = root
            for char in piece:
                if (state, char) not in go:
                    go[state, char] = len(is_piece)
                    children[state].append((char, len(is_piece)))
                    is_piece.append(False)
                    children.append([])
                state = go[state, char]
            is_piece[state] = state > 1
    fail, pops = [NONE] * len(is_piece), [0] * len(is_piece)
    layers = [0, 1]
    while layers:
        below = []
        for parent in layers:
            for char, child in children[parent]:
                below.append(child)
                if is_piece[child]:
                    fail[child], pops[child] = 1, 1
                    continue
                at, popped = fail[parent], pops[parent]
                while at != NONE and (at, char) not in go:
                    popped += pops[at]
                    at = fail[at]
                if at != NONE:
                    fail[child], pops[child] = go[at, char], popped
        layers = below
    return PieceAutomaton(go, fail, pops, 1)


def sentencepiece_vocabulary(path: str) -> tuple[set[str], set[str]]:
    """(pieces at a word's start, pieces inside) of a public vocabulary file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    first = {p[1:] for p in pieces if p.startswith(WORD_START) and len(p) > 1}
    return first, {p for p in pieces if WORD_START not in p}


class _Counts(dict):
    """Word to its piece count, worked out at the first meeting."""

    def __init__(self, automaton: PieceAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = self.automaton.count(word.decode("utf-8", "replace"))
        return found


NEW = ("n_words", "n_tokens", "n_unknown")


def token_counts(docs: DataFrame, vocabulary_path: str, text: str = "text", drop_text: bool = False) -> DataFrame:
    """The input with n_words, n_tokens and n_unknown.

    Words end at ASCII white space; each is cut greedily into the longest pieces. A word
    that can't be cut up is one unknown token. Null and empty texts have 0 of each. A result
    column replaces an input column of its name. No rows in, no rows out. The vocabulary is
    read on the driver and sent once to each executor; its size is that of the file.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(build_automaton(*sentencepiece_vocabulary(vocabulary_path)))
    gone = (*NEW, *([text] if drop_text else []))
    kept = without(docs.schema, gone)
    schema = T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in NEW]])
    names = kept.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_memo(("pieces", vocabulary_path), lambda: _Counts(automaton.value))
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, t in enumerate(texts_of(batch.column(batch.schema.names.index(text)))):
                words = t.encode("utf-8", "replace").split()
                counts = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                unknown = int((counts < 0).sum())
                out[:, i] = len(words), counts.sum() + 2 * unknown, unknown
            yield add_columns(batch, names, **{n: pa.array(out[i]) for i, n in enumerate(NEW)})

    return docs.mapInArrow(run, schema)
