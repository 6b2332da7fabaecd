"""Token counts, byte-level BPE, exact deduplication and language-model scores."""

import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from depsieve.llm import byte_bpe, exact_dedup, lm_scoring, token_counts
from depsieve.llm.common import crc_bucket

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, "The cat's  pyjamas\n\n\t are 12345 ½ Ünïcode 日本語 🙂!!", "x"),
    (2, None, "x"),
    (3, "", None),
    (4, " \t\n", "y"),
    (None, "the CAT", "y"),
    (6, "the cat", "y"),
    (6, "the cat", "y"),
    (7, "ab" * 40_000, "z"),
    (8, "word " * 30_000, "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, n_words string")


def test_token_counts(docs):
    first, later = token_counts.sentencepiece_vocabulary(PIECES)

    def greedy(word):
        pieces, at = 0, 0
        while at < len(word):
            size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in (later if at else first)), 0)
            if not size:
                return None
            at, pieces = at + size, pieces + 1
        return pieces

    rows = token_counts.token_counts(docs, PIECES).collect()
    assert len(rows) == len(ODD)
    for (_, text, _), row in zip(ODD, rows, strict=True):
        if text and len(text) > 50_000 and " " not in text:
            continue  # the greedy loop would be slow; its count is that of the halves
        words = [w.decode() for w in (text or "").encode().split()]
        found = [greedy(w) for w in words]
        assert (row.n_words, row.n_unknown) == (len(words), found.count(None))
        assert row.n_tokens == sum(1 if f is None else f for f in found)


def test_automaton_on_random_vocabularies():
    rnd = random.Random(5)
    for _ in range(60):
        word = lambda n: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, n)))
        first, later = {word(4) for _ in range(6)}, {word(4) for _ in range(6)}
        automaton = token_counts.build_automaton(first, later)
        for _ in range(60):
            text, at, pieces = word(9), 0, 0
            while at < len(text) and pieces >= 0:
                size = next((k for k in range(len(text) - at, 0, -1) if text[at : at + k] in (later if at else first)), 0)
                at, pieces = at + size, pieces + 1 if size else -1
            assert automaton.count(text) == pieces


def test_bpe_decode_joins_entries_by_row_and_takes_no_id_from_outside(spark):
    entry = {rank: token for token, rank in byte_bpe.read_ranks(BPE).items()}
    rows = [(k, None if k % 7 == 0 else [(k * 31 + j) % 50_000 for j in range(k % 5)]) for k in range(700)]
    good = spark.createDataFrame(rows, "k long, token_ids array<int>").coalesce(1)
    found = {r.k: bytes(r.decoded) for r in byte_bpe.bpe_decode(good, BPE).collect()}
    assert found == {k: b"".join(entry[i] for i in ids or []) for k, ids in rows}
    for wrong in (-1, 10**8, None):
        with pytest.raises(Exception):
            byte_bpe.bpe_decode(spark.createDataFrame([(0, [1, wrong])], good.schema), BPE).collect()


def test_bpe_equals_the_library_and_round_trips(docs):
    ranks = byte_bpe.read_ranks(BPE)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.bpe_decode(byte_bpe.bpe_encode(docs, BPE, public_tokenizers.PATTERN), BPE).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        assert row.token_ids == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()


def test_short_pieces_are_merged_as_alone():
    ranks = byte_bpe.read_ranks(BPE)
    rnd = random.Random(5)
    entries = list(ranks)
    pieces = [bytes(rnd.choices(range(256), k=rnd.randint(1, byte_bpe.SHORT))) for _ in range(2000)]
    pieces += [b"".join(rnd.choices(entries, k=3))[: byte_bpe.SHORT] for _ in range(8000)]
    pieces += [c * k for c in (b"a", b"ab", b" ") for k in range(1, byte_bpe.SHORT // 2)]
    alone = [np.array(byte_bpe.merge_bytes(p, ranks), "<i4").tobytes() for p in pieces]
    assert byte_bpe.ShortMerges(ranks).merge(pieces) == alone


def test_texts_in_groups_and_slices_are_encoded_as_alone(monkeypatch):
    ranks = byte_bpe.read_ranks(BPE)
    parts = ranks, byte_bpe.PerfectHash(ranks), byte_bpe.ShortMerges(ranks), public_tokenizers.PATTERN
    texts = ["", "One two  three\n", "x" * 70 + " \n y", "Ünï " * 40, "中文 🙂 's 12", "", "a b c d e f g h " * 9]
    alone = [byte_bpe.Encoder(*parts).encode(t).tolist() for t in texts]
    for name, value in (("GROUP_CHARS", 30), ("LIST_CHARS", 100), ("SLICE_TOKENS", 7), ("MEMO_TOKENS", 9)):
        monkeypatch.setattr(byte_bpe, name, value)
    assert [ids.tolist() for ids in byte_bpe.Encoder(*parts).encode_all(texts)] == alone


def test_perfect_hash_is_minimal_and_perfect():
    ranks = {bytes([a, b]): a * 256 + b for a in range(40) for b in range(25)}
    hashed = byte_bpe.PerfectHash(ranks)
    assert len(hashed.entries) == len(ranks) and None not in hashed.entries
    assert all(hashed.get(k) == v for k, v in ranks.items())
    assert hashed.get(b"absent") == -1


def test_exact_duplicates(spark):
    rows = [(1, "Same"), (2, "same"), (3, "SAME"), (4, "samf"), (5, None), (6, ""), (7, "é"), (8, "É"), (9, "x" * 500 + "a"), (10, "x" * 500 + "b"), (None, "null id"), (11, "null id"), (12, "twice"), (12, "twice"), (None, "alone")]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", F.col("text")), carry=("own",)).collect()
    assert len(found) == len(rows)
    groups = collections.defaultdict(list)
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    for i, t in rows:
        groups[(t or "").encode().translate(fold)].append(i)
    for row in found:
        ids = groups[(row.own or "").encode().translate(fold)]
        assert row.group_size == len(ids)
        assert row.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in found) == len(groups)
    assert sum(r.kept for r in found if r.doc_id == 12) == 1


def test_lattice_sums_over_all_segmentations():
    pieces = lm_scoring.Pieces(PIECES)
    log_share = np.log(pieces.start)
    names = {}
    for size, (hashes, own) in enumerate(pieces.tables):
        names |= dict(zip(hashes.tolist(), own.tolist(), strict=True)) if size else {}

    def brute(word):
        if not word:
            return 1.0
        return sum(
            math.exp(log_share[names[pieces._hash(word[:k])]]) * brute(word[k:]) for k in range(1, len(word) + 1) if pieces._hash(word[:k]) in names
        )

    words = [b"the", b"tion", "é".encode(), b"xq", b"anther"]
    found = lm_scoring.word_log_probabilities(words, pieces, log_share, 0.0)
    assert np.allclose(np.exp(found), [brute(w) for w in words])
    # Expected piece counts add up: pieces times their sizes cover every byte once.
    counts = lm_scoring.expected_counts(words, pieces, log_share)
    sizes = np.zeros(len(log_share))
    for size, (_, own) in enumerate(pieces.tables):
        sizes[own] = size
    assert np.isclose((counts * sizes).sum(), sum(map(len, words)))


def test_scores(spark):
    texts = ["the cat sat", "The dog sat down", None, "", "cat cat cat unseenword", "the dog"] * 4
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, ""), (None, "the end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    found = lm_scoring.score_texts(docs, crc_bucket("doc_id", 10) == 0, PIECES, lm_scoring.Settings(block_bytes=60)).collect()
    assert len(found) == len(rows)
    held = {r.doc_id: r.held_out for r in found}
    tokens = lambda t: (t or "").lower().split() + [None]
    seen = collections.Counter(w for i, t in rows if not held[i] for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    texts_of = dict(rows)
    for r in found:
        own = tokens(texts_of[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(seen[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(none, PIECES).count() == 0
    assert byte_bpe.bpe_decode(byte_bpe.bpe_encode(none, BPE, public_tokenizers.PATTERN), BPE).count() == 0
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert lm_scoring.score_texts(none, F.lit(False), PIECES).count() == 0


def test_digests_of_empty_texts():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
