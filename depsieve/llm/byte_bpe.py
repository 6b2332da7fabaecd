"""Byte-level BPE: two-tier encoding, and decoding.

A pre-token that is a vocabulary entry is resolved by a minimal perfect hash over the
vocabulary (hash, displace and compare). Any other is merged over a doubly linked list of
bytes: a long one with a heap of candidate pairs, so a run of n bytes costs O(n log n), never
n squared; the many short ones side by side in numpy, one merge of each at a time.
"""

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns, in_parts, texts_of, without, worker_memo

#: Distinct pre-tokens whose ids a worker keeps; it starts anew when there are more.
MEMO_TOKENS = 300_000
#: Characters of texts whose pre-tokens are looked up together.
GROUP_CHARS = 1_000_000
#: Bytes up to which pre-tokens are merged side by side, and how many at a time.
SHORT, SIDE_BY_SIDE = 32, 8192
#: Characters up to which a text's pre-tokens are listed at once; longer texts go in slices.
LIST_CHARS = 4_000_000
SLICE_TOKENS = 500_000
#: Rows that are decoded at once.
DECODED_ROWS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Entry to rank, from a public file of base64 entries and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_ODD, _MASK = 0x9E3779B97F4A7C15, 2**64 - 1


def _hashes(entry: bytes) -> tuple[int, int]:
    return struct.unpack("<QQ", hashlib.blake2b(entry, digest_size=16).digest())


class PerfectHash:
    """Minimal perfect hash of a fixed set of entries: n entries in n slots.

    Entries are put in buckets by one hash; each bucket, the largest first, looks for a
    displacement that sends its entries to free slots; single ones take what is left.
    """

    def __init__(self, ranks: dict[bytes, int]):
        entries = list(ranks)
        n = self.n = max(len(entries), 1)
        self.n_buckets = max(n // 2, 1)
        buckets: dict[int, list[int]] = {}
        hashes = [_hashes(e) for e in entries]
        for i, (a, _) in enumerate(hashes):
            buckets.setdefault(a % self.n_buckets, []).append(i)
        self.displace = [0] * self.n_buckets
        slots: list[int | None] = [None] * n
        order = sorted(buckets, key=lambda b: -len(buckets[b]))
        free = None
        for b in order:
            own = buckets[b]
            if len(own) == 1:
                if free is None:
                    free = iter([s for s in range(n) if slots[s] is None])
                s = next(free)
                self.displace[b] = -s - 1
                slots[s] = own[0]
                continue
            d = 1
            while True:
                at = [self._slot(*hashes[i], d) for i in own]
                if len(set(at)) == len(at) and all(slots[s] is None for s in at):
                    break
                d += 1
            self.displace[b] = d
            for s, i in zip(at, own, strict=True):
                slots[s] = i
        self.entries = [entries[i] if i is not None else None for i in slots]
        self.ranks = [ranks[e] if e is not None else -1 for e in self.entries]

    def _slot(self, a: int, b: int, d: int) -> int:
        mixed = ((b ^ (d * _ODD & _MASK)) * (a | 1)) & _MASK
        return (mixed >> 24) % self.n

    def get(self, entry: bytes) -> int:
        """The entry's rank, or -1."""
        a, b = _hashes(entry)
        d = self.displace[a % self.n_buckets]
        slot = -d - 1 if d < 0 else self._slot(a, b, d)
        return self.ranks[slot] if self.entries[slot] == entry else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of a piece after all merges, the lowest rank first and leftmost on ties.

    A candidate on the heap is one integer: rank, place of its left part and its own end.
    """
    n = len(piece)
    rank_of = ranks.get
    bits = n.bit_length()
    mask, both = (1 << bits) - 1, 2 * bits
    end = list(range(1, n + 1))  # of the part that begins here; 0 once merged into an earlier one
    before = list(range(-1, n))
    heap = []
    for i in range(n - 1):
        if (r := rank_of(piece[i : i + 2])) is not None:
            heap.append(r << both | i << bits | i + 2)
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        stop, i = top & mask, top >> bits & mask
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of its parts has changed since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := rank_of(piece[i : end[stop]])) is not None:
                push(heap, r << both | i << bits | end[stop])
        if i and (r := rank_of(piece[before[i] : stop])) is not None:
            push(heap, r << both | before[i] << bits | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ShortMerges:
    """merge_bytes for many pieces of at most SHORT bytes at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.none = self.size = max(ranks.values(), default=-1) + 1
        # Each way to put an entry together from two others.
        pairs = [
            (a * self.size + b, whole)
            for entry, whole in ranks.items()
            for k in range(1, len(entry))
            if (a := ranks.get(entry[:k])) is not None and (b := ranks.get(entry[k:])) is not None
        ]
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pairs, self.whole = np.append(pairs[:, 0], np.int64(2**63 - 1)), np.append(pairs[:, 1], self.none).astype(np.int32)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * np.int64(self.size) + b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.whole[at], self.none)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian bytes, in the order of ``pieces``."""
        found: list[bytes] = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        for at in range(0, len(order), SIDE_BY_SIDE):
            part = order[at : at + SIDE_BY_SIDE]
            for i, ids in zip(part, self._merge([pieces[i] for i in part]), strict=True):
                found[i] = ids
        return found

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        n, width = np.array([len(p) for p in pieces]), len(pieces[-1])
        place = np.arange(width)
        begins = place < n[:, None]  # a part begins at this byte
        ids = np.zeros((len(pieces), width), np.int64)
        ids[begins] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(place + 1, ids.shape).copy()
        before = np.broadcast_to(place - 1, ids.shape).copy()
        # The rank of the part that begins here with the one after it.
        rank = np.full(ids.shape, self.none, np.int32)
        both = begins[:, 1:]
        rank[:, :-1][both] = self._rank(ids[:, :-1][both], ids[:, 1:][both])
        rows = np.arange(len(pieces))
        while len(rows):
            i = rank[rows].argmin(1)  # the leftmost on ties
            least = rank[rows, i]
            rows, i, least = (x[least < self.none] for x in (rows, i, least))
            gone = after[rows, i]
            stop = after[rows, gone]
            ids[rows, i], after[rows, i] = least, stop
            begins[rows, gone], rank[rows, gone] = False, self.none
            rank[rows, i] = self.none
            on = stop < n[rows]
            r, here, there = rows[on], i[on], stop[on]
            before[r, there] = here
            rank[r, here] = self._rank(ids[r, here], ids[r, there])
            on = i > 0
            r, here = rows[on], i[on]
            there = before[r, here]
            rank[r, there] = self._rank(ids[r, there], ids[r, here])
        flat = ids[begins].astype("<i4").tobytes()
        ends = np.cumsum(begins.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Encoder:
    """Pre-token to the little-endian bytes of its ids, remembered for repeats."""

    def __init__(self, ranks: dict[bytes, int], hashed: PerfectHash, short: ShortMerges, pattern: str):
        self.ranks, self.hashed, self.short = ranks, hashed, short
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, bytes] = {}

    def _learn(self, tokens: set[str]) -> None:
        """Put the ids of tokens into the memo."""
        pieces, merged = [], []
        for token in tokens:
            own = token.encode("utf-8", "replace")
            whole = self.hashed.get(own)
            if whole >= 0:
                self.memo[token] = whole.to_bytes(4, "little")
            elif len(own) <= SHORT:
                pieces.append(own)
                merged.append(token)
            else:
                self.memo[token] = np.array(merge_bytes(own, self.ranks), "<i4").tobytes()
        self.memo.update(zip(merged, self.short.merge(pieces), strict=True))

    def _look_up(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of each list's tokens, one after another."""
        new = set().union(*lists).difference(self.memo)
        if new and len(self.memo) + len(new) > MEMO_TOKENS:
            self.memo.clear()
            new = set().union(*lists)
        self._learn(new)
        found = [b"".join(map(self.memo.__getitem__, tokens)) for tokens in lists]
        for token in new:
            if len(token) > 64:
                del self.memo[token]
        return found

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            if len(texts[at]) > LIST_CHARS:
                tokens, parts = (m.group() for m in self.pattern.finditer(texts[at])), []
                while part := list(islice(tokens, SLICE_TOKENS)):
                    parts += self._look_up([part])
                found, stop = [b"".join(parts)], at + 1
            else:
                stop, chars = at, 0
                while stop < len(texts) and len(texts[stop]) <= LIST_CHARS and (stop == at or chars + len(texts[stop]) <= GROUP_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                found = self._look_up([self.pattern.findall(t) for t in texts[at:stop]])
            yield from (np.frombuffer(f, "<i4") for f in found)
            at = stop

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", drop_text: bool = False) -> DataFrame:
    """The input with token_ids (array of int); each match of the pattern is encoded alone.

    No special tokens: their spellings are ordinary text. Null texts count as empty and get
    an empty array. A token_ids column of the input is replaced. No rows in, no rows out.
    Ranks, perfect hash and pairs are broadcast once; their size is that of the rank file.
    """
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, PerfectHash(ranks), ShortMerges(ranks)))
    kept = without(docs.schema, ("token_ids", *([text] if drop_text else [])))
    schema = T.StructType([*kept, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    names = kept.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_memo(("bpe", ranks_path, pattern), lambda: Encoder(*shared.value, pattern))
        for batch in in_parts(batches):
            ids = list(encoder.encode_all(texts_of(batch.column(batch.schema.names.index(text)))))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            yield add_columns(batch, names, token_ids=column)

    return docs.mapInArrow(run, schema)


def _joined(column: pa.ListArray, entries: pa.LargeBinaryArray) -> pa.Array:
    """The entries of each row's ids, one after another.

    What is taken stands side by side in one buffer, so the rows only need their ends in it.
    """
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a null among the ids")
    taken = entries.take(flat)
    places = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
    ends = places[np.cumsum([0, *pc.fill_null(pc.list_value_length(column), 0).to_numpy()])]
    buffers = [None, pa.py_buffer(ends), taken.buffers()[2] or pa.py_buffer(b"")]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), buffers).cast(pa.binary())


def bpe_decode(encoded: DataFrame, ranks_path: str, ids: str = "token_ids", drop_ids: bool = False) -> DataFrame:
    """The input with decoded (binary): the bytes of each row's ids, one after another.

    Null arrays give empty bytes; an id outside the vocabulary fails the job, as a silent gap
    would be a wrong text. A decoded column of the input is replaced.
    """
    ranks = read_ranks(ranks_path)
    vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
    for entry, rank in ranks.items():
        vocabulary[rank] = entry
    shared = encoded.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.large_binary()))
    kept = without(encoded.schema, ("decoded", *([ids] if drop_ids else [])))
    schema = T.StructType([*kept, T.StructField("decoded", T.BinaryType())])
    names = kept.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value
        for batch in in_parts(batches):
            for at in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(at, DECODED_ROWS)
                column = part.column(part.schema.names.index(ids))
                yield add_columns(part, names, decoded=_joined(column, entries))

    return encoded.mapInArrow(run, schema)

