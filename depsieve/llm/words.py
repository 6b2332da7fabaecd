"""Words of a batch of texts as 64-bit hashes, in numpy, without a Python object per word."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULTIPLIER = np.uint64(0x5851F42D4C957F2D)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_IS_EDGE = _IS_SPACE.copy()  # with ASCII punctuation, for words without it
_IS_EDGE[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
#: Bytes that are hashed at a time; eight-byte arrays of this length are made on the way.
PIECE = 1 << 18
_POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(PIECE, _MULTIPLIER))])
_BACK = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(PIECE, _INVERSE))])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_hashes(data: np.ndarray, edges: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words in a piece that has spaces at both ends' cuts."""
    space = edges[data]
    edge = np.diff(space.view(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[_FOLD[data]] * _POWERS[: len(data)], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return starts, mix((sums[ends] - sums[starts]) * _BACK[starts] + lengths * np.uint64(0x9E3779B97F4A7C15))


def _long_word(data: np.ndarray) -> np.uint64:
    """The hash of one word of any length, as _piece_hashes would give it."""
    total, power = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for i in range(0, len(data), PIECE):
        part = data[i : i + PIECE]
        total = total + power * (_BYTE_VALUE[_FOLD[part]] * _POWERS[: len(part)]).sum(dtype=np.uint64)
        power = power * _POWERS[len(part)]
    return mix(total + np.array([len(data)], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]


def _cuts(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of at most PIECE bytes that end at a space, or longer ones that are one word."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + PIECE, n)
        if end < n:
            back = np.flatnonzero(edges[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                while end < n and not edges[data[end]]:
                    stop = min(end + PIECE, n)
                    ahead = np.flatnonzero(edges[data[end:stop]])
                    end = end + int(ahead[0]) if len(ahead) else stop
        yield at, end
        at = end


def word_hashes(texts: pa.Array, punctuation: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of each text's words); null texts have none.

    A-Z are lower-cased; words end at the six ASCII white-space characters and, without
    ``punctuation``, at ASCII punctuation too. Two words have the same hash only by a
    collision of 64 bits.
    """
    edges = _IS_SPACE if punctuation else _IS_EDGE
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    counts = np.zeros(len(texts), np.int64)
    hashes: list[np.ndarray] = []
    # Short texts share a piece: a space is put between them.
    i = 0
    while i < len(texts):
        j = i
        while j < len(texts) and offsets[j + 1] - offsets[i] + (j - i) < PIECE:
            j += 1
        if j == i:  # one long text
            for a, b in _cuts(own := data[offsets[i] : offsets[i + 1]], edges):
                if b - a > PIECE:
                    found = np.array([_long_word(own[a:b])], np.uint64)
                else:
                    found = _piece_hashes(own[a:b], edges)[1]
                counts[i] += len(found)
                hashes.append(found)
            i += 1
            continue
        sizes = np.diff(offsets[i : j + 1])
        begins = offsets[i:j] - offsets[i] + np.arange(j - i)
        joined = np.full(int(sizes.sum()) + (j - i), 32, np.uint8)
        own = data[offsets[i] : offsets[j]]
        joined[np.arange(len(own)) + np.repeat(np.arange(j - i), sizes)] = own
        starts, found = _piece_hashes(joined, edges)
        counts[i:j] = np.diff(np.searchsorted(starts, np.append(begins, len(joined))))
        hashes.append(found)
        i = j
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter; none of none."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * _MULTIPLIER + words[k : k + len(out)]
    return mix(out + np.uint64(size))
