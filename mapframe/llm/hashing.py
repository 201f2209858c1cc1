"""XXH64 of many byte slices at once, as uint64 arithmetic on whole columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from mapframe.llm.common import bytes_of, offsets_of

# The five primes of XXH64.
PRIME_1 = 11400714785074694791
PRIME_2 = 14029467366897019727
PRIME_3 = 1609587929392839161
PRIME_4 = 9650029242287828579
PRIME_5 = 2870177450012600261

_1, _2, _3, _4, _5 = (np.uint64(p) for p in (PRIME_1, PRIME_2, PRIME_3, PRIME_4, PRIME_5))
#: Longer slices, and lengths that few slices have, are hashed one by one.
_LONGEST, _FEW = 256, 48


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(total: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(total + lane * _2, 31) * _1


def _same_length(rows: np.ndarray, length: int, seed: int) -> np.ndarray:
    """``rows``: uint8, one slice a row, padded to whole 8 bytes."""
    lanes = rows.view("<u8")
    n, at = len(rows), 0
    with np.errstate(over="ignore"):
        if length >= 32:
            s = np.uint64(seed)
            v = [np.full(n, x, np.uint64) for x in (s + _1 + _2, s + _2, s, s - _1)]
            while at + 32 <= length:
                v = [_round(x, lanes[:, at // 8 + i]) for i, x in enumerate(v)]
                at += 32
            h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for x in v:
                h = (h ^ _round(np.uint64(0), x)) * _1 + _4
        else:
            h = np.full(n, np.uint64(seed) + _5, np.uint64)
        h = h + np.uint64(length)
        while at + 8 <= length:
            h = _turn(h ^ _round(np.uint64(0), lanes[:, at // 8]), 27) * _1 + _4
            at += 8
        if at + 4 <= length:
            h = _turn(h ^ (rows[:, at : at + 4].copy().view("<u4")[:, 0].astype(np.uint64) * _1), 23) * _2 + _3
            at += 4
        while at < length:
            h = _turn(h ^ (rows[:, at].astype(np.uint64) * _5), 11) * _1
            at += 1
        h = (h ^ (h >> np.uint64(33))) * _2
        h = (h ^ (h >> np.uint64(29))) * _3
        return h ^ (h >> np.uint64(32))


class RangeHashes:
    """Hashes of any range of a sequence of words, from prefix sums over it.

    The hash of words ``a..b`` is ``sum(h(word_i) * B**(i - a))`` modulo 2**64. Equal words have equal ones; different words
    may have too (such sequences can be constructed), so whoever uses them verifies.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, words: pa.Array):
        n = len(words)
        coded = words.dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        at = offsets_of(distinct) if len(distinct) else np.zeros(1, np.int64)
        with np.errstate(over="ignore"):
            hashes = xxh64(bytes_of(distinct), at[:-1], np.diff(at), 0)[codes] if n else np.zeros(0, np.uint64)
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(self.BASE))]))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[:-1], dtype=np.uint64)])
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + 1, np.uint64(pow(self.BASE, -1, 1 << 64)))]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def without(self, a: np.ndarray, p: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash of words ``a..b`` but for that at ``p``."""
        with np.errstate(over="ignore"):
            return self(a, p) + (self.sums[b] - self.sums[p + 1]) * self.inverse[a] * self.inverse[1]


def mixed(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (np.asarray(salt).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of ``data[start : start + length]`` for each pair, as uint64."""
    out = np.zeros(len(starts), np.uint64)
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    padded = np.concatenate([data, np.zeros(_LONGEST + 8, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view
    edges = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1, [len(ordered)]]) if len(ordered) else np.zeros(1, np.int64)
    raw = memoryview(np.ascontiguousarray(data)).cast("B") if len(data) else b""
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own, length = order[a:b], int(ordered[a])
        if length > _LONGEST or b - a < _FEW:
            out[own] = [xxhash.xxh64_intdigest(raw[s : s + length], seed) for s in starts[own].tolist()]
        else:
            wide = -(-max(length, 1) // 8) * 8
            out[own] = _same_length(np.ascontiguousarray(view(padded, wide)[starts[own]]), length, seed)
    return out
