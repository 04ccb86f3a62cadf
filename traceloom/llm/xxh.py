"""XXH64 over many byte ranges of one buffer at once, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_ranges(buffer: bytes, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit hashes of buffer[start:end] for arrays of starts and ends."""
    padded = buffer + bytes(8)
    by8 = np.ndarray(len(buffer) + 1, np.dtype("<u8"), padded, strides=(1,))
    by4 = np.ndarray(len(buffer) + 1, np.dtype("<u4"), padded, strides=(1,))
    by1 = np.frombuffer(padded, np.uint8)
    n, at = end - start, start.astype(np.int64)
    with np.errstate(over="ignore"):
        acc = np.full(len(n), U(seed) + P5, U)
        long = np.flatnonzero(n >= 32)
        if len(long):
            v = [np.full(len(long), x, U) for x in (U(seed) + P1 + P2, U(seed) + P2, U(seed), U(seed) - P1)]
            stripes = n[long] // 32
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                where = at[long[on]] + 32 * k
                for j in range(4):
                    v[j][on] = _round(v[j][on], by8[where + 8 * j])
            got = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                got = (got ^ _round(U(0), x)) * P1 + P4
            acc[long] = got
            at[long] += 32 * stripes
        acc += n.astype(U)
        while len(on := np.flatnonzero(end - at >= 8)):
            acc[on] = _rotl(acc[on] ^ _round(U(0), by8[at[on]]), 27) * P1 + P4
            at[on] += 8
        if len(on := np.flatnonzero(end - at >= 4)):
            acc[on] = _rotl(acc[on] ^ (by4[at[on]].astype(U) * P1), 23) * P2 + P3
            at[on] += 4
        while len(on := np.flatnonzero(end > at)):
            acc[on] = _rotl(acc[on] ^ (by1[at[on]].astype(U) * P5), 11) * P1
            at[on] += 1
        acc = (acc ^ (acc >> U(33))) * P2
        acc = (acc ^ (acc >> U(29))) * P3
        return acc ^ (acc >> U(32))
