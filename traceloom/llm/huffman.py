"""Canonical length-limited Huffman codes over ids, and table-driven decoding of many segments at once."""

from __future__ import annotations

import numpy as np


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code length of each id (0 where the count is 0), none over `limit`, of least total bits (package-merge)."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(ids) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    if len(ids) < 2:
        out[ids] = 1
        return out
    ids = ids[np.lexsort((ids, counts[ids]))]
    weights = counts[ids].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(weights))
        merged = merged[order]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    lengths, take = np.zeros(len(ids), np.uint8), 2 * len(ids) - 2
    for is_id in reversed(levels):
        own = int(is_id[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[ids] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    if len(ids):
        n = lengths[ids].astype(np.uint64)
        top = np.uint64(n[-1])
        width = np.uint64(1) << (top - n)
        codes[ids] = np.concatenate([[np.uint64(0)], np.cumsum(width)[:-1]]).astype(np.uint64) >> (top - n)
    return codes


def tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) for each value of the next bits, and how many bits that are."""
    ids = np.flatnonzero(lengths)
    if not len(ids):
        return np.zeros(2, np.uint32), np.ones(2, np.uint8), 1
    ids = ids[np.lexsort((ids, lengths[ids]))]
    top = int(lengths[ids].max())
    width = 1 << (top - lengths[ids].astype(np.int64))
    symbol, size = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.uint8)
    used = int(width.sum())
    symbol[:used], size[:used] = np.repeat(ids, width), np.repeat(lengths[ids], width)
    return symbol, size, top


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int, counts: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """The bits of ids, and the bit at which every step-th id of a document begins; counts: the ids of each document
    (default: all are one), each of which begins at a byte."""
    n = lengths[ids].astype(np.int64)
    begin = np.cumsum(n) - n
    counts = np.array([len(ids)]) if counts is None else counts
    first = np.cumsum(counts) - counts
    last_bit = np.append(0, np.cumsum(n))
    bits = last_bit[first + counts] - last_bit[first]
    size = (bits + 7) >> 3
    begin += np.repeat(8 * (np.cumsum(size) - size) - last_bit[first], counts)
    word, words = begin >> 5, (8 * int(size.sum()) >> 5) + 2
    shifted = codes[ids] << (64 - n - (begin & 31)).astype(np.uint64)
    high = np.bincount(word, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=words)
    low = np.bincount(word + 1, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
    packed = (high[:words] + low[:words]).astype(np.uint64).astype(">u4").tobytes()
    marked = (np.arange(len(ids)) - np.repeat(first, counts)) % step == 0
    return packed[: int(size.sum())], begin[marked]


def unpack(bits: bytes, begin: np.ndarray, counts: np.ndarray, symbol: np.ndarray, size: np.ndarray, top: int) -> np.ndarray:
    """Ids of segments that begin at the given bits and hold the given numbers of ids, one after another."""
    by8 = np.ndarray(len(bits) + 1, ">u8", bits + bytes(8), strides=(1,))
    order = np.argsort(-counts, kind="stable")
    at, left = begin[order].astype(np.int64), counts[order]
    place = (np.cumsum(counts) - counts)[order]
    out = np.empty(int(counts.sum()), np.uint32)
    for i in range(int(counts.max()) if len(counts) else 0):
        on = int(np.searchsorted(-left, -i, side="left"))
        now = at[:on]
        value = (by8[now >> 3].astype(np.uint64) << (now & 7).astype(np.uint64)) >> np.uint64(64 - top)
        out[place[:on] + i] = symbol[value]
        at[:on] += size[value]
    return out
