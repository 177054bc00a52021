"""Counting quotient filters: exact counts of 64-bit keys in little space.

Keys are permuted by an invertible mix, so that they spread evenly whatever they are. The leading ``shard_bits`` of a
permuted key name the filter that holds it, the next bits are its quotient, all bits behind them its remainder. A
filter stores, sorted, for each quotient how many remainders it has (in unary), the whole remainders, and a counter
for each. So keys come back without loss, and filters of the same shard merge like sorted lists.
"""

from __future__ import annotations

import numpy as np

# Multipliers and shifts of the 64-bit mix, and the inverses of the multipliers.
_MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_SHIFTS = (30, 27, 31)
_INVERSES = tuple(pow(m, -1, 1 << 64) for m in _MULTIPLIERS)
_ESCAPE = 255  # counters from here on are stored apart, in 8 bytes


def permuted(keys: np.ndarray) -> np.ndarray:
    keys = keys.astype(np.uint64)
    for shift, multiplier in zip(_SHIFTS, (*_MULTIPLIERS, 1), strict=True):
        keys = (keys ^ (keys >> np.uint64(shift))) * np.uint64(multiplier)
    return keys


def unpermuted(keys: np.ndarray) -> np.ndarray:
    for shift, multiplier in zip(_SHIFTS[::-1], (*_INVERSES[::-1], 1), strict=True):
        keys = (keys ^ (keys >> np.uint64(shift)) ^ (keys >> np.uint64(2 * shift))) * np.uint64(multiplier)
    return keys


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different permuted keys, sorted, and how often each occurs."""
    found, counts = np.unique(permuted(keys), return_counts=True)
    return found, counts.astype(np.int64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted list of keys with the sums of their counters."""
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def shards(keys: np.ndarray, shard_bits: int) -> np.ndarray:
    """Where the keys of each shard begin, and the end of all."""
    edges = np.arange(1, 1 << shard_bits, dtype=np.uint64) << np.uint64(64 - shard_bits) if shard_bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _split(count: int, shard_bits: int) -> tuple[int, int]:
    """Bits of the quotient and of the remainder in a filter of so many keys."""
    quotient = min(max(1, count.bit_length() - 1), 63 - shard_bits)
    return quotient, 64 - shard_bits - quotient


def encoded(keys: np.ndarray, counts: np.ndarray, shard_bits: int) -> bytes:
    """The filter of some sorted permuted keys of one shard."""
    n = len(keys)
    quotient_bits, rest = _split(n, shard_bits)
    quotients = (keys >> np.uint64(rest)) & np.uint64((1 << quotient_bits) - 1)
    runs = np.bincount(quotients.astype(np.int64), minlength=1 << quotient_bits)
    unary = np.zeros(n + len(runs), np.uint8)
    unary[np.cumsum(runs) + np.arange(len(runs))] = 1
    remainders = (keys & np.uint64((1 << rest) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, : -(-rest // 8)]
    large = counts >= _ESCAPE
    small = np.where(large, _ESCAPE, counts).astype(np.uint8)
    return b"".join((
        np.array([n], "<u8").tobytes(), np.packbits(unary).tobytes(), remainders.tobytes(), small.tobytes(), counts[large].astype("<i8").tobytes()
    ))


def decoded(data: bytes, shard: int, shard_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Permuted keys, sorted, and counters of a filter."""
    n = int(np.frombuffer(data, "<u8", 1)[0])
    quotient_bits, rest = _split(n, shard_bits)
    width, at, size = -(-rest // 8), 8, n + (1 << quotient_bits)
    unary = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size)
    runs = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    at += -(-size // 8)
    remainders = np.zeros((n, 8), np.uint8)
    remainders[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    at += n * width
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == _ESCAPE] = np.frombuffer(data, "<i8", -1, at + n)
    quotients = np.repeat(np.arange(len(runs), dtype=np.uint64), runs) << np.uint64(rest)
    own = np.uint64(shard << 64 - shard_bits if shard_bits else 0)
    return remainders.view("<u8").ravel() | quotients | own, counts
