"""Golay-code fuzzy keys of 64-bit fingerprints.

The perfect binary [23, 12, 7] code has a codeword within 3 bits of every 23-bit word. A segment's
keys are the indices of the codewords to which it and its 23 neighbours decode: one key if it lies
within 2 bits of a codeword, else six. Two segments at most 2 bits apart have a common neighbour
(or are one), hence a common key.

A 64-bit fingerprint has segments of 23, 23 and 18 bits (the last padded with zeros). Two errors leave
one of the three segments without error, and no other segment with more than two; so fingerprints
at most 2 bits apart agree, for some segment k, in segment k and in a fuzzy key of segment k + 1.
"""

from __future__ import annotations

import numpy as np

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the code.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def _syndromes(v: np.ndarray) -> np.ndarray:
    r = v.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


def _leaders() -> np.ndarray:
    """The error pattern of at most 3 bits that has each syndrome."""
    bits = 1 << np.arange(23)
    one = bits
    two = (bits[:, None] | bits[None, :])[np.triu_indices(23, 1)]
    three = np.unique(np.concatenate([two | b for b in bits.tolist()]))
    errors = np.unique(np.concatenate([[0], one, two, three]))
    table = np.zeros(2048, np.int64)
    table[_syndromes(errors)] = errors
    return table


_LEADERS = _leaders()


def decode(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the nearest codeword of each 23-bit word."""
    return (v ^ _LEADERS[_syndromes(v)]) >> 11


def _near_errors() -> np.ndarray:
    """For each syndrome, how a word differs from the codewords to which it and its neighbours decode; the first repeated where there are
    fewer than six."""
    flips = np.append(0, 1 << np.arange(23))
    errors = flips[None, :] ^ _LEADERS[np.arange(2048)[:, None] ^ _syndromes(flips)[None, :]]
    rows = [sorted(set(row)) for row in errors.tolist()]
    return np.array([(row + row[:1] * 6)[:6] for row in rows], np.int64)


_NEAR = _near_errors()
_LOW, _HIGH = _syndromes(np.arange(1 << 12)), _syndromes(np.arange(1 << 11) << 12)


def fuzzy_keys(v: np.ndarray) -> np.ndarray:
    """The six codeword indices of each 23-bit word; some repeat where there are fewer."""
    v = v.astype(np.int64)
    return (v[:, None] ^ _NEAR[_LOW[v & 0xFFF] ^ _HIGH[v >> 12]]) >> 11


def join_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: rows at most 2 bits apart share a key."""
    f = fingerprints.astype(np.uint64)
    parts = [((f >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    fuzzy = [fuzzy_keys(p) for p in parts]
    rows, keys = [], []
    for k in range(3):
        key = (np.int64(k) << 35) | (parts[k][:, None] << 12) | fuzzy[(k + 1) % 3]
        key.sort(axis=1)
        fresh = np.ones(key.shape, bool)
        fresh[:, 1:] = key[:, 1:] != key[:, :-1]
        r, c = np.nonzero(fresh)
        rows.append(r)
        keys.append(key[r, c])
    return np.concatenate(rows), np.concatenate(keys)
