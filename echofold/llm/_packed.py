"""Arrays packed into binary values, so that an exchange moves bytes and not rows."""

from __future__ import annotations

import struct

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their lengths in bytes before them."""
    head = struct.pack(f"<{len(arrays)}Q", *(a.nbytes for a in arrays))
    return b"".join([head, *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(raw: bytes, *kinds) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(kinds)}Q", raw)
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def planes(x: np.ndarray, n: int) -> np.ndarray:
    """The n low bytes of little-endian numbers, first bytes first: constant bytes then compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).ravel()


def from_planes(x: np.ndarray, n: int) -> np.ndarray:
    wide = np.zeros((len(x) // n, 8), np.uint8)
    wide[:, :n] = x.reshape(n, -1).T
    return wide.view("<u8").ravel()


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])
