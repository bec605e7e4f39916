"""SHA-256 over many messages at once, with states that can be kept, stored and resumed.

A digest written as 64 hex digits is exactly one block of SHA-256. So the state after any number of
digests is eight 32-bit words with nothing buffered: it can be copied, written to a table, and
resumed in another task. Arrays hold one message per column: states (8, n), blocks (16, n).
"""

from __future__ import annotations

from math import isqrt

import numpy as np

WORD = 0xFFFFFFFF
LANES = 1 << 14


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(x: int) -> int:
    r = round(x ** (1 / 3))
    while r**3 > x:
        r -= 1
    while (r + 1) ** 3 <= x:
        r += 1
    return r


#: The first 32 bits of the fractions of square and cube roots of primes.
START = np.array([isqrt(p << 64) & WORD for p in _primes(8)], np.uint32)
ROUND = np.array([_cube_root(p << 96) & WORD for p in _primes(64)], np.uint32)

#: Four hex digits of each 16-bit number, as one word.
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.uint32)
_HALF = np.arange(1 << 16, dtype=np.uint32)
HEX = sum(_DIGITS[(_HALF >> np.uint32(12 - 4 * k)) & np.uint32(15)] << np.uint32(24 - 8 * k) for k in range(4))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    w = list(block)
    for t in range(16, 64):
        near, far = w[t - 2], w[t - 15]
        s1 = _turn(near, 17) ^ _turn(near, 19) ^ (near >> np.uint32(10))
        s0 = _turn(far, 7) ^ _turn(far, 18) ^ (far >> np.uint32(3))
        w.append(w[t - 16] + s0 + w[t - 7] + s1)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        t1 = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
        t2 = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & (b | c)) | (b & c))
        h, g, f, e, d, c, b, a = g, f, e, d + t1, c, b, a, t1 + t2
    return np.stack([a, b, c, d, e, f, g, h]) + state


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States after one more block each."""
    parts = [
        _compress(state[:, k : k + LANES], block[:, k : k + LANES])
        for k in range(0, state.shape[1], LANES)
    ]
    return np.concatenate(parts, axis=1) if parts else state.copy()


def starts(n: int) -> np.ndarray:
    """The state before anything was read, `n` times."""
    return np.repeat(START[:, None], n, axis=1)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests (8, n) as the blocks of their hex texts."""
    out = np.empty((16, digests.shape[1]), np.uint32)
    out[0::2] = HEX[digests >> np.uint32(16)]
    out[1::2] = HEX[digests & np.uint32(0xFFFF)]
    return out


def absorb(state: np.ndarray, digests: np.ndarray, where: np.ndarray) -> np.ndarray:
    """States after the hex text of one more digest, in the columns where `where` holds."""
    at = np.flatnonzero(where)
    if len(at):
        state = state.copy()
        state[:, at] = compress(state[:, at], hex_block(digests[:, at]))
    return state


def close(state: np.ndarray, n_blocks: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
    """Digests of messages of `n_blocks` whole blocks, from their states."""
    where = np.ones(state.shape[1], bool) if where is None else where
    at = np.flatnonzero(where)
    out = state.copy()
    if len(at):
        bits = n_blocks[at].astype(np.uint64) * np.uint64(512)
        last = np.zeros((16, len(at)), np.uint32)
        last[0] = 1 << 31
        last[14] = (bits >> np.uint64(32)).astype(np.uint32)
        last[15] = (bits & np.uint64(WORD)).astype(np.uint32)
        out[:, at] = compress(state[:, at], last)
    return out


def words(digests: list[bytes]) -> np.ndarray:
    """Digests of 32 bytes each as (8, n)."""
    flat = np.frombuffer(b"".join(digests), ">u4").astype(np.uint32)
    return np.ascontiguousarray(flat.reshape(-1, 8).T)


def raw(digests: np.ndarray) -> list[bytes]:
    """(8, n) as digests of 32 bytes each."""
    data = np.ascontiguousarray(digests.T).astype(">u4").tobytes()
    return [data[k : k + 32] for k in range(0, len(data), 32)]
