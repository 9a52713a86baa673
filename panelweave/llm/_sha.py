"""SHA-256 over many messages at once, with states that can be kept, copied and resumed.

A message here is a run of digests in lower-case hex. One such digest fills a block of 64
bytes, so a state between two digests is eight 32-bit words and nothing else.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

_MASK = 2**32 - 1


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(n: int) -> int:
    x = 1 << -(-n.bit_length() // 3)
    while (y := (2 * x + n // (x * x)) // 3) < x:
        x = y
    return x


# fixed values: the fractions of square and cube roots of the first primes
START = np.array([isqrt(p << 64) & _MASK for p in _primes(8)], dtype=np.uint32)
_ROUND = np.array([_cube_root(p << 96) & _MASK for p in _primes(64)], dtype=np.uint32)
_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), dtype=np.uint8).reshape(256, 2)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """states (8, n) after one more block (16, n) each; a block (16, 1) is the same for all."""
    w = list(block)
    for i in range(16, 64):
        near, far = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(near, 7) ^ _turn(near, 18) ^ (near >> np.uint32(3))) + w[i - 7] + (_turn(far, 17) ^ _turn(far, 19) ^ (far >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        s = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[i] + _ROUND[i])
        t = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = s + t, a, b, c, d + s, e, f, g
    return np.stack([a, b, c, d, e, f, g, h]) + state


def hex_block(digests: np.ndarray) -> np.ndarray:
    """digests (n, 32) bytes as the block (16, n) of their hex text."""
    return np.ascontiguousarray(_HEX[digests].reshape(len(digests), 64).view(">u4").T).astype(np.uint32)


def as_bytes(states: np.ndarray) -> np.ndarray:
    """states (8, n) as (n, 32) bytes."""
    return np.ascontiguousarray(states.T.astype(">u4")).view(np.uint8)


def as_states(stored: np.ndarray) -> np.ndarray:
    """(n, 32) bytes as states (8, n)."""
    return np.ascontiguousarray(np.ascontiguousarray(stored).view(">u4").T).astype(np.uint32)


def finished(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests (n, 32) of messages that have taken `blocks` blocks each."""
    out = np.zeros((state.shape[1], 32), dtype=np.uint8)
    for n in np.unique(blocks):
        last = np.zeros((16, 1), dtype=np.uint32)
        last[0], last[15] = 0x80000000, n * 512
        at = np.flatnonzero(blocks == n)
        out[at] = as_bytes(compress(state[:, at], last))
    return out
