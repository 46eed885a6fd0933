"""Which rows the steps of a descent draw: the rule of ``text_unit``, for columns of numbers."""

from __future__ import annotations

import math

import numpy as np

_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def md5_heads(texts: np.ndarray) -> np.ndarray:
    """First four bytes of the MD5 of each row of bytes, as a number; rows of up to 55 bytes."""
    n, length = texts.shape
    if length > 55:
        raise ValueError("texts of more than 55 bytes need a second block")
    block = np.zeros((n, 64), np.uint8)
    block[:, :length] = texts
    block[:, length] = 0x80
    block[:, 56:58] = 8 * length % 256, 8 * length // 256
    words = np.ascontiguousarray(block.view("<u4").T)
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        f += words[g]
        left = _TURNS[turn][i % 4]
        a, d, c = d, c, b
        b = b + ((f << np.uint32(left)) | (f >> np.uint32(32 - left)))
    return (a + np.uint32(_START[0])).byteswap()


def drawn_rows(index: np.ndarray, steps: int, seed: int, fraction: float) -> np.ndarray:
    """Rows and steps: whether ``text_unit(index, step, seed) < fraction``."""
    # As whole numbers, which a head may reach.
    edge = math.ceil(fraction * (1 << 32))
    out = np.empty((len(index), steps), bool)
    digits = np.searchsorted(10 ** np.arange(1, 19), index, side="right") + 1
    for length in np.unique(digits).tolist():
        at = np.flatnonzero(digits == length)
        number = index[at][:, None] // 10 ** np.arange(length - 1, -1, -1) % 10 + ord("0")
        for step in range(1, steps + 1):
            tail = np.frombuffer(f"|{step}|{seed}".encode(), np.uint8)
            text = np.column_stack([number.astype(np.uint8), np.broadcast_to(tail, (len(at), len(tail)))])
            out[at, step - 1] = md5_heads(text) < edge
    return out
