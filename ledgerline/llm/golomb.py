"""Golomb-Rice code of a sorted list of distinct numbers, a whole list at a time in numpy.

The gaps are cut into a quotient, written in unary, and `bits` low bits. The two parts are kept in one stream
each, so that both directions work on whole arrays: a list of n numbers below m takes about n * (log2(m / n) + 1.5) bits.
"""

import numpy as np


def encode(numbers: np.ndarray, below: int) -> bytes:
    """Bytes of ascending distinct uint64 `numbers`, all smaller than `below`."""
    n = len(numbers)
    bits = max(0, (below // max(1, n)).bit_length() - 1)
    gaps = np.diff(numbers.astype(np.uint64), prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(bits)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 1
    low = ((gaps[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.array([n, bits, len(unary)], "<u8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def decode(data: bytes) -> np.ndarray:
    n, bits, length = (int(x) for x in np.frombuffer(data, "<u8", 3))
    if n == 0:
        return np.zeros(0, np.uint64)
    at = 24 + (length + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, at - 24, 24), count=length))
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(bits)
    if bits:
        low = np.unpackbits(np.frombuffer(data, np.uint8, offset=at), count=n * bits).reshape(n, bits)
        gaps += low.astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
    return np.cumsum(gaps)
