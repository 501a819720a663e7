"""Static range asymmetric numeral system over ids, many interleaved lanes at a time in numpy.

A frequency table is shared by all blocks. A block is coded by `LANES` states; id i belongs to lane i mod LANES, so a
step codes a row of ids with whole-array operations. States are 64 bits wide and move 32 bits at a time. Every
`EVERY` steps the decoder's states and place are written to the block as a checkpoint, so that parts of a
block can be decoded on their own; the block ends with a CRC-32 of everything in it.
"""

import zlib

import numpy as np

SCALE = 20  # frequencies add up to 2**SCALE
LANES = 1024
EVERY = 128
_LOW = np.uint64(1 << 31)
_HEAD = np.dtype([("magic", "<u4"), ("n", "<u4"), ("words", "<u4"), ("lanes", "<u4"), ("every", "<u4"), ("marks", "<u4")])
_MAGIC = 0x31534E52


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**SCALE, at least 1 for every id of the vocabulary."""
    total = 1 << SCALE
    if len(counts) > total // 2:
        raise ValueError(f"a vocabulary of {len(counts)} ids does not fit in {SCALE} bits")
    spare = total - len(counts)
    share = counts.astype(np.float64) / max(1, counts.sum())
    freq = 1 + np.floor(share * spare).astype(np.int64)
    freq[int(np.argmax(freq))] += total - int(freq.sum())
    return freq.astype(np.uint32)


class Coder:
    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = EVERY) -> bytes:
        """One block. The last row is filled up with id 0, which the decoder cuts off."""
        steps = -(-len(ids) // lanes)
        rows = np.zeros(steps * lanes, np.int64)
        rows[: len(ids)] = ids
        f, c = self.freq[rows].reshape(steps, lanes), self.start[rows].reshape(steps, lanes)
        x = np.full(lanes, _LOW, np.uint64)
        out, marks, total = [], [], 0
        scale, half = np.uint64(SCALE), np.uint64(32)
        top = np.uint64(63 - SCALE)  # a state of f << top or more must shed 32 bits first
        for t in range(steps - 1, -1, -1):
            ft = f[t]
            over = x >= (ft << top)
            if over.any():
                shed = (x[over] & np.uint64(0xFFFFFFFF)).astype("<u4")
                out.append(shed)
                total += len(shed)
                x[over] >>= half
            q, r = np.divmod(x, ft)
            x = (q << scale) + r + c[t]
            if t % every == 0:
                marks.append((t, total, x.copy()))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
        head = np.array([(_MAGIC, len(ids), total, lanes, every, len(marks))], _HEAD).tobytes()
        points = b"".join(
            np.array([t, total - at], "<u4").tobytes() + state.astype("<u8").tobytes() for t, at, state in reversed(marks)
        )
        body = head + points + words.tobytes()
        return body + zlib.crc32(body).to_bytes(4, "little")

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the checkpoints `first` (from 0) up to `last` (not included; the end if None)."""
        if zlib.crc32(block[:-4]) != int.from_bytes(block[-4:], "little"):
            raise ValueError("damaged block: its checksum does not fit")
        head = np.frombuffer(block, _HEAD, 1)[0]
        if head["magic"] != _MAGIC:
            raise ValueError("not a block of this format")
        n, lanes, every, marks = (int(head[k]) for k in ("n", "lanes", "every", "marks"))
        steps, size = -(-n // lanes), 8 + 8 * lanes
        if first >= marks:
            return np.zeros(0, np.uint32)
        at = _HEAD.itemsize + first * size
        t, place = (int(v) for v in np.frombuffer(block, "<u4", 2, at))
        x = np.frombuffer(block, "<u8", lanes, at + 8).astype(np.uint64)
        words = np.frombuffer(block, "<u4", int(head["words"]), _HEAD.itemsize + marks * size)
        stop = steps if last is None or last >= marks else min(steps, last * every)
        out = np.empty((stop - t, lanes), np.uint32)
        scale, mask, half = np.uint64(SCALE), np.uint64((1 << SCALE) - 1), np.uint64(32)
        for row in range(stop - t):
            slot = x & mask
            s = self.symbol[slot]
            out[row] = s
            x = self.freq[s] * (x >> scale) + slot - self.start[s]
            under = np.flatnonzero(x < _LOW)
            if len(under):
                x[under] = (x[under] << half) | words[place : place + len(under)]
                place += len(under)
        return out.ravel()[: max(0, n - t * lanes)]
