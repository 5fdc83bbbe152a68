"""Byte-aligned variable-length coding of unsigned integers with the control bytes kept apart.

Four integers share one control byte (two bits each: bytes - 1); their one to four little-endian bytes follow in a
stream of its own. Decoding looks the control byte up in a table of lengths, so it is numpy throughout.
"""

from __future__ import annotations

import numpy as np

#: Lengths of the four integers that a control byte describes.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], dtype=np.uint8)
#: Integers that are worked on at once.
STEP = 1 << 20


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of an array of integers below 2**32."""
    controls, data = [], []
    for at in range(0, len(values), STEP):
        v = values[at : at + STEP].astype(np.uint32)
        size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
        padded = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
        padded[: len(v)] = size - 1
        four = padded.reshape(-1, 4)
        controls.append((four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes())
        start = np.cumsum(size, dtype=np.int64) - size
        out = np.empty(int(start[-1]) + int(size[-1]), dtype=np.uint8)
        for k in range(int(size.max())):
            longer = np.flatnonzero(size > k) if k else slice(None)
            out[start[longer] + k] = (v[longer] >> np.uint32(8 * k)).astype(np.uint8)
        data.append(out.tobytes())
    return b"".join(controls), b"".join(data)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers that pack() packed, as uint32."""
    controls, raw = np.frombuffer(control, dtype=np.uint8), np.frombuffer(data, dtype=np.uint8)
    out, at = np.empty(n, dtype=np.uint32), 0
    for first in range(0, n, STEP):
        last = min(n, first + STEP)
        size = LENGTHS[controls[first // 4 : -(-last // 4)]].reshape(-1)[: last - first]
        start = np.cumsum(size, dtype=np.int64) - size + at
        at = int(start[-1]) + int(size[-1])
        v = raw[start].astype(np.uint32)
        for k in range(1, int(size.max())):
            longer = np.flatnonzero(size > k)
            v[longer] |= raw[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
        out[first:last] = v
    return out
