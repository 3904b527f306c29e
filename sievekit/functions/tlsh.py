"""TLSH, 128 buckets, one checksum byte: digest and distance, in numpy.

From the published description (Oliver, Cheng, Chen: "TLSH - A Locality Sensitive
Hash", 2013).  No digests of known files are at hand here, so the distance is
checked against three known distances and the digest only by its properties.
"""

from __future__ import annotations

import math

import numpy as np

MIN_BYTES = 50
MAX_BYTES = 4_224_281_216  # bytes beyond are ignored
INVALID = -1

# Pearson's permutation.
PEARSON = np.array(
    [
        1, 87, 49, 12, 176, 178, 102, 166, 121, 193, 6, 84, 249, 230, 44, 163, 14, 197, 213, 181, 161, 85, 218, 80, 64, 239, 24, 226, 236, 142, 38, 200,
        110, 177, 104, 103, 141, 253, 255, 50, 77, 101, 81, 18, 45, 96, 31, 222, 25, 107, 190, 70, 86, 237, 240, 34, 72, 242, 20, 214, 244, 227, 149, 235,
        97, 234, 57, 22, 60, 250, 82, 175, 208, 5, 127, 199, 111, 62, 135, 248, 174, 169, 211, 58, 66, 154, 106, 195, 245, 171, 17, 187, 182, 179, 0, 243,
        132, 56, 148, 75, 128, 133, 158, 100, 130, 126, 91, 13, 153, 246, 216, 219, 119, 68, 223, 78, 83, 88, 201, 99, 122, 11, 92, 32, 136, 114, 52, 10,
        138, 30, 48, 183, 156, 35, 61, 26, 143, 74, 251, 94, 129, 162, 63, 152, 170, 7, 115, 167, 241, 206, 3, 150, 55, 59, 151, 220, 90, 53, 23, 131,
        125, 173, 15, 238, 79, 95, 89, 16, 105, 137, 225, 224, 217, 160, 37, 123, 118, 73, 2, 157, 46, 116, 9, 145, 134, 228, 207, 212, 202, 215, 69, 229,
        27, 188, 67, 124, 168, 252, 42, 4, 29, 108, 21, 247, 19, 205, 39, 203, 233, 40, 186, 147, 198, 192, 155, 33, 164, 191, 98, 204, 165, 180, 117, 76,
        140, 36, 210, 172, 41, 54, 159, 8, 185, 232, 113, 196, 231, 47, 146, 120, 51, 65, 28, 144, 254, 221, 93, 189, 194, 139, 112, 43, 71, 109, 184, 209,
    ],
    dtype=np.uint8,
)
# Salt of each bucket mapping, and which earlier bytes go with the current one.
TRIPLETS = ((2, 1, 2), (3, 1, 3), (5, 2, 3), (7, 2, 4), (11, 1, 4), (13, 3, 4))

_SEQUENCE = PEARSON.tolist()
_NIBBLES = np.array([(v & 15) << 4 | v >> 4 for v in range(256)], dtype=np.uint8)
_CODE_COST = np.array([0, 1, 2, 6])  # of two bucket codes, by their difference


def _length_code(n: int) -> int:
    if n <= 656:
        value = math.log(n) / math.log(1.5)
    elif n <= 3199:
        value = math.log(n) / math.log(1.3) - 8.72777
    else:
        value = math.log(n) / math.log(1.1) - 62.5472
    return math.floor(value) & 255


class TlshState:
    """Digest of a stream of chunks, in memory that doesn't grow with its length."""

    def __init__(self) -> None:
        self.counts = np.zeros(256, dtype=np.int64)
        self.tail = b""
        self.checksum = 0
        self.length = 0

    def update(self, chunk: bytes) -> None:
        chunk = chunk[: max(0, MAX_BYTES - self.length)]
        if not chunk:
            return
        data = self.tail + chunk
        self.length += len(chunk)
        if len(data) >= 5:
            a = np.frombuffer(data, dtype=np.uint8)
            now = a[4:]
            for salt, i, j in TRIPLETS:
                h = PEARSON[PEARSON[PEARSON[PEARSON[salt] ^ now] ^ a[4 - i : len(a) - i]] ^ a[4 - j : len(a) - j]]
                self.counts += np.bincount(h, minlength=256)
            # The checksum is a chain; all but its last link is computed ahead.
            first = _SEQUENCE[0]
            ahead = PEARSON[PEARSON[first ^ now] ^ a[3:-1]].tobytes()
            c, p, rest = self.checksum, _SEQUENCE, iter(ahead[: len(ahead) // 8 * 8])
            for x0, x1, x2, x3, x4, x5, x6, x7 in zip(*[rest] * 8):  # eight links a turn take half the time of one
                c = p[x7 ^ p[x6 ^ p[x5 ^ p[x4 ^ p[x3 ^ p[x2 ^ p[x1 ^ p[x0 ^ c]]]]]]]]
            for x in ahead[len(ahead) // 8 * 8 :]:
                c = p[x ^ c]
            self.checksum = c
        self.tail = data[-4:]

    def digest(self) -> str | None:
        """``T1`` and 70 hex digits; None below 50 bytes or with too little variety."""
        if self.length < MIN_BYTES:
            return None
        counts = self.counts[:128]
        q1, q2, q3 = np.sort(counts)[[31, 63, 95]].tolist()
        if q3 == 0 or np.count_nonzero(counts) <= 64:
            return None
        codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
        codes = codes.reshape(32, 4)
        body = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
        ratios = (q1 * 100 // q3) % 16 << 4 | (q2 * 100 // q3) % 16
        head = bytes([_NIBBLES[self.checksum], _NIBBLES[_length_code(self.length)], ratios])
        return "T1" + (head + body[::-1].astype(np.uint8).tobytes()).hex().upper()


def tlsh_digest(data: bytes | None) -> str | None:
    """Digest of ``data``; None if it is None, short or has too little variety."""
    if data is None:
        return None
    state = TlshState()
    state.update(bytes(data))
    return state.digest()


def parse(texts) -> tuple[np.ndarray, np.ndarray]:
    """(n, 35) bytes of the digests, and which of them are well-formed; ``T1`` may be missing."""
    out, good = np.zeros((len(texts), 35), dtype=np.uint8), np.zeros(len(texts), dtype=bool)
    for i, t in enumerate(texts):
        if t is None:
            continue
        t = t[2:] if t[:2].upper() == "T1" else t
        try:
            raw = bytes.fromhex(t) if len(t) == 70 else b""
        except ValueError:
            continue
        if len(raw) == 35:
            out[i], good[i] = np.frombuffer(raw, dtype=np.uint8), True
    return out, good


def _around(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    d = np.abs(a.astype(np.int16) - b)
    return np.minimum(d, size - d)


def head_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Part of the distance that comes from the first three bytes; rows of ``a`` against rows of ``b``."""
    length = _around(_NIBBLES[a[..., 1]], _NIBBLES[b[..., 1]], 256)
    cost = np.where(length <= 1, length, length * 12)
    for shift in (4, 0):
        d = _around(a[..., 2] >> shift & 15, b[..., 2] >> shift & 15, 16)
        cost = cost + np.where(d <= 1, d, (d - 1) * 12)
    return cost + (a[..., 0] != b[..., 0])


_BYTE_COST = np.array(
    [[sum(_CODE_COST[abs((x >> s & 3) - (y >> s & 3))] for s in (0, 2, 4, 6)) for y in range(256)] for x in range(256)],
    dtype=np.uint8,
)


def body_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Part of the distance that comes from the 32 bytes of bucket codes."""
    return _BYTE_COST[a[..., 3:], b[..., 3:]].sum(axis=-1, dtype=np.int32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of ``a`` to the row of ``b``."""
    return head_cost(a, b) + body_cost(a, b)


def length_value(a: np.ndarray) -> np.ndarray:
    """The length byte of parsed digests."""
    return _NIBBLES[a[..., 1]]


def distance(x: str, y: str) -> int:
    """Distance of two digest texts; -1 if either is malformed."""
    parsed, good = parse([x, y])
    return int(distances(parsed[0], parsed[1])) if good.all() else INVALID
