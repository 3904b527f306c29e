"""Context triggered piecewise hashing (ssdeep): digest and score, in numpy.

From the published description (Kornblum 2006).  No digests of known files are at
hand here, so agreement of digests with other implementations isn't proven.
"""

from __future__ import annotations

import numpy as np

WINDOW = 7
PIECE = 5  # characters of a key; three of them lie in a window
SEGMENT = 6  # characters of a stored segment; two of them lie in a window
MIN_BLOCK = 3
MAX_FIRST, MAX_SECOND = 64, 32
MAX_BYTES = 1 << 32  # in memory; a file may have MIN_BLOCK << 36
MAX_DIGITS = 12  # of a block size
INVALID = -1
# The piece hash's start and factor, of which six bits matter, and the digits.
PIECE_START, PIECE_FACTOR = 0x28021967 & 63, 0x01000193 & 63
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_STEP = [bytes((h * PIECE_FACTOR & 63) ^ (c & 63) for c in range(256)) for h in range(64)]
_LONG = 6144  # bytes from which the vector form is faster
_SAFE_BLOCK = MIN_BLOCK * ((99 + WINDOW) // WINDOW)


def _rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: it depends on the last seven bytes only."""
    padded = np.concatenate([np.zeros(WINDOW - 1, dtype=np.uint32), data.astype(np.uint32)])
    n, out = len(data), np.zeros(len(data), dtype=np.uint32)
    shifted = np.zeros(n, dtype=np.uint32)
    for back in range(WINDOW):
        x = padded[WINDOW - 1 - back : WINDOW - 1 - back + n]
        out += x * np.uint32(1 + WINDOW - back)
        shifted ^= x << np.uint32(5 * back)
    return out + shifted


def _states(data: np.ndarray, starts: np.ndarray, first: int = PIECE_START) -> np.ndarray:
    """The piece hash after each byte, for pieces that begin at ``starts``, without a loop over bytes; ``first``: the
    hash from which the first one goes on.

    Bit k of a product depends on no higher bit of its factors, so with the lower bits known bit k only flips or
    stays: a running exclusive or, one for each of the six bits, cut where a piece begins.
    """
    piece = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(data)))
    state, before = np.zeros(len(data), dtype=np.uint8), np.empty(len(data), dtype=np.uint8)
    begin = np.full(len(starts), PIECE_START, dtype=np.uint8)
    begin[:1] = first
    for k in range(6):
        before[1:] = state[:-1]
        before[starts] = begin & np.uint8((1 << k) - 1)
        flips = np.bitwise_xor.accumulate((before * np.uint8(PIECE_FACTOR) >> np.uint8(k) ^ data >> np.uint8(k)) & np.uint8(1))
        outside = flips[starts - 1]
        outside[0] = 0
        state |= (flips ^ (outside ^ begin >> np.uint8(k) & np.uint8(1))[piece]) << np.uint8(k)
    return state


def _pieces(data: bytes, ends: np.ndarray, limit: int, tail: bool) -> str:
    """A digit for each piece; once ``limit`` is reached, later pieces go into the last one."""
    if len(data) >= _LONG:
        ends = ends.astype(np.int64)
        kept = ends[: limit - 1]
        last = len(data) if tail else int(ends[-1]) + 1 if len(ends) >= limit else 0
        after = int(kept[-1]) + 1 if len(kept) else 0
        reached = [*kept.tolist(), *([last - 1] if last > after else [])]
        starts = np.concatenate([[0], kept[kept < len(data) - 1] + 1])
        digits = [DIGITS[h] for h in _states(np.frombuffer(data, dtype=np.uint8), starts)[reached]]
        return "".join(digits + [DIGITS[PIECE_START]] * (tail and last == after))
    cuts = ends.tolist()
    digits, start = [], 0
    for end in cuts[: limit - 1]:
        h = PIECE_START
        for c in data[start : end + 1]:
            h = _STEP[h][c]
        digits.append(DIGITS[h])
        start = end + 1
    rest = len(data) if tail else (cuts[-1] + 1 if len(cuts) >= limit else start)
    if tail or rest > start:
        h = PIECE_START
        for c in data[start:rest]:
            h = _STEP[h][c]
        digits.append(DIGITS[h])
    return "".join(digits)


def ssdeep_digest(data: bytes | None, empty_is_null: bool = False) -> str | None:
    """``blocksize:sig1:sig2`` of ``data``.  None for None and from 4 GiB on; of an empty input
    ``3::``, or None with ``empty_is_null``."""
    if data is None or len(data) >= MAX_BYTES or (not data and empty_is_null):
        return None
    data = bytes(data)
    if not data:
        return f"{MIN_BLOCK}::"
    rolled = _rolling(np.frombuffer(data, dtype=np.uint8))
    tail, block = bool(rolled[-1]), MIN_BLOCK
    while block * MAX_FIRST < len(data):
        block *= 2
    while True:
        ends = np.flatnonzero(rolled % np.uint32(block) == block - 1)
        if block > MIN_BLOCK and len(ends) < MAX_FIRST // 2:  # pieces that end; what is left at the end doesn't count
            block //= 2
            continue
        twice = ends[rolled[ends] % np.uint32(2 * block) == 2 * block - 1]
        return f"{block}:{_pieces(data, ends, MAX_FIRST, tail)}:{_pieces(data, twice, MAX_SECOND, tail)}"


class _Level:
    """One signature of a stream of chunks."""

    def __init__(self, block: int, limit: int) -> None:
        self.block, self.limit, self.digits, self.state, self.capped = block, limit, "", PIECE_START, ""

    def feed(self, data: np.ndarray, rolled: np.ndarray) -> None:
        ends = np.flatnonzero(rolled % np.uint32(self.block) == self.block - 1)
        cuts = ends[: self.limit - 1 - len(self.digits)]
        starts = np.concatenate([[0], cuts + 1])
        states = _states(data, starts[starts < len(data)], self.state)
        self.digits += "".join(DIGITS[h] for h in states[cuts])
        if len(ends) > len(cuts):
            self.capped = DIGITS[states[ends[-1]]]
        self.state = PIECE_START if len(cuts) and cuts[-1] == len(data) - 1 else int(states[-1])

    def signature(self, tail: bool) -> str:
        return self.digits + (DIGITS[self.state] if tail else self.capped)


def ssdeep_stream(chunks, size: int) -> str | None:
    """The digest of ``size`` bytes that ``chunks()`` gives piece by piece, twice: to count the ends of pieces by block size, and to
    hash those of the two that are used.  Memory doesn't grow with the size.  None beyond 192 GiB, or if the bytes are fewer or more."""

    def rolled():
        before, seen = np.zeros(0, dtype=np.uint8), 0
        for chunk in chunks():
            data = np.frombuffer(chunk, dtype=np.uint8)
            seen += len(data)
            if seen > size:
                break
            if len(data):
                both = np.concatenate([before, data])
                yield data, _rolling(both)[len(before) :]
                before = both[1 - WINDOW :]
        if seen != size:
            raise EOFError

    if size > MIN_BLOCK << 36:
        return None
    if size == 0:
        return f"{MIN_BLOCK}::"
    levels = max(0, (-(-size // (MIN_BLOCK * MAX_FIRST)) - 1).bit_length())
    counts, tail = np.zeros(levels + 1, dtype=np.int64), False
    try:
        for _, hashes in rolled():
            for k in range(levels + 1):
                counts[k] += np.count_nonzero(hashes % np.uint32(MIN_BLOCK << k) == (MIN_BLOCK << k) - 1)
            tail = bool(hashes[-1])
        while levels and counts[levels] < MAX_FIRST // 2:
            levels -= 1
        first, second = _Level(MIN_BLOCK << levels, MAX_FIRST), _Level(MIN_BLOCK << levels + 1, MAX_SECOND)
        for data, hashes in rolled():
            first.feed(data, hashes)
            second.feed(data, hashes)
    except EOFError:
        return None
    return f"{first.block}:{first.signature(tail)}:{second.signature(tail)}"


def parse(text: str | None) -> tuple[int, str, str] | None:
    """Block size and both signatures, runs cut to three; None if malformed or if a signature is longer than 64 bytes then.

    What follows a comma (a quoted path) is ignored; characters beyond ASCII count as their bytes.
    """
    parts = text.split(",", 1)[0].split(":") if text else []
    if len(parts) != 3 or not parts[0].isascii() or not parts[0].isdigit() or len(parts[0]) > MAX_DIGITS or int(parts[0]) == 0:
        return None
    first, second = (shorten(p if p.isascii() else p.encode("utf-8", "surrogatepass").decode("latin-1")) for p in parts[1:])
    return None if max(len(first), len(second)) > MAX_FIRST else (int(parts[0]), first, second)


def shorten(sig: str) -> str:
    """``sig`` with runs of more than three equal characters cut to three."""
    if len(sig) < 4:
        return sig
    return sig[:3] + "".join(c for i, c in enumerate(sig[3:]) if not c == sig[i] == sig[i + 1] == sig[i + 2])


def _matrix(sigs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters, zero-padded to 64, and lengths."""
    raw = b"".join(s.encode("latin-1").ljust(64, b"\0") for s in sigs)
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, 64), np.array([len(s) for s in sigs], dtype=np.int64)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of ``a`` and of ``b`` (zero-padded, up to
    64 characters): one bit vector a pair, one step a character, all pairs at once."""
    ones, v = np.uint64(0xFFFFFFFFFFFFFFFF), np.full(len(a), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for j in range(b.shape[1]):
        c = b[:, j]
        if not c.any():
            break
        where = np.packbits((a == c[:, None]) & (c[:, None] != 0), axis=1, bitorder="little").view(np.uint64)[:, 0]
        u = v & where
        v = (v + u) | (v - u)
    return np.bitwise_count(~v & ones).astype(np.int64)


def _grams(a: np.ndarray) -> np.ndarray:
    """The 58 windows of seven characters of each row as integers; 0 where one reaches past the end."""
    wide = a.astype(np.uint64)
    out = np.zeros((len(a), 58), dtype=np.uint64)
    for k in range(WINDOW):
        out = out << np.uint64(8) | wide[:, k : k + 58]
    return np.where(a[:, 6:64] != 0, out, np.uint64(0))


def share_window(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rows have seven characters in a row in common."""
    x, y = np.sort(_grams(a), axis=1), np.sort(_grams(b), axis=1)
    both = np.sort(np.concatenate([_unique(x), _unique(y)], axis=1), axis=1)
    return ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != 0)).any(axis=1)


def _unique(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[:, 1:][x[:, 1:] == x[:, :-1]] = 0
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def window_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys such that digests with a score above 0 have one in common, and the row of each key.

    Of each window of seven characters the five-character piece with the least hash is taken: equal windows choose
    the same, and neighbouring windows mostly too, which halves the keys.  The block size is part of the key.
    """
    rows, sigs, blocks, short = [], [], [], []
    for i, t in enumerate(texts):
        p = parse(t)
        if p:
            if len(p[1]) < WINDOW:  # equal after shortening is the only way to score without a window
                short.append(((int.from_bytes(p[1].encode(), "big") << 8 | len(p[1])) & 0xFFFFFFFFFFFFFFFF, p[0], i))
            for s, block in ((p[1], p[0]), (p[2], 2 * p[0])):
                if len(s) >= WINDOW:
                    rows.append(i)
                    sigs.append(s)
                    blocks.append(block)
    whole = np.array(short, dtype=np.uint64).reshape(-1, 3)
    whole = np.stack([mix(whole[:, 0] + mix(whole[:, 1] + np.uint64(1 << 40))), whole[:, 2]], axis=1)
    if not rows:
        return np.ascontiguousarray(whole[:, 0]).view(np.int64), whole[:, 1].astype(np.int64)
    a, n = _matrix(sigs)
    wide = a.astype(np.uint64)
    grams = np.zeros((len(a), 60), dtype=np.uint64)
    for k in range(PIECE):
        grams = grams << np.uint64(8) | wide[:, k : k + 60]
    h = mix(grams + mix(np.array(blocks, dtype=np.uint64))[:, None])
    least = np.minimum(np.minimum(h[:, :58], h[:, 1:59]), h[:, 2:60])
    inside = np.arange(58)[None, :] + WINDOW <= n[:, None]
    at, _ = np.nonzero(inside)
    both = np.unique(np.stack([np.array(rows, dtype=np.uint64)[at], least[inside]], axis=1), axis=0)
    both = np.concatenate([both, whole[:, ::-1]])
    return np.ascontiguousarray(both[:, 1]).view(np.int64), both[:, 0].astype(np.int64)


def segment_keys(texts: list[str], spaces: np.ndarray, step: int) -> dict[str, np.ndarray]:
    """Hashed segments of ``SEGMENT`` characters at every ``step``-th place of both shortened signatures of each digest: ``row`` of the
    text, ``key`` (space and block size are part of it), ``length`` of the signature and ``at``, the place.

    Of a window of seven characters two segments of six begin in it, one of them at an even place: a digest stored with step 2 and
    one that asks with step 1 meet under every window that both have.  A first signature too short for a window is one
    segment, as only an equal one scores.
    """
    rows, sigs, blocks, whole = [], [], [], []
    for i, t in enumerate(texts):
        p = parse(t)
        if p:
            if len(p[1]) < WINDOW:
                whole.append((i, p[0], int.from_bytes(p[1].encode("latin-1"), "big") << 8 | len(p[1])))
            for s, block in ((p[1], p[0]), (p[2], 2 * p[0])):
                if len(s) >= WINDOW:
                    rows.append(i)
                    sigs.append(s)
                    blocks.append(block)
    a, n = _matrix(sigs)
    row, wide = np.array(rows, dtype=np.int64), a.astype(np.uint64)
    base = lambda at, block: mix(mix(np.array(block, dtype=np.uint64)) + spaces[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    grams = np.zeros((len(a), 64 - SEGMENT + 1), dtype=np.uint64)
    for k in range(SEGMENT):
        grams = grams << np.uint64(8) | wide[:, k : k + grams.shape[1]]
    grams = mix(grams + base(row, blocks)[:, None])[:, ::step]
    of, place = np.nonzero(np.arange(0, 64 - SEGMENT + 1, step)[None, :] + SEGMENT <= n[:, None])
    w = np.array(whole, dtype=np.uint64).reshape(-1, 3)
    first = w[:, 0].astype(np.int64)
    return {
        "row": np.concatenate([row[of], first]),
        "key": np.concatenate([grams[of, place], mix(w[:, 2] + base(first, w[:, 1]) + np.uint64(1))]).view(np.int64),
        "length": np.concatenate([n[of], (w[:, 2] & np.uint64(255)).astype(np.int64)]).astype(np.int32),
        "at": np.concatenate([place * step, np.zeros(len(w), dtype=np.int64)]).astype(np.int32),
    }


def signature_scores(a: list[str], b: list[str], block: np.ndarray) -> np.ndarray:
    """Score of each pair of shortened signatures of one block size."""
    out = np.zeros(len(a), dtype=np.int64)
    if not a:
        return out
    (ma, la), (mb, lb) = _matrix(a), _matrix(b)
    some = np.flatnonzero((la >= WINDOW) & (lb >= WINDOW))
    some = some[share_window(ma[some], mb[some])]
    if not len(some):
        return out
    ma, mb, la, lb, block = ma[some], mb[some], la[some], lb[some], block[some]
    edits = la + lb - 2 * common_subsequence(ma, mb)
    score = 100 - 100 * (edits * 64 // (la + lb)) // 64
    cap = block // MIN_BLOCK * np.minimum(la, lb)
    out[some] = np.where(block < _SAFE_BLOCK, np.minimum(score, cap), score)
    return out


def scores(xs: list[str | None], ys: list[str | None]) -> np.ndarray:
    """Score 0 to 100 of each pair of digest texts; -1 where either is malformed."""
    out = np.zeros(len(xs), dtype=np.int64)
    jobs: list[tuple[int, int, str, str]] = []
    cache: dict[str | None, tuple[int, str, str] | None] = {}
    for i, (x, y) in enumerate(zip(xs, ys)):
        p = cache[x] if x in cache else cache.setdefault(x, parse(x))
        q = cache[y] if y in cache else cache.setdefault(y, parse(y))
        if p is None or q is None:
            out[i] = INVALID
        elif p == q:
            out[i] = 100
        elif p[0] == q[0]:
            jobs += (i, p[0], p[1], q[1]), (i, 2 * p[0], p[2], q[2])
        elif p[0] == 2 * q[0]:
            jobs.append((i, p[0], p[1], q[2]))
        elif 2 * p[0] == q[0]:
            jobs.append((i, q[0], p[2], q[1]))
    if jobs:
        at, block, a, b = zip(*jobs)
        np.maximum.at(out, np.array(at), signature_scores(list(a), list(b), np.array(block, dtype=np.int64)))
    return out


def score(x: str | None, y: str | None) -> int:
    return int(scores([x], [y])[0])
