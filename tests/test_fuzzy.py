import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievekit.functions import ctph, tlsh

# Published digests, and their distances to the second.
KNOWN = [
    ("T1B683F9DB67586C65EC98A97412CEE6237F33E7950FA2401760A1C4E93E437B67E3980C", 40),
    ("T10483D9DF1B582C51ED4C987012CEA6677F33E7950F92422B60A1C4E92E437BB6E3984C", 0),
    ("T16083DADB57582C64EC989C7412CEA727BF33E7550B92412B60A1C4EA3E437B67E3584C", 26),
]


def test_tlsh_published_distances():
    assert [tlsh.distance(d, KNOWN[1][0]) for d, _ in KNOWN] == [n for _, n in KNOWN]


def slow_tlsh(data):
    v = tlsh.PEARSON.tolist()
    p = lambda s, x, y, z: v[v[v[v[s] ^ x] ^ y] ^ z]
    counts, check = [0] * 256, 0
    for i in range(4, len(data)):
        b = [data[i - k] for k in range(5)]
        check = p(0, b[0], b[1], check)
        for s, x, y in ((2, 1, 2), (3, 1, 3), (5, 2, 3), (7, 2, 4), (11, 1, 4), (13, 3, 4)):
            counts[p(s, b[0], b[x], b[y])] += 1
    c = counts[:128]
    q1, q2, q3 = (sorted(c)[k] for k in (31, 63, 95))
    if q3 == 0 or sum(x > 0 for x in c) <= 64:
        return None
    n = len(data)
    length = math.floor(math.log(n) / math.log(1.5) if n <= 656 else math.log(n) / math.log(1.3) - 8.72777 if n <= 3199 else math.log(n) / math.log(1.1) - 62.5472)
    code = [sum((3 if c[4 * i + k] > q3 else 2 if c[4 * i + k] > q2 else 1 if c[4 * i + k] > q1 else 0) << 2 * k for k in range(4)) for i in range(32)]
    swap = lambda x: (x & 15) << 4 | x >> 4
    return "T1" + bytes([swap(check), swap(length % 256), swap((q1 * 100 // q3) % 16 | (q2 * 100 // q3) % 16 << 4), *code[::-1]]).hex().upper()


@pytest.mark.parametrize("n", [50, 300, 656, 657, 3199, 3200, 9000])
def test_tlsh_equals_slow_version(n):
    data = random.Random(n).randbytes(n)
    assert tlsh.tlsh_digest(data) == slow_tlsh(data)
    state, at = tlsh.TlshState(), 0
    for size in (1, 3, 4, 5, 100, n):
        state.update(data[at : at + size])
        at += size
    assert state.digest() == slow_tlsh(data)


def test_tlsh_limits():
    assert tlsh.tlsh_digest(b"A" * 10) is None and tlsh.tlsh_digest(None) is None and tlsh.tlsh_digest(b"") is None
    assert tlsh.tlsh_digest(random.Random(1).randbytes(49)) is None
    assert tlsh.tlsh_digest(b"A" * 5000) is None
    d = tlsh.tlsh_digest(bytes(range(256)))
    assert d.startswith("T1") and len(d) == 72 and d == d.upper()


def test_tlsh_distance():
    a = tlsh.tlsh_digest(bytes(range(256)))
    b = tlsh.tlsh_digest(bytes((7 * i + 13) % 256 for i in range(1024)))
    assert tlsh.distance(a, a) == tlsh.distance(a[2:], a.lower()) == 0
    assert tlsh.distance(a, b) == tlsh.distance(b, a) > 0
    assert tlsh.distance("invalid", "alsobad") == tlsh.distance(a, "") == tlsh.distance(a + "0", a) == -1
    # Each part of the distance by itself: length, both ratios, checksum, codes.
    t = lambda head, body="00" * 32: "T1" + head + body
    assert [tlsh.distance(t("000000"), t(h)) for h in ("100000", "001000", "002000")] == [1, 1, 24]
    assert tlsh.distance(t("000000"), t("00F000")) == 180 and tlsh.distance(t("000000"), t("00FF00")) == 1
    assert tlsh.distance(t("000000"), t("000001")) == 1 and tlsh.distance(t("000000"), t("000030")) == 24 and tlsh.distance(t("000000"), t("00000F")) == 1
    assert [tlsh.distance(t("000000"), t("000000", c + "0" * 63)) for c in "123456789ABCDEF"] == [1, 2, 6, 1, 2, 3, 7, 2, 3, 4, 8, 6, 7, 8, 12]


def slow_ssdeep(data):
    digits = ctph.DIGITS

    def once(block):
        window, h1, h2, h3 = [0] * 7, 0, 0, 0
        out, h, roll = [[], []], [0x28021967, 0x28021967], 0
        pending = [None, None]
        for i, c in enumerate(data):
            h2 = (h2 - h1 + 7 * c) & 0xFFFFFFFF
            h1 = (h1 + c - window[i % 7]) & 0xFFFFFFFF
            window[i % 7] = c
            h3 = (h3 << 5 & 0xFFFFFFFF) ^ c
            roll = (h1 + h2 + h3) & 0xFFFFFFFF
            for k, limit in ((0, 64), (1, 32)):
                h[k] = (h[k] * 0x01000193 & 0xFFFFFFFF) ^ c
                b = block << k
                if roll % b == b - 1:
                    pending[k] = digits[h[k] & 63]
                    if len(out[k]) < limit - 1:
                        out[k].append(pending[k])
                        h[k], pending[k] = 0x28021967, None
        ended = len(out[0])  # what is left at the end doesn't count towards the block size
        for k in (0, 1):
            if roll:
                out[k].append(digits[h[k] & 63])
            elif pending[k]:
                out[k].append(pending[k])
        return out, ended

    block = 3
    while block * 64 < len(data):
        block *= 2
    while True:
        (a, b), ended = once(block)
        if ended >= 32 or block == 3:
            return f"{block}:{''.join(a)}:{''.join(b)}"
        block //= 2


@pytest.mark.parametrize("n", [0, 1, 6, 50, 191, 192, 193, 3000, 20000])
@pytest.mark.parametrize("kind", ["random", "repeated", "text", "zeros"])
def test_ssdeep_equals_slow_version(n, kind):
    r = random.Random(n)
    data = {"random": r.randbytes(n), "repeated": b"A" * n, "text": bytes(r.choice(b"abcd \n") for _ in range(n)), "zeros": b"ab" * (n // 4) + b"\0" * (n - n // 4 * 2)}[kind]
    assert ctph.ssdeep_digest(data) == slow_ssdeep(data)


@pytest.mark.parametrize("n", [1, 191, 193, 5000, 40_000, 300_000])
@pytest.mark.parametrize("kind", ["random", "repeated", "text", "zeros"])
def test_ssdeep_of_a_stream(n, kind):
    r = random.Random(n)
    data = {"random": r.randbytes(n), "repeated": b"A" * n, "text": bytes(r.choices(b"abcd \n", k=n)), "zeros": b"ab" * (n // 4) + b"\0" * (n - n // 4 * 2)}[kind]
    for step in (1, 5, 700) if n < 1000 else (4096, 100_001):
        assert ctph.ssdeep_stream(lambda: (data[i : i + step] for i in range(0, n, step)), n) == ctph.ssdeep_digest(data)
    assert ctph.ssdeep_stream(lambda: iter([data]), n + 1) is None and ctph.ssdeep_stream(lambda: iter([data]), 1 << 40) is None
    assert ctph.ssdeep_stream(lambda: iter([]), 0) == "3::"


def test_ssdeep_long_signatures():
    long = "ABCDEFGH" * 8
    assert ctph.score(f"3:{long}:x", f"3:{long}:x") == 100 and ctph.score(f"3:{long}I:x", f"3:{long}I:x") == -1 and ctph.score(f"3:{long}:x", f"3:{long}J:x") == -1
    assert ctph.score("3:" + "A" * 90 + ":x", "3:AAA:x") == 100  # runs are cut first
    assert ctph.score("12:éabcdefgh:x", "12:èabcdefgh:y") < 100 and ctph.score("12:éabcdefgh:x", "12:éabcdefgh:y") > 0


def test_ssdeep_nulls_and_repeats():
    assert ctph.ssdeep_digest(None) is None and ctph.ssdeep_digest(b"", empty_is_null=True) is None and ctph.ssdeep_digest(b"") == "3::"
    for c in b"ABC":
        d = ctph.ssdeep_digest(bytes([c]) * 4096)
        assert d and ctph.score(d, d) == 100


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def slow_score(x, y):
    def parts(t):
        b, s, u = t.split(":")
        return int(b), ctph.shorten(s), ctph.shorten(u)

    def one(a, b, block):
        if len(a) < 7 or len(b) < 7 or not any(a[i : i + 7] in b for i in range(len(a) - 6)):
            return 0
        d = len(a) + len(b) - 2 * slow_lcs(a, b)
        s = 100 - 100 * (d * 64 // (len(a) + len(b))) // 64
        return min(s, block // 3 * min(len(a), len(b))) if block < 45 else s

    (bx, x1, x2), (by, y1, y2) = parts(x), parts(y)
    if (bx, x1, x2) == (by, y1, y2):
        return 100
    if bx == by:
        return max(one(x1, y1, bx), one(x2, y2, 2 * bx))
    return one(x1, y2, bx) if bx == 2 * by else one(x2, y1, by) if by == 2 * bx else 0


def near(r, s):
    out = list(s)
    for _ in range(r.randint(0, 12)):
        k = r.randrange(len(out))
        match r.randrange(3):
            case 0:
                out[k] = r.choice(ctph.DIGITS)
            case 1:
                out.insert(k, r.choice(ctph.DIGITS))
            case _:
                if len(out) > 1:
                    del out[k]
    return "".join(out)


def some_digests(r, n):
    out = []
    for _ in range(n):
        s, u = ("".join(r.choices(ctph.DIGITS[: r.choice((4, 64))], k=r.randint(1, k))) for k in (64, 32))
        b = 3 << r.randint(0, 4)
        out.append(f"{b}:{s}:{u}")
        for _ in range(3):
            c = b * r.choice((1, 1, 2))
            v, w = (near(r, s), near(r, u)) if c == b else (near(r, u), near(r, u))
            out.append(f"{c}:{v[:64]}:{w[:32]}")
    return out


def test_ssdeep_scores_equal_slow_version():
    r = random.Random(5)
    t = some_digests(r, 40)
    pairs = [(x, y) for x in t for y in t]
    got = ctph.scores([x for x, _ in pairs], [y for _, y in pairs])
    assert got.tolist() == [slow_score(x, y) for x, y in pairs]
    keys, at = ctph.window_keys(t)
    by = {i: set(keys[at == i].tolist()) for i in range(len(t))}
    for k, (x, y) in enumerate(pairs):  # what scores has a key in common
        if got[k] > 0:
            assert by[k // len(t)] & by[k % len(t)]


def test_short_signatures_that_are_equal_when_shortened():
    x, y = "3:aaaab:c", "3:aaaaaab:c"
    keys, at = ctph.window_keys([x, y, "6:aaaab:c", "3:ab:c"])
    assert ctph.score(x, y) == 100 and len(keys) == 4 and keys[at == 0] == keys[at == 1] and len(set(keys.tolist())) == 3


def test_ssdeep_malformed():
    assert ctph.score("3:abc:def", "96:zzz:yyy") == 0
    assert [ctph.score(a, "3:abc:def") for a in ("", "abc", "x:abc:def", "0:abc:def", "3:abc")] == [-1] * 5
    odd = ["9" * 30 + ":a:b", "3:éééééé:b", "3:日本語日本語日本語:b", "999999999999:abcdefgh:abcdefgh"]
    assert ctph.score(odd[0], odd[0]) == -1 and len(ctph.window_keys(odd)[0]) > 2
    assert ctph.score(None, "3:a:b") == -1 and ctph.score('3:abc:def,"/x"', "3:abc:def") == 100


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=1, max_size=64), st.text("abc", min_size=1, max_size=64))
def test_common_subsequence(a, b):
    (x, _), (y, _) = ctph._matrix([a]), ctph._matrix([b])
    assert ctph.common_subsequence(x, y).tolist() == [slow_lcs(a, b)]


@given(st.text("ab", max_size=30))
def test_shorten(s):
    import re

    assert ctph.shorten(s) == re.sub(r"(.)\1{3,}", r"\1\1\1", s)


def test_tables_are_permutations():
    assert sorted(tlsh.PEARSON.tolist()) == list(range(256)) and np.unique(list(ctph.DIGITS)).size == 64
