"""Joins of near pairs: multi-index Hamming joins of TLSH and ssdeep digests, a prefix join of short texts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions import ctph, tlsh
from sievekit.functions.ctph import mix
from sievekit.llm.pairs import pairs_with_common_key, with_values
from sievekit.session import written

# ---- TLSH: 128 two-bit codes in 16 chunks of eight codes

CHUNKS = 16
CELL_WIDTH = 4  # length values; more apart than this many cost more than the greatest limit
CELLS = 256 // CELL_WIDTH
UNIT_ROWS = 65_536  # two such sides are some 8 MB to move for up to 15 seconds of work
TEXT_UNIT_ROWS = 16_384
GREATEST_LIMIT = 47
PAIR = "id_1 long, id_2 long, distance int"


def chunk_radii(limit: int) -> list[int]:
    """Errors allowed in each chunk so that a pair within ``limit`` is within them in some chunk."""
    need = limit + 1  # the radii plus one must add up to more than the limit
    return [need // CHUNKS + (i < need % CHUNKS) - 1 for i in range(CHUNKS)]


class Balls:
    """For each 16-bit chunk the chunks that differ by at most ``radius`` in cost (sum of code differences)."""

    def __init__(self) -> None:
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __call__(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets by chunk, and the neighbours in a row."""
        if radius not in self.made:
            values = np.arange(1 << 16, dtype=np.int32)
            codes = [(values >> s & 3).astype(np.int8) for s in range(0, 16, 2)]
            columns: list[np.ndarray] = []

            def grow(first: int, left: int, now: np.ndarray) -> None:
                columns.append(now)
                for p in range(first, 8):
                    for step in (-2, -1, 1, 2):
                        if abs(step) <= left:
                            fits = (codes[p] + step >= 0) & (codes[p] + step <= 3) & (now >= 0)
                            grow(p + 1, left - abs(step), np.where(fits, now + (step << 2 * p), -1))

            grow(0, radius, values)
            table = np.stack(columns, axis=1)
            good = table >= 0
            self.made[radius] = np.concatenate([[0], np.cumsum(good.sum(1))]), table[good].astype(np.uint16)
        return self.made[radius]


_balls = Balls()


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers of the ranges that begin at ``starts`` and have ``counts`` members, in a row."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def _chunks(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a[:, 3:]).view("<u2")


def near_in_memory(left: np.ndarray, right: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of all pairs of parsed digests within ``limit``, and their distances: index of chunks
    over ``right``, probed with every chunk that the radii allow."""
    x, y, found = _chunks(left), _chunks(right), []
    for c, radius in enumerate(chunk_radii(limit)):
        if radius < 0:
            continue
        order = np.argsort(y[:, c], kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(y[:, c], minlength=1 << 16))])
        offsets, around = _balls(radius)
        step = max(64, min(4096, (1 << 28) // max(1, len(y))))  # bounds the pairs at once
        for low in range(0, len(x), step):
            own = x[low : low + step, c].astype(np.int64)
            n = offsets[own + 1] - offsets[own]
            probe = around[_expand(offsets[own], n)].astype(np.int64)
            who = np.repeat(np.arange(low, low + len(own)), n)
            hits = starts[probe + 1] - starts[probe]
            some = np.flatnonzero(hits)
            if len(some):
                i = np.repeat(who[some], hits[some])
                j = order[_expand(starts[probe[some]], hits[some])]
                cheap = tlsh.head_cost(left[i], right[j]) <= limit
                i, j = i[cheap], j[cheap]
                # The distance decides at once, so that no more is held than there are near pairs.
                d = np.concatenate([tlsh.distances(left[i[k : k + 100_000]], right[j[k : k + 100_000]]) for k in range(0, len(i), 100_000)] or [i])
                near = d <= limit
                found.append((i[near] * len(y) + j[near], d[near]))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    both, first = np.unique(np.concatenate([f for f, _ in found]), return_index=True)
    return both // len(y), both % len(y), np.concatenate([d for _, d in found])[first]


def join_units(limit: int, two_sides: bool = False):
    """For ``mapInArrow`` over rows sorted by unit: pairs within the limit of each unit's left and right rows.
    With ``two_sides`` ``id_1`` is the left one; otherwise ids are in order, and a block meets itself once."""

    def unit(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        ids, is_left, own = t["id"].to_numpy(), t["is_left"].to_numpy(), t["a"].to_numpy() == t["b"].to_numpy()
        sig, _ = tlsh.parse(t["sig"].to_pylist())
        left = np.flatnonzero(is_left)
        right = left if not two_sides and own[0] and not t["step"][0].as_py() else np.flatnonzero(~is_left)
        i, j, d = near_in_memory(sig[left], sig[right], limit) if len(left) and len(right) else (np.zeros(0, int),) * 3
        i, j = ids[left[i]], ids[right[j]]
        once = i < j if right is left else i != j
        i, j, d = i[once], j[once], d[once]
        if not two_sides:
            i, j = np.minimum(i, j), np.maximum(i, j)
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(d.astype(np.int32))], ["id_1", "id_2", "distance"])

    def run(batches):
        held, current = [], None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("cell", "a", "step", "b")], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if held and key[low].tolist() != current:
                    yield unit(held)
                    held = []
                current = key[low].tolist()
                held.append(b.slice(low, high - low))
        if held:
            yield unit(held)

    return run


def length_cell(plain: Column) -> Column:
    """The cell, 0 to 63, of a tlsh digest's length byte."""
    return F.floor(F.conv(F.reverse(F.substring(plain, 5, 2)), 16, 10).cast("int") / CELL_WIDTH).cast("int")


def tlsh_rows(df: DataFrame) -> DataFrame:
    """``df`` without what is no tlsh digest, with its digits ``sig`` and its cell ``own``."""
    return df.where(F.col("plain").rlike("^T1[0-9A-F]{70}$")).withColumns({"sig": F.substring("plain", 3, 70), "own": length_cell(F.col("plain"))})


def tlsh_pairs(df: DataFrame, limit: int = 40, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """All pairs of TLSH digests within ``limit`` of ``df`` (``id`` long, unique; ``plain``, distinct plain forms).

    The length byte alone rules out pairs more than three values apart, so digests meet in cells of four length values
    and in the next cell; cells of more than ``unit_rows`` are cut into blocks, and each pair of blocks is a unit of
    bounded size.  Within a unit the 128 two-bit codes are split into 16 chunks; by the pigeonhole principle a pair within
    the limit has some chunk within the errors allowed for it, and all those errors are enumerated: no pair is missed.

    Result: ``id_1 < id_2``, ``distance``.  Nulls and other texts are left out.
    """
    if not 0 <= limit <= GREATEST_LIMIT:
        raise ValueError(f"limit must be 0 to {GREATEST_LIMIT}")
    key = ["cell", "a", "step", "b"]
    return tlsh_units(df, unit_rows).repartition(*key).sortWithinPartitions(*key).mapInArrow(join_units(limit), PAIR)


def tlsh_units(df: DataFrame, unit_rows: int) -> DataFrame:
    """The digests by the units in which they meet others: ``cell``, ``a``, ``step``, ``b``, ``is_left``, ``id``, ``sig``."""
    cells = CELLS
    rows = tlsh_rows(df).select("id", "sig", "own")
    counts = {r["own"]: r["n"] for r in rows.groupBy("own").agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    blocks = [max(1, math.ceil(counts.get(c, 0) / unit_rows)) for c in range(cells)]
    of = lambda cell: F.element_at(F.array(*map(F.lit, blocks)), F.pmod(cell, F.lit(cells)) + 1)
    own, mine = F.col("own"), F.col("mine")
    step = lambda k: F.pmod(own + k, F.lit(cells)).cast("int")
    unit = lambda cell, a, k, b, left: F.struct(cell.alias("cell"), a.cast("int").alias("a"), F.lit(k).alias("step"), b.cast("int").alias("b"), F.lit(left).alias("is_left"))
    units = F.concat(
        F.transform(F.sequence(mine, of(own) - 1), lambda t: unit(own, mine, 0, t, True)),
        F.transform(F.filter(F.sequence(F.lit(0), mine), lambda t: t < mine), lambda t: unit(own, t, 0, mine, False)),
        F.transform(F.sequence(F.lit(0), of(step(1)) - 1), lambda t: unit(own, mine, 1, t, True)),
        F.transform(F.sequence(F.lit(0), of(step(-1)) - 1), lambda t: unit(step(-1), t, 1, mine, False)),
    )
    return rows.withColumn("mine", F.pmod(F.xxhash64("id"), of(own)).cast("int")).select("id", "sig", F.explode(units).alias("u")).select("u.*", "id", "sig")


# ---- ssdeep: a score above 0 needs seven characters in common, so the chunks are windows without errors

def _ssdeep_keys(batches):
    for b in batches:
        keys, at = ctph.window_keys(b.column("plain").to_pylist())
        ids = b.column("id").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[at].astype(np.int64))], ["key", "id"])


def _ssdeep_scores(least: int):
    def run(batches):
        for b in batches:
            s = ctph.scores(b.column("value_1").to_pylist(), b.column("value_2").to_pylist())
            t = pa.RecordBatch.from_arrays([b.column("id_1"), b.column("id_2"), pa.array(s.astype(np.int32))], ["id_1", "id_2", "score"])
            yield t.filter(pa.array(s >= least))

    return run


def ssdeep_pairs(df: DataFrame, least: int = 40) -> DataFrame:
    """All pairs of ssdeep digests with a score of at least ``least`` (above 0) of ``df`` (``id`` long, unique;
    ``plain``, distinct plain forms): ``id_1 < id_2``, ``score``.  Nulls and other texts are left out.

    Candidates have a chosen piece of a seven-character window and the block size in common, which
    every pair with a score above 0 has; the score then decides.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    rows = df.where(F.col("plain").rlike("^[0-9]+:[^:]*:[^:]*$"))
    keys = written(rows.select("id", "plain").mapInArrow(_ssdeep_keys, "key long, id long"))
    pairs = with_values(pairs_with_common_key(keys), rows, "plain")
    return pairs.mapInArrow(_ssdeep_scores(least), "id_1 long, id_2 long, score int")


# ---- short texts: prefixes of their n-character pieces, the rarest first

SLOTS = 1 << 16  # pieces are counted in so many
WORDS = 4  # of 64 parity bits a text
SMALL = 64  # units of fewer rows are compared together
TILE = 256
AT_ONCE = 1 << 20


def text_grams(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct ``size``-character pieces of each text in a row, and where each text begins."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(points) < size:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    h = np.zeros(len(points) - size + 1, dtype=np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + len(h)] + np.uint64(1))
    n = np.maximum(lengths - size + 1, 0)
    h, row = h[_expand(np.cumsum(lengths) - lengths, n)], np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(texts)))])


def _slot_counts(size: int):
    def run(batches):
        counts = np.zeros(SLOTS, dtype=np.int64)
        for b in batches:
            h, _ = text_grams(b.column("text").to_pylist(), size)
            counts += np.bincount((h & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["slot", "n"])

    return run


def _differ(least: float) -> float:
    """What two texts' pieces not in common are at most, as a share of the pieces of both, in a pair that meets ``least``."""
    return (1 - least) / (1 + least)


def parities(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """256 bits of each text: which slots hold an odd number of its pieces.  Two texts differ in at most as many bits as
    they have pieces not in common."""
    words = np.zeros((n, WORDS), dtype=np.uint64)
    np.bitwise_xor.at(words, (row, (h >> np.uint64(62)).astype(np.int64)), np.uint64(1) << (h >> np.uint64(56) & np.uint64(63)))
    return words


def _prefixes(size: int, least: float, unit_rows: int, counts):
    """For each text a row for each piece of its prefix, and for each pair of blocks where the piece is in many texts."""

    def run(batches):
        seen = counts.value
        for whole in batches:
            for first in range(0, whole.num_rows, 2_000):
                b = whole.slice(first, 2_000)
                ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                h, starts = text_grams(b.column("text").to_pylist(), size)
                n = np.diff(starts)
                row = np.repeat(np.arange(len(ids)), n)
                words = parities(h, row, len(ids))
                often = seen[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
                order = np.lexsort((h, often, row))  # one order of pieces for all texts, the rarest first
                h, often = h[order], often[order]
                prefix = n - np.ceil(least * n - 1e-6).astype(np.int64) + 1
                keep = np.flatnonzero((np.arange(len(h)) - starts[row] < prefix[row]) & (often > 1))
                h, row, blocks = h[keep], row[keep], -(-often[keep] // unit_rows)
                own = (mix(ids.astype(np.uint64))[row] % blocks.astype(np.uint64)).astype(np.int64)
                ends = np.cumsum(blocks)
                low = 0
                while low < len(h):
                    high = max(low + 1, int(np.searchsorted(ends, ends[low] - blocks[low] + AT_ONCE, "right")))
                    part = np.repeat(np.arange(low, high), blocks[low:high])
                    other, mine, of = _expand(np.zeros(high - low, dtype=np.int64), blocks[low:high]), own[part], row[part]
                    key = h[part]
                    for block in (np.minimum(mine, other), np.maximum(mine, other)):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + block.astype(np.uint64) + np.uint64(1))
                    columns = [key.view(np.int64), np.sign(mine - other).astype(np.int32), ids[of], n[of].astype(np.int32), *words[of].view(np.int64).T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["key", "side", "id", "n", *(f"w{k}" for k in range(WORDS))])
                    low = high

    return run


def _candidates(least: float):
    """For ``mapInArrow`` over rows sorted by key: pairs of each unit whose parities don't rule them out."""
    share = _differ(least)

    def near(words: np.ndarray, half: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs, one by one."""
        return np.bitwise_count(words[:, i] ^ words[:, j]).sum(0, dtype=np.int32) <= half[i] + half[j]

    def tile(words: np.ndarray, half: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs of ``a`` and ``b``, all with all."""
        d = np.zeros((len(a), len(b)), dtype=np.uint8)  # all 256 bits wrong count as none, which rules nothing out
        for w in words:
            d += np.bitwise_count(w[a][:, None] ^ w[b])
        i, j = np.nonzero(d <= half[a][:, None] + half[b])
        return a[i], b[j]

    def pairs(t: pa.Table) -> pa.RecordBatch:
        key, side, ids, n = (t[c].to_numpy() for c in ("key", "side", "id", "n"))
        words = np.stack([t[f"w{k}"].to_numpy() for k in range(WORDS)]).view(np.uint64)
        half = (share * n + 1e-3).astype(np.float32)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        little = sizes < SMALL
        at = np.flatnonzero(np.repeat(little, sizes))
        after = np.repeat(starts + sizes, sizes)[at] - at - 1
        found = []
        for low in range(0, len(at), AT_ONCE // SMALL):
            p, m = at[low : low + AT_ONCE // SMALL], after[low : low + AT_ONCE // SMALL]
            i, j = np.repeat(p, m), _expand(p + 1, m)
            good = near(words, half, i, j) & ((side[i] != side[j]) | (side[i] == 0))
            found.append((i[good], j[good]))
        for start, length in zip(starts[~little], sizes[~little]):
            rows = np.arange(start, start + length)
            kinds = [rows[side[start : start + length] == k] for k in (0, -1, 1)]
            for a, b in ((kinds[0], None), (kinds[1], kinds[2])):
                for low in range(0, len(a), TILE):
                    for right in range(low if b is None else 0, len(a if b is None else b), 16 * TILE):
                        i, j = tile(words, half, a[low : low + TILE], (a if b is None else b)[right : right + 16 * TILE])
                        found.append((i, j) if b is not None else (i[i < j], j[i < j]))
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        fit = np.abs(n[i] - n[j]) <= half[i] + half[j]  # the numbers of pieces alone can rule a pair out
        i, j = ids[i[fit]], ids[j[fit]]
        both = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1) if len(i) else np.zeros((2, 0), dtype=np.int64)
        both = both[:, both[0] != both[1]]
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["id_1", "id_2"])

    def run(batches):
        held = None  # the last unit, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            key = t["key"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield pairs(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield pairs(held)

    return run


def _jaccard(size: int, least: float):
    def run(batches):
        for b in batches:
            x, y = b.column("value_1").to_pylist(), b.column("value_2").to_pylist()
            cache: dict[str, set[str]] = {}
            grams = lambda t: cache.get(t) or cache.setdefault(t, {t[i : i + size] for i in range(len(t) - size + 1)})
            s = np.zeros(len(x))
            for i, (p, q) in enumerate(zip(x, y)):
                p, q = grams(p), grams(q)
                both = len(p & q)
                s[i] = both / (len(p) + len(q) - both)
            t = pa.RecordBatch.from_arrays([b.column("id_1"), b.column("id_2"), pa.array(s)], ["id_1", "id_2", "similarity"])
            yield t.filter(pa.array(s >= least))

    return run


def text_pairs(df: DataFrame, size: int = 4, least: float = 0.70, unit_rows: int = TEXT_UNIT_ROWS) -> DataFrame:
    """All pairs of texts whose distinct ``size``-character pieces have a Jaccard similarity of at least ``least``, of ``df``
    (``id`` long, unique; ``text``, distinct): ``id_1 < id_2``, ``similarity``.

    Pieces have one order for all texts, the rarest first (counted over all texts, in a table of fixed size).  Of a text with
    n pieces a pair must share at least ``least`` * n, so the first n - ceil(``least`` * n) + 1 pieces of both texts have one in
    common, and texts meet under each piece of this prefix: what all texts share comes last and hardly makes candidates.  The
    rows of a piece are cut into blocks of about ``unit_rows``, and each pair of blocks is a unit of bounded size.

    A pair may have (1 - ``least``) / (1 + ``least``) of both numbers of pieces not in common.  Candidates that differ in more
    parity bits, or whose numbers of pieces differ by more, have more of them and are dropped; the exact similarity decides on the
    others.  Pieces are 64-bit hashes; apart from hashes that collide no pair is missed.

    Nulls and texts shorter than a piece are in no pair.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    spark = df.sparkSession
    rows = df.where(F.length("text") >= size).select("id", "text")
    counts = rows.select("text").mapInArrow(_slot_counts(size), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # 65,536 rows at most
    seen = np.zeros(SLOTS, dtype=np.int64)
    seen[[r["slot"] for r in counts]] = [r["n"] for r in counts]
    columns = "key long, side int, id long, n int, " + ", ".join(f"w{k} long" for k in range(WORDS))
    units = rows.mapInArrow(_prefixes(size, least, unit_rows, spark.sparkContext.broadcast(seen)), columns).repartition("key").sortWithinPartitions("key")
    pairs = units.mapInArrow(_candidates(least), "id_1 long, id_2 long").distinct()
    return with_values(pairs, rows, "text").mapInArrow(_jaccard(size, least), "id_1 long, id_2 long, similarity double")
