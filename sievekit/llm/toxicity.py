"""Abusive, hateful or sexually explicit language: non-negative positive-unlabelled learning.

A document counts as toxic for one passage, so the classifier judges passages: windows of a few words within a
sentence.  Positive are the passages of confirmed toxic documents that look worst (chosen anew in each round of fitting),
unlabelled are the passages of all documents, rated or not; a linear model is fitted with the
class-prior-corrected, non-negative risk of Kiryo et al. (2017).  The class prior is estimated from how scores of
positive and unlabelled passages are distributed, the threshold from how those of documents are, scored by models that
didn't see them: no rating of "ok" is needed for either.  A document's score is that of its worst passage.

Every document takes part in all of this.  The passages are written to the shared folder once, in blocks; tasks go through them block by
block in constant memory and give gradients and counts, which are added up in one order, so that nothing grows with the input but the time.
"""

from __future__ import annotations

import copy
import hashlib
import html
import pickle
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions.ctph import mix
from sievekit.functions.spelling import plain_name
from sievekit.session import file_system, shared_folder, spread

FEW = 40  # agreed toxic documents below which singly rated ones help to set the threshold
SLOTS = 1 << 18
WINDOW, STEP = 8, 4
EPOCHS = (1, 4)  # of each round
PARTS = 16  # steps of an epoch: each takes the documents of one part, by hash of the text
RATE, DECAY = 1.0, 1e-7  # a part is a large batch, so steps are few and long
WEIGHT = 0.05  # of positives in the risk, in place of their prior: they are too rare to be learnt otherwise
FOLDS = 4
BLOCK_CHARS = 1_000_000  # of the texts of a block, unless its last one is longer
TASKS = 16  # at most, that share the blocks of a step: each gives the driver up to 8 MB
GRID = 1024  # scores are counted in steps of 1 / GRID
NEVER = -(1 << 40)  # on that grid: a document without passages

# Letters of other scripts that look like Latin ones, and signs used in place of letters.
_LOOKALIKES = str.maketrans(dict(zip("авекмнорстухіјѕԁһԛԝӏοαενρτυικ", "abekmhopctyxijsdhqwloaevptuik", strict=True)))
_SIGNS = str.maketrans("013457@$!|€", "oieastasiie")
_INLINE = re.compile(r"</?(?:i|b|u|s|em|strong|wbr|span|font|small|tt)\b[^<>]{0,200}>|\[/?(?:i|b|u|s|size|color|font)(?:=[^\[\]]{0,80})?\]", re.I)
_BREAKS = re.compile(r"<[^<>]{0,300}>|\[/?(?:quote|url|img|code|list)\b[^\[\]]{0,300}\]|https?://\S+", re.I)
_SENTENCE = re.compile(r"[.?。！？;；\n]+|!+(?=\s|$)")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ ._-]){2,}[^\W\d_](?![^\W_])")
_WORD = re.compile(r"[㐀-鿿぀-ヿ]|[^\W_](?:[\w@$#*!|€']*[\w@$#*€])?|[@$*#](?=[@$*#!|€]*[^\W_])[\w@$#*!|€]+")
_REPEATED = re.compile(r"(.)\1{2,}")
_MASK = re.compile(r"(?<=\w)[*#@$_]+(?=\w)|(?<=\w)[*#]{2,}")
_UNSEEN = regex.compile(r"[\p{Cf}\p{Mn}]+")
_LETTER = re.compile(r"[^\W\d_]")
_WORDS_KEPT = 200_000  # words whose features are remembered


def clean(text: str) -> str:
    """``text`` without markup and with common disguises undone, in lower case."""
    t = html.unescape(_INLINE.sub("", text))
    t = _BREAKS.sub("\n", _INLINE.sub("", t))
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
        t = _UNSEEN.sub("", unicodedata.normalize("NFD", t.lower())).translate(_LOOKALIKES)
    return _SPACED.sub(lambda m: re.sub(r"[ ._-]", "", m[0]), t.lower())


def plain_word(w: str) -> str:
    """A word with repeated letters, signs for letters and masks in one form; all numbers are alike."""
    w = _REPEATED.sub(r"\1", w)
    if w.isdigit():
        return "0"
    return w if w.isalpha() or not _LETTER.search(w) else _MASK.sub("*", w.translate(_SIGNS))


def _hash(name: str) -> int:
    """The same in every process."""
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers of the ranges that begin at ``starts`` and have ``counts`` members, in a row."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - starts, counts)


class Words:
    """Numbers of words and, by number, their hashes and their features' slots: the word itself, its letters with the inner ones in
    order, and its four-character pieces."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.hashes, self.slots, self.counts = [], [], []

    def number(self, raw: str) -> int:
        w = plain_word(raw)
        names = [w]
        if len(w) > 3:
            names.append("~" + w[0] + "".join(sorted(w[1:-1])) + w[-1])
            b = f"<{w}>"
            names += ["#" + b[i : i + 4] for i in range(len(b) - 3)]
        if "*" in w:
            names.append("*")
        hashes = [_hash(n) for n in names]
        k = self.numbers[raw] = len(self.hashes)
        self.hashes.append(hashes[0])
        self.slots += [h % SLOTS for h in hashes]
        self.counts.append(len(hashes))
        return k


class Passages:
    """Passages of many texts, whole: windows of words within a sentence, none of None or a text without words."""

    def __init__(self, texts: Iterable[str | None], words: Words | None = None) -> None:
        words = words if words is not None else Words()
        numbers, number, tokens, lengths, docs = words.numbers, words.number, [], [], []
        for i, text in enumerate(texts):
            for s in _SENTENCE.split(clean(text)) if text else ():
                found = [numbers[w] if w in numbers else number(w) for w in _WORD.findall(s)]
                if found:
                    tokens += found
                    lengths.append(len(found))
                    docs.append(i)
        self._place(*(np.array(x, dtype=np.int64) for x in (tokens, lengths, docs)), np.array(words.hashes, dtype=np.uint64), *(np.array(x, dtype=np.int64) for x in (words.slots, words.counts)))

    def _place(self, token: np.ndarray, n: np.ndarray, docs: np.ndarray, hashes: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> None:
        """From the words, the lengths and documents of sentences, and the hashes, slots and numbers of slots of distinct words."""
        self.token, self.lengths, self.docs = token, n, docs
        offset = np.cumsum(n) - n
        windows = np.where(n <= WINDOW, 1, -(-(n - STEP) // STEP))
        sentence = np.repeat(np.arange(len(n)), windows)
        k = np.arange(len(sentence)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.low = offset[sentence] + STEP * k
        self.high = np.minimum(self.low + WINDOW, (offset + n)[sentence])
        self.doc = docs[sentence]
        self.hashes, self.word_slots, self.word_counts = hashes, slots, counts
        self._chains = None
        size = self.high - self.low
        self.sizes = np.diff(np.concatenate([[0], np.cumsum(self.word_counts[self.token])])[[self.low, self.high]], axis=0)[0] + size - 1 + np.maximum(size - 2, 0) if len(self.low) else np.zeros(0, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.doc)

    def pack(self) -> list[np.ndarray]:
        """All there is to know, with the words that occur only, in the smallest types; ``unpacked`` makes the same of it."""
        used, token = np.unique(self.token, return_inverse=True)
        counts = self.word_counts[used]
        first = np.cumsum(self.word_counts) - self.word_counts
        parts = (token, self.lengths, self.docs, self.word_slots[_ranges(first[used], counts)], counts)
        return [self.hashes[used], *(x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in parts)]

    @classmethod
    def unpacked(cls, parts: list[np.ndarray]) -> Passages:
        out = cls.__new__(cls)
        token, lengths, docs, slots, counts = (x.astype(np.int64) for x in parts[1:])
        out._place(token, lengths, docs, parts[0], slots, counts)
        return out

    def pick(self, rows: np.ndarray) -> Passages:
        """Those passages alone."""
        out = copy.copy(self)
        out.low, out.high, out.doc, out.sizes = self.low[rows], self.high[rows], self.doc[rows], self.sizes[rows]
        return out

    def by_document(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents and their distinct slots."""
        of, sentence = np.repeat(self.docs, self.lengths), np.repeat(np.arange(len(self.lengths)), self.lengths)
        doc, word = np.divmod(np.unique(of * len(self.hashes) + self.token), max(1, len(self.hashes)))
        first, n = np.cumsum(self.word_counts) - self.word_counts, self.word_counts[word]
        pairs = [np.repeat(doc, n) * SLOTS + self.word_slots[_ranges(first[word], n)]]
        for k, slots in enumerate(self.chains(), 1):
            same = sentence[:-k] == sentence[k:]
            pairs.append((of[:-k] * SLOTS)[same] + slots[same])
        return np.divmod(np.unique(np.concatenate(pairs)), SLOTS)

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the pair and of the triple of words that begin at each word."""
        if self._chains is None:
            h = self.hashes[self.token] if len(self.token) else np.zeros(0, dtype=np.uint64)
            two = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
            three = mix(two[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:])
            self._chains = (two % np.uint64(SLOTS)).astype(np.int64), (three % np.uint64(SLOTS)).astype(np.int64)
        return self._chains

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """A passage's score is a sum over its words, pairs and triples, so all are differences of running sums."""
        if not len(self):
            return np.zeros(0)
        ends = np.cumsum(self.word_counts)
        of_word = np.diff(np.concatenate([[0.0], np.cumsum(weights[self.word_slots], dtype=np.float64)])[np.concatenate([[0], ends])])
        two, three = self.chains()
        total = np.zeros(len(self))
        for values, shorter in ((of_word[self.token], 0), (weights[two], 1), (weights[three], 2)):
            sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
            low = np.minimum(self.low, len(values))
            total += sums[np.maximum(self.high - shorter, low)] - sums[low]
        return total / np.sqrt(self.sizes) + bias

    def gradient(self, g: np.ndarray) -> np.ndarray:
        """By slot, the sum of ``g`` over the passages: what ``scores`` does, turned round, again with running sums."""
        out, n = np.zeros(SLOTS), len(self.token)
        if not len(self):
            return out
        g = g / np.sqrt(self.sizes)
        for slots, shorter in zip((None, *self.chains()), range(3)):
            m = max(0, n - shorter)
            low = np.minimum(self.low, m)
            high = np.maximum(self.high - shorter, low)
            of = np.cumsum(np.bincount(low, g, m + 1) - np.bincount(high, g, m + 1))[:m]
            if slots is None:
                of = np.repeat(np.bincount(self.token, of, len(self.hashes)), self.word_counts)
            out += np.bincount(self.word_slots if slots is None else slots, of, SLOTS)
        return out


class Rows:
    """The slots of all passages, row by row, to fit on; put together in parts, so that it takes little more memory than they do."""

    def __init__(self, data: Passages, part: int = 20_000) -> None:
        first = np.cumsum(data.word_counts) - data.word_counts
        two, three = (x.astype(np.int32) for x in data.chains())
        of_word = data.word_slots.astype(np.int32)
        self.doc = data.doc
        self.starts = np.concatenate([[0], np.cumsum(data.sizes)])
        self.slots = np.empty(int(self.starts[-1]), dtype=np.int32)
        for begin in range(0, len(data), part):
            low, high = data.low[begin : begin + part], data.high[begin : begin + part]
            row, at = np.repeat(np.arange(len(low)), high - low), _ranges(low, high - low)
            n = data.word_counts[data.token[at]]
            last = high[row] - at
            slots = np.concatenate([of_word[_ranges(first[data.token[at]], n)], two[at[last > 1]], three[at[last > 2]]])
            owner = np.concatenate([np.repeat(row, n), row[last > 1], row[last > 2]])
            self.slots[self.starts[begin] : self.starts[begin] + len(slots)] = slots[np.argsort(owner, kind="stable")]

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of those rows, and which of them each belongs to."""
        n = self.starts[rows + 1] - self.starts[rows]
        return self.slots[_ranges(self.starts[rows], n)], np.repeat(np.arange(len(rows)), n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tally:
    """How often each value occurs, however many there are; ``values`` are sorted."""

    def __init__(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.values, at = np.unique(values, return_inverse=True)
        self.counts = np.bincount(at, counts, len(self.values)).astype(np.int64)
        self.ends = np.cumsum(self.counts)

    @classmethod
    def of(cls, values: np.ndarray | Tally) -> Tally:
        return values if isinstance(values, Tally) else cls(values, np.ones(len(values), dtype=np.int64))

    @classmethod
    def sum(cls, parts: Iterable[Tally]) -> Tally:
        parts = list(parts)
        return cls(np.concatenate([p.values for p in parts]), np.concatenate([p.counts for p in parts])) if parts else cls(np.zeros(0), np.zeros(0))

    def __len__(self) -> int:
        return int(self.counts.sum())

    def above(self, cuts: np.ndarray) -> np.ndarray:
        """Shares of what isn't below the cuts."""
        return 1 - np.concatenate([[0], self.ends])[np.searchsorted(self.values, cuts)] / len(self)

    def quantile(self, q: np.ndarray | float) -> np.ndarray:
        """As ``np.quantile`` of all values."""
        place = np.asarray(q) * (len(self) - 1)
        low = np.floor(place)
        a, b = (self.values[np.minimum(np.searchsorted(self.ends, x, side="right"), len(self.values) - 1)] for x in (low, low + 1))
        return a + (b - a) * (place - low)

    def where(self, kept: np.ndarray) -> Tally:
        return Tally(self.values[kept], self.counts[kept])

    def mapped(self, f: Callable[[np.ndarray], np.ndarray]) -> Tally:
        return Tally(f(self.values), self.counts)


def class_prior(positive: np.ndarray | Tally, unlabelled: np.ndarray | Tally, least: float = 0.5, most: float = 0.95) -> float:
    """Share of positives among the unlabelled scores: the least ratio of the shares above a threshold, over thresholds that
    ``least`` to ``most`` of the positives reach.  What isn't positive can only raise that ratio."""
    if not len(positive) or not len(unlabelled):
        return 0.0
    positive, unlabelled = Tally.of(positive), Tally.of(unlabelled)
    cuts = positive.quantile(np.linspace(1 - most, 1 - least, 50))
    return float(min(1.0, (unlabelled.above(cuts) / np.maximum(positive.above(cuts), 1e-9)).min()))


class ToxicityModel:
    """``weights`` of slots, ``bias``, and the ``threshold`` from which a document counts as toxic."""

    def __init__(self, weights: np.ndarray, bias: float, threshold: float, prior: float | None = None, held_out_f1: float | None = None) -> None:
        self.weights, self.bias, self.threshold, self.prior, self.held_out_f1 = weights.astype(np.float32), bias, threshold, prior, held_out_f1
        self.words = Words()

    def score_texts(self, texts: list[str | None]) -> np.ndarray:
        """Score 0 to 1 of each text's worst passage; 0 for None and texts without words."""
        if len(self.words.numbers) > _WORDS_KEPT:
            self.words = Words()
        data, out = Passages(texts, self.words), np.zeros(len(texts))
        if len(data):
            np.maximum.at(out, data.doc, _sigmoid(data.scores(self.weights, self.bias)))
        return out


EMPTY = (np.zeros(SLOTS, dtype=np.float32), -5.0, 0.5)


def _worst(doc: np.ndarray, z: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The highest passage of each of the documents."""
    rows = np.flatnonzero(np.isin(doc, docs))
    order = rows[np.lexsort((-z[rows], doc[rows]))]
    first = np.ones(len(order), dtype=bool)
    first[1:] = doc[order][1:] != doc[order][:-1]
    return order[first]


def best_threshold(positive: np.ndarray | Tally, unlabelled: np.ndarray | Tally, slack: float = 0.005) -> tuple[float, float, float | None]:
    """From held-out scores of toxic and of unlabelled documents: the middle of the thresholds whose F1 over all documents is within
    ``slack`` of the greatest, the share of toxic documents, and that F1.

    With the share p, a threshold that t of the toxic documents and u of all reach has precision p t / u and recall t, so F1 2 p t / (u + p).
    """
    if not len(positive) or not len(unlabelled):
        return 0.5, 0.0, None
    positive, unlabelled = Tally.of(positive), Tally.of(unlabelled)
    prior = class_prior(positive, unlabelled)
    if prior <= 0:
        return float(positive.quantile(0.5)) / 2, 0.0, None
    cuts = np.unique(np.concatenate([[0.0], positive.values, unlabelled.values]))
    f1 = 2 * prior * positive.above(cuts) / (unlabelled.above(cuts) + prior)
    good = np.flatnonzero(f1 >= f1.max() - slack)
    return float((cuts[max(0, good[0] - 1)] + cuts[good[-1]]) / 2), prior, float(min(1.0, f1.max()))  # from the next lower score on all is alike


def _fold(text: str | None) -> int:
    """Copies of a text stay together."""
    return _hash(text or "") % FOLDS


class Stored:
    """Rows of a ``part`` and pickled ``data``, written once to the shared folder and read one by one where they lie."""

    def __init__(self, df: DataFrame) -> None:
        from pyarrow import fs

        self.spark = df.sparkSession
        self.folder = shared_folder(self.spark)
        df.write.partitionBy("part").parquet(self.folder)
        system, path = file_system(self.folder)
        names = sorted(i.path[len(path) + 1 :] for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.path.endswith(".parquet"))
        self.files: dict[int, list[str]] = {}
        for name in names:
            if name.startswith("part="):
                self.files.setdefault(int(name.split("/")[0][5:]), []).append(f"{self.folder}/{name}")

    def of(self, part: int) -> list[str]:
        return self.files.get(part, [])

    def all(self) -> list[str]:
        return [f for p in sorted(self.files) for f in self.files[p]]


def _read(files: Iterable[str]) -> Iterator:
    from pyarrow import parquet

    for file in files:
        system, path = file_system(file)
        with system.open_input_file(path) as f:
            for b in parquet.ParquetFile(f).iter_batches(1, columns=["data"]):
                yield pickle.loads(b.column(0)[0].as_py())


def _put(file: str, x) -> str:
    system, path = file_system(file)
    with system.open_output_stream(path) as f:
        f.write(pickle.dumps(x))
    return file


def _get(file: str):
    system, path = file_system(file)
    with system.open_input_file(path) as f:
        return pickle.loads(f.read())


def _shares(spark, files: list[str], more: list[str]) -> int:
    return max(1, min(max(len(files), len(more)), spark.sparkContext.defaultParallelism, TASKS))


def _totals(spark, work: Callable, state, files: list[str], more: Iterable[str] = ()) -> Iterator:
    """What ``work(state, blocks, more)`` yields where tasks share the files of either kind, one of fixed size a task, in the order of the
    tasks: so sums of them come out the same in each run.  State and sums are files, gone afterwards: they would crowd the driver's JVM."""
    more, folder = list(more), shared_folder(spark)
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    n, given = _shares(spark, files, more), _put(f"{folder}/given", (state, files, more))

    def run(k):
        state, files, more = _get(given)
        for _, out in work(state, _read(files[k::n]), _read(more[k::n])):
            yield _put(f"{folder}/{uuid.uuid4().hex}", out)

    for name in spark.sparkContext.parallelize(range(n), n).flatMap(run).collect():
        yield _get(name)
    system.delete_dir(path)


def _rows(spark, work: Callable, state, files: list[str]) -> Stored:
    """What ``work(state, blocks, ())`` yields, as a table."""
    n = _shares(spark, files, [])
    shared = spark.sparkContext.broadcast((state, files))

    def run(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                state, files = shared.value
                for part, out in work(state, _read(files[k::n]), ()):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(out)], pa.binary())], ["part", "data"])

    out = Stored(spark.range(0, n, 1, n).mapInArrow(run, "part int, data binary"))
    shared.destroy()
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """``part`` and ``data``: passages, folds and flags (toxic, sure, sampled) of some documents."""

    def packed(words, held):
        texts, *flags = zip(*held)
        return Passages(texts, words).pack(), np.array([_fold(t) for t in texts], dtype=np.int8), *(np.array(x, dtype=bool) for x in flags)

    def run(batches):
        words, held, chars, part = Words(), [], 0, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(packed(words, held))], pa.binary())], ["part", "data"])

        for b in batches:
            for low in range(0, b.num_rows, 500):
                for p, *row in zip(*(b.slice(low, 500).column(c).to_pylist() for c in ("part", "text", "toxic", "sure", "sampled"))):
                    if held and (p != part or chars >= BLOCK_CHARS):
                        yield out()
                        held, chars = [], 0
                        if len(words.numbers) > _WORDS_KEPT:
                            words = Words()
                    part = p
                    held.append(row)
                    chars += len(row[0])
        if held:
            yield out()

    h = F.xxhash64("text", F.lit(8))
    some = rows.where(F.col("text").isNotNull()).select(F.pmod(h, F.lit(PARTS)).cast("int").alias("part"), "text", "toxic", "sure", "sampled")
    return some.sortWithinPartitions("part", h, "toxic", "sure", "sampled").mapInArrow(run, "part int, data binary")


def _sparse(x: np.ndarray) -> tuple[np.ndarray | slice, np.ndarray]:
    """Where ``x`` isn't 0, and what it is there; all of it if that is shorter."""
    some = np.flatnonzero(x)
    return (some.astype(np.int32), x[some].astype(np.float32)) if 2 * len(some) < len(x) else (slice(None), x.astype(np.float32))


def _document_counts(state, blocks, more):
    """By fold, numbers of toxic and of unlabelled documents, and how many of them have each slot."""
    n, have = np.zeros((FOLDS, 2), dtype=np.int64), np.zeros((FOLDS, 2, SLOTS))
    for parts, fold, toxic, sure, sampled in blocks:
        doc, slot = Passages.unpacked(parts).by_document()
        for k in range(FOLDS):
            for j, kind in enumerate((toxic, sampled)):
                mine = kind & (fold == k)
                n[k, j] += mine.sum()
                have[k, j] += np.bincount(slot[mine[doc]], minlength=SLOTS)
    yield 0, (n, have.astype(np.min_scalar_type(int(have.max()))))


def _choose(state, blocks, more):
    """Rows of part 0: of each fit the worst passage of each toxic document, as its score on the grid, whether it is sure, and its slots.
    One of part 1: tallies of the scores of chosen passages that are sure and that aren't, and of unlabelled passages, by fit."""
    weights, bias = state
    tallies = [[[] for _ in range(3)] for _ in weights]
    for parts, fold, toxic, sure, sampled in blocks:
        data = Passages.unpacked(parts)
        for k in range(len(weights)):
            z = np.floor(data.scores(weights[k], bias[k]) * GRID).astype(np.int64)
            worst = _worst(data.doc, z, np.flatnonzero(toxic & (fold != k)))
            certain = sure[data.doc[worst]]
            if len(worst):
                rows = Rows(data.pick(worst))
                yield 0, (k, z[worst], certain, rows.slots, rows.starts)
            for j, x in enumerate((z[worst[certain]], z[worst[~certain]], z[(sampled & (fold != k))[data.doc]])):
                tallies[k][j] = [Tally.sum([*tallies[k][j], Tally.of(x)])]
    yield 1, [[Tally.sum(x) for x in of] for of in tallies]


def _step(state, blocks, more):
    """By fit, of unlabelled passages (``blocks``) and of positive ones (``more``): their number, the sums of l(-) and of scores, and by slot
    the sums of scores and, of positive ones, of 1."""
    weights, bias, cuts = state
    numbers, sums = np.zeros((len(weights), 2, 3)), {}

    def add(key, x):
        sums[key] = sums[key] + x if key in sums else x

    def count(k, j, s):
        numbers[k, j] += len(s), -np.log(np.maximum(1 - s, 1e-12)).sum(), s.sum()

    for parts, fold, _, _, sampled in blocks:
        data = Passages.unpacked(parts)
        for k in range(len(weights)):
            if cuts[k] is not None:
                mine = (sampled & (fold != k))[data.doc]
                s = _sigmoid(data.scores(weights[k], bias[k]))
                count(k, 0, s[mine])
                add((k, "u"), data.gradient(np.where(mine, s, 0.0)))
    for k, z, certain, slots, starts in more:
        if cuts[k] is not None:
            n = np.diff(starts)
            s = _sigmoid(np.add.reduceat(weights[k][slots].astype(np.float64), starts[:-1]) / np.sqrt(n) + bias[k])
            mine = certain | (z > cuts[k])
            count(k, 1, s[mine])
            for key, x in (("p", np.where(mine, s, 0.0)), ("1", mine)):
                add((k, key), np.bincount(slots, np.repeat(x / np.sqrt(n), n), SLOTS))
    yield 0, (numbers, {key: _sparse(x) for key, x in sums.items()})


def fit_nnpu(blocks: Stored, chosen: Stored, cuts: list[float | None], priors: list[float], epochs: int, weight: float = WEIGHT) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of each fit that minimise the non-negative PU risk with the logistic loss: ``chosen`` rows against unlabelled ones.

    Risk: weight * E_p[l(+)] + (1 - weight) / (1 - prior) * max(0, E_u[l(-)] - prior * E_p[l(-)]), as for classes out of balance (Su et
    al. 2021); where the second term falls below 0, its gradient is reversed.  Adagrad: a step for each part of the unlabelled
    documents against all positive rows above the cut; None as the cut: no fit.
    """
    fits = len(cuts)
    weights, bias = np.zeros((fits, SLOTS)), np.array([-5.0 if c is None else np.log(weight / (1 - weight)) for c in cuts])
    squares, bias_squares = np.full((fits, SLOTS), 1e-7), np.full(fits, 1e-7)
    for part in sorted(blocks.files) * epochs:
        numbers, grads = 0, {(k, key): np.zeros(SLOTS) for k in range(fits) for key in "up1"}
        for some, sums in _totals(blocks.spark, _step, (weights.astype(np.float32), bias, cuts), blocks.of(part), chosen.of(0)):
            numbers = numbers + some
            for key, (slots, x) in sums.items():
                grads[key][slots] += x
        for k in range(fits):
            (n_u, loss_u, s_u), (n_p, loss_p, s_p) = numbers[k]
            if not n_u or not n_p:
                continue
            forward = loss_u / n_u >= priors[k] * loss_p / n_p
            way = (1 if forward else -1) * (1 - weight) / (1 - priors[k])
            a, b, c = way / n_u, (weight * forward - way * priors[k]) / n_p, -weight * forward / n_p
            grad, g = a * grads[k, "u"] + b * grads[k, "p"] + c * grads[k, "1"], a * s_u + b * s_p + c * n_p
            some = np.flatnonzero(grad)
            step = grad[some] + DECAY * weights[k, some]
            squares[k, some] += step * step
            weights[k, some] -= RATE * step / np.sqrt(squares[k, some])
            bias_squares[k] += g**2
            bias[k] -= RATE * g / np.sqrt(bias_squares[k])
    return weights, bias


def _held_out(state, blocks, more):
    """Tallies of the scores of toxic documents that are sure and that aren't, and of unlabelled ones, each by the fit without its fold."""
    weights, bias = state
    tallies = [[], [], []]
    for parts, fold, toxic, sure, sampled in blocks:
        data = Passages.unpacked(parts)
        top = np.full(len(fold), NEVER)
        for k in range(FOLDS):
            mine = data.pick(np.flatnonzero(fold[data.doc] == k))
            np.maximum.at(top, mine.doc, np.floor(mine.scores(weights[k], bias[k]) * GRID).astype(np.int64))
        for j, x in enumerate((top[toxic & sure], top[toxic & ~sure], top[sampled])):
            tallies[j] = [Tally.sum([*tallies[j], Tally.of(x)])]
    yield 0, [Tally.sum(x) for x in tallies]


def fit_table(rows: DataFrame) -> ToxicityModel:
    """A model from ``text``, ``toxic`` (confirmed), ``sure`` (those of which several raters say so) and ``sampled`` (unlabelled) of all rows.

    One fit is on all, one for each fold without that fold, whose texts it scores; prior and threshold come from those scores.
    """
    blocks = Stored(_blocks(rows))
    spark, files = blocks.spark, blocks.all()
    n, have = 0, 0
    for some, with_slot in _totals(spark, _document_counts, None, files):
        n, have = n + some, have + with_slot.astype(np.int64)
    if not n[:, 0].sum():
        return ToxicityModel(*EMPTY)
    weights, bias = np.zeros((FOLDS + 1, SLOTS)), np.zeros(FOLDS + 1)
    for k in range(FOLDS + 1):  # at first, log odds of each slot between toxic and unlabelled documents; rare slots count little
        others = np.arange(FOLDS) != k
        (n1, n0), (with1, with0) = np.maximum(1, n[others].sum(axis=0)), have[others].sum(axis=0)
        odds = np.log((with1 + 0.3) / (n1 + 1)) - np.log((with0 + 0.3 * n0 / n1) / (n0 + 1))
        weights[k] = (odds * with1 / (with1 + 2)).clip(0)
    for turn, epochs in enumerate(EPOCHS):
        chosen = _rows(spark, _choose, (weights.astype(np.float32), bias), files)
        tallies = list(_read(chosen.of(1)))
        cuts, priors = [], []
        for k in range(FOLDS + 1):
            certain, other, unlabelled = (Tally.sum(x[k][j] for x in tallies) for j in range(3))
            positive, cut = Tally.sum([certain, other]), float(NEVER)
            if turn and len(positive) > 20:  # raters err: a document whose worst passage looks like any other doesn't teach what one is
                cut = float(positive.quantile(0.5) + unlabelled.quantile(0.5)) / 2
                positive = Tally.sum([certain, other.where(other.values > cut)])
            cuts.append(cut if len(positive) and len(unlabelled) else None)
            priors.append(min(0.3, max(class_prior(positive, unlabelled), 0.5 / max(1, len(unlabelled)))))
        weights, bias = fit_nnpu(blocks, chosen, cuts, priors, epochs)
    tallies = list(_totals(spark, _held_out, (weights.astype(np.float32), bias), files))
    certain, other, unlabelled = (Tally.sum(x[j] for x in tallies).mapped(lambda v: np.where(v == NEVER, 0.0, _sigmoid(v / GRID))) for j in range(3))
    threshold, prior, f1 = best_threshold(certain if len(certain) >= FEW else Tally.sum([certain, other]), unlabelled)
    return ToxicityModel(weights[FOLDS], float(bias[FOLDS]), threshold, prior, f1)


def fit(spark, texts: list[str | None], toxic: np.ndarray, sure: np.ndarray, sampled: np.ndarray) -> ToxicityModel:
    """A model from texts at hand, see ``fit_table``."""
    rows = [(t, *map(bool, flags)) for t, *flags in zip(texts, toxic, sure, sampled)]
    return fit_table(spark.createDataFrame(rows, "text string, toxic boolean, sure boolean, sampled boolean"))


def votes(labels: DataFrame) -> DataFrame:
    """``id``, ``bad`` and ``good`` ratings of the rated documents, repeated ratings counted once."""
    return (
        labels.where(F.col("verdict").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("id"), "rater", F.lower(F.trim("verdict")).alias("verdict"))
        .distinct()
        .groupBy("id")
        .agg(F.count_if(F.col("verdict").isin("abusive", "hateful", "sexual")).alias("bad"), F.count_if(F.col("verdict") == "ok").alias("good"))
    )


def _bounded(df: DataFrame, limit: int | None, chars: int | None) -> DataFrame:
    """Rows of ``df`` (``id``, ``text``) in the order of the ids' hashes, as many as both bounds allow; all where there is none."""
    if limit is None and chars is None:
        return df
    first = df.select("id", F.length("text").alias("n"), F.xxhash64("id", F.lit(8)).alias("h")).orderBy("h", "id")
    if limit is not None:
        first = first.limit(limit)
    so_far = F.sum("n").over(Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    taken = (first if chars is None else first.withColumn("so_far", so_far).where(F.col("so_far") <= chars)).select("id")
    kept = df.join(taken, "id", "left_semi")
    return kept if limit is None else kept.limit(limit)


def training_rows(documents: DataFrame, labels: DataFrame, rated: int | None = None, sample: int | None = None, chars: int | None = None) -> DataFrame:
    """``id``, ``text``, ``bad``, ``good``, ``sampled``: rated documents that have bad ratings only or mostly, and all documents.

    All of either, unless the caller states a bound: documents (``rated``, ``sample``) or characters of either.
    """
    texts = documents.select(F.col("doc_id").alias("id"), "text").where(F.col("text").isNotNull() & F.col("id").isNotNull())
    confirmed = votes(labels).where("bad > good")
    positive = _bounded(texts.join(confirmed, "id"), rated, chars).withColumn("sampled", F.lit(False))
    unlabelled = _bounded(texts, sample, chars).select("*", F.lit(0).cast("long").alias("bad"), F.lit(0).cast("long").alias("good"), F.lit(True).alias("sampled"))
    return positive.unionByName(unlabelled)


def train(spark, documents: DataFrame, labels: DataFrame, rated: int | None = None, sample: int | None = None) -> ToxicityModel:
    """Fits on all confirmed toxic documents (more bad than good ratings) and, as unlabelled ones, on all documents; on at most
    ``rated`` and ``sample`` of them if the caller says so.

    Null texts and null ratings take part in nothing; without confirmed documents nothing counts as toxic.
    """
    rows = training_rows(spread(documents.select("doc_id", "text")), labels, rated, sample)
    return fit_table(rows.select("text", F.expr("bad > good").alias("toxic"), F.expr("bad > 1 and good = 0").alias("sure"), "sampled"))


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id``, ``source`` (plain), ``score`` and ``is_toxic`` of every document, over its whole text.

    Null and empty texts score 0; repeated rows come out repeatedly; a null source stays null.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.threshold))  # of fixed size

    def run(batches):
        m = ToxicityModel(*shared.value)
        for b in batches:
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                s = m.score_texts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(s), pa.array(s >= m.threshold)], ["doc_id", "source", "score", "is_toxic"])

    return documents.select("doc_id", plain_name(F.col("source")).alias("source"), "text").mapInArrow(run, "doc_id long, source string, score double, is_toxic boolean")
