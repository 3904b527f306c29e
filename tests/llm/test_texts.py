import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.llm import mixing, packing, toxicity
from sievekit.llm.groups import linked_groups
from sievekit.llm.tokens import VOCABULARY, count_tokens, read_vocabulary, with_token_counts


def test_token_counts(spark):
    texts = ["hello world", "", None, "<|endoftext|> ist Text", "日本語 ü", "x" * 20_000]
    counts = count_tokens(texts, read_vocabulary())
    assert counts[:3] == [2, 0, 0] and counts[3] > 4 and counts[5] > 1000 and VOCABULARY
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, other string")
    got = {r.doc_id: r.n_tokens for r in with_token_counts(df).collect()}
    assert got == dict(enumerate(counts)) and with_token_counts(df).columns == ["doc_id", "other", "n_tokens"]


def slow_best_fit(sizes, capacity):
    room, out = [], []
    for size in sorted(sizes, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= size]
        if fits:
            room[min(fits)[1]] -= size
        else:
            room.append(capacity - size)
    return sorted(room)


@pytest.mark.parametrize("capacity", [1, 5, 16, 31, 100])
def test_best_fit_decreasing(capacity):
    r = random.Random(capacity)
    for _ in range(80):
        sizes = [r.randint(1, capacity) for _ in range(r.randint(0, 60))]
        bins = packing.best_fit_decreasing(sizes, capacity)
        used = [0] * (max(bins, default=-1) + 1)
        for s, b in zip(sizes, bins):
            used[b] += s
        assert sorted(capacity - u for u in used) == slow_best_fit(sizes, capacity)


@pytest.mark.parametrize("group", [30, 50_000])
def test_pack(spark, group):
    r = random.Random(group)
    items = [(i, r.choice([0, None, r.randint(1, 100), r.randint(1, 350)])) for i in range(300)] + [(7, 40), (7, 40), (None, 30)]
    df = spark.createDataFrame([(*x, 1) for x in items], "doc_id long, n long, id int")
    rows = packing.pack(df, "doc_id", "n", 100, group).collect()
    assert sorted((str(x.id), x.size) for x in rows if x.size == 0) == sorted((str(i), 0) for i, n in items if not n)
    total = {}
    for x in rows:
        total[x.container] = total.get(x.container, 0) + x.size
        assert (x.container is None) == (x.size == 0) and x.size <= 100
    assert all(v <= 100 for v in total.values())
    assert sum(x.size for x in rows) == sum(n or 0 for _, n in items)
    by = {}
    for x in rows:
        by.setdefault(x.id, []).append((x.piece, x.start, x.size))
    for i, n in items[:7]:
        if n:
            assert sorted(by[i]) == [(p, 100 * p, min(100, n - 100 * p)) for p in range(-(-n // 100))]
    full = sum(v for v in total.values()) / (100 * (len(total) - (None in total)))
    assert full > (0.8 if group == 30 else 0.95)


def test_pack_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, n long")
    assert packing.pack(none, "doc_id", "n").count() == 0


def mixture(spark, sizes, targets, **how):
    rows = [(k * 100_000 + i, s, n) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)]
    docs = spark.createDataFrame(rows + [(-1, None, 50)], "id long, source string, n long")
    return mixing.Mixture(docs, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), **how)


def test_mixture(spark):
    r = random.Random(1)
    sizes = {"big": [r.randint(1, 60) for _ in range(3000)], "small": [r.randint(1, 60) for _ in range(300)], "tiny": [10] * 20, "untargeted": [5] * 100}
    targets = [("big", 0.6, 1), ("small", 0.3, 5), ("tiny", 0.1, 2), ("absent", 0.0, 1)]
    m = mixture(spark, sizes, targets, block_tokens=100, bucket_docs=200, chunk_slots=64)
    total = sum(map(sum, sizes.values()))
    assert m.total == total
    report = {x.source: x for x in m.report().collect()}
    have = {s: sum(n) for s, n in sizes.items()}
    for s, w, repeats in targets[:3]:
        want = w * total
        standing = "once" if want <= have[s] else "repeated" if want <= repeats * have[s] else "short"
        assert report[s].standing == standing and report[s].available == have[s] and report[s].rounds <= repeats
        assert abs(report[s].used - min(want, repeats * have[s])) < 0.01 * total
    assert report["absent"].used == 0 and report["absent"].available == 0
    mix = m.mix().collect()
    times = {}
    for x in mix:
        times.setdefault((x.id, x.round), []).append((x.start, x.n))
        assert x.source in dict.fromkeys(["big", "small", "tiny"])
    assert max(k for _, k in times) < 5 and all(k < 2 for i, k in times if 200_000 <= i < 300_000)
    for (i, k), parts in times.items():  # the parts of a document follow each other; only the last of a source may be missing
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0
    whole = [sum(n for _, n in p) == list(sizes.values())[i // 100_000][i % 100_000] for (i, _), p in times.items()]
    assert whole.count(False) <= 3
    slots = {}
    for x in mix:
        slots[x.slot] = slots.get(x.slot, 0) + x.n
    assert sum(n != 100 for n in slots.values()) <= 3  # full but the last of a source
    assert sum(x.n for x in mix) == sum(report[s].used for s in report)
    assert {i for i, _ in times if i >= 100_000} == {k * 100_000 + i for k in (1, 2) for i in range(len(list(sizes.values())[k]))}  # repeated, so all


def test_blocks_are_laid_end_to_end(spark):
    m = mixture(spark, {"a": [7] * 500}, [("a", 1.0, 1)], block_tokens=50, bucket_docs=40)
    sums = [x.s for x in m.blocks().groupBy("block").agg(F.sum("n").alias("s")).orderBy("block").collect()]
    assert sums == [50] * 70
    slots = m.schedule().orderBy("slot").collect()
    assert [x.slot for x in slots] == list(range(70)) and sorted(x.block for x in slots) == list(range(70))


def test_schedule_is_even(spark):
    i = spark.range(4000).select("id", mixing.golden_point(F.col("id")).alias("u"))
    for low in (0, 1000, 3900):
        u = np.array([x.u for x in i.where((F.col("id") >= low) & (F.col("id") < low + 100)).collect()])
        assert abs((u < 0.3).mean() - 0.3) < 0.03
    exact = [(k * mixing.GOLDEN) % 1.0 for k in range(0, 4000, 100)]
    assert np.allclose([x.u for x in i.where("id % 100 = 0").orderBy("id").collect()], exact)


def test_mixture_of_nothing(spark):
    m = mixture(spark, {}, [("a", 1.0, 1)])
    assert m.mix().count() == 0 and m.report().collect()[0].standing in ("once", "short")
    assert mixture(spark, {"a": [5]}, []).report().count() == 0


def test_linked_groups(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 180)] + [(5, 9), (9, 5), (5, 5), (None, 5)] + [tuple(r.sample(range(1000, 1400), 2)) for _ in range(150)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {x.id: x for x in linked_groups(spark.createDataFrame(pairs, "id_1 long, id_2 long")).collect()}
    assert {i: x.group_id for i, x in got.items()} == {i: root(i) for i in parent}
    assert got[9].n_links == 1 and got[101].n_links == 2
    assert linked_groups(spark.createDataFrame([], "id_1 long, id_2 long")).count() == 0


TOXIC = ["you are a worthless moron and everybody hates you", "all of them are vermin and should be driven out", "i will find you and break your neck"]
FINE = ["the gasket fits when the pan is warm", "this stupid hinge is driving me mad", "we measured the coil after lunch", "thanks for the drawing of the lens", "my bloody thumb hurts", "look at page ten of the guide"]


def forum(seed, n):
    r = random.Random(seed)
    texts, toxic = [], []
    for _ in range(n):
        s = [r.choice(FINE) + " " + str(r.randrange(90)) for _ in range(r.randint(1, 6))]
        toxic.append(r.random() < 0.15)
        if toxic[-1]:
            s.insert(r.randrange(len(s) + 1), r.choice(TOXIC))
        texts.append(". ".join(s) + ".")
    return texts, np.array(toxic)


def test_nnpu_finds_toxic_passages(spark):
    texts, toxic = forum(1, 1800)
    rated = toxic & (np.arange(1800) < 900)
    r = np.random.default_rng(2)
    rated[:900] ^= r.random(900) < 0.03  # raters err
    m = toxicity.fit(spark, texts, rated, rated & toxic, np.ones(len(texts), dtype=bool))
    fresh, truth = forum(5, 600)
    found = m.score_texts(fresh) >= m.threshold
    assert (found & truth).sum() >= 0.95 * truth.sum() and (found & ~truth).sum() <= 0.05 * truth.sum() and m.held_out_f1 > 0.7 and abs(m.prior - toxic.mean()) < 0.05
    hidden = ["<b>YOU</b> are a w0rthless m​oron &amp; everybody hаtes you", "f i n d. i will find y[b][/b]ou and brrrreak your n.e.c.k", "long " + "the pan is warm. " * 3000 + TOXIC[1]]
    assert (m.score_texts(hidden) >= m.threshold).all()
    assert m.score_texts([None, "", "!!", "日本語"])[:3].tolist() == [0, 0, 0]


def test_without_toxic_examples(spark):
    docs = spark.createDataFrame([(1, "a b", " Some_Source "), (2, None, None), (2, None, None)], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, rater string, verdict string")
    rows = toxicity.score(docs, toxicity.train(spark, docs, none)).collect()
    assert sorted((r.doc_id, r.source, r.is_toxic) for r in rows if r.source) == [(1, "some-source", False)] and len(rows) == 3
    assert toxicity.score(docs.where("false"), toxicity.train(spark, docs.where("false"), none)).count() == 0


def test_ratings_count_once(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "r", "ok"), (1, "r", "ok"), (1, "s", "Abusive "), (2, "r", None), (3, "r", "ok"), (None, "r", "ok"), (4, None, "sexual")], "doc_id long, rater string, verdict string")
    assert {r.id: (r.bad, r.good) for r in toxicity.votes(labels).collect()} == {1: (1, 1), 3: (0, 1), 4: (1, 0)}
    rows = toxicity.training_rows(docs, labels).collect()
    assert sorted(r.id for r in rows if not r.sampled) == [4] and sorted(r.id for r in rows if r.sampled) == [1, 2, 4]
    many = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"))
    assert toxicity.training_rows(many, labels, sample=50).where("sampled").count() == 50
    assert toxicity.training_rows(many, labels, chars=105).where("sampled").count() == 10


def test_prior_and_threshold():
    r = np.random.default_rng(0)
    positive, rest = r.normal(3, 1, 2000), r.normal(0, 1, 9500)
    mixed = np.concatenate([r.normal(3, 1, 500), rest])
    assert abs(toxicity.class_prior(positive, mixed) - 0.05) < 0.015
    threshold, prior, f1 = toxicity.best_threshold(positive, mixed)
    cuts = np.linspace(0, 4, 81)
    exact = [2 * (mixed[:500] >= c).sum() / (500 + (mixed >= c).sum()) for c in cuts]
    assert max(exact) - exact[int(np.abs(cuts - threshold).argmin())] < 0.02 and abs(f1 - max(exact)) < 0.06
    assert toxicity.class_prior(np.zeros(0), mixed) == 0 and toxicity.best_threshold(positive, np.zeros(0))[0] == 0.5


@pytest.mark.parametrize("text,want", [("a &amp; b", "a & b"), ("n a k e d now", "naked now"), ("hаte", "hate"), ("w<wbr>o­rd", "word"), ("[quote=x]q[/quote]", "\nq\n"), ("é", "e")])
def test_clean(text, want):
    assert toxicity.clean(text) == want


def test_words_and_windows():
    assert [toxicity.plain_word(w) for w in ("v3rm1n", "sooooo", "42", "i***t")] == ["vermin", "so", "0", "i*t"]
    words = toxicity.Words()
    p = toxicity.Passages(["ab bc cd. de\nef", None, "", "*** !", " ".join(f"w{chr(97 + i % 26)}" for i in range(1000))], words)
    names = {k: w for w, k in words.numbers.items()}
    found = [(d, [names[t] for t in p.token[a:b]]) for d, a, b in zip(p.doc.tolist(), p.low, p.high)]
    assert found[:3] == [(0, ["ab", "bc", "cd"]), (0, ["de"]), (0, ["ef"])]
    long = found[3:]
    assert {d for d, _ in long} == {4} and all(len(w) <= toxicity.WINDOW for _, w in long) and [w[0] for _, w in long] == [f"w{chr(97 + i % 26)}" for i in range(0, 996, 4)]


def test_scores_are_those_of_the_rows():
    p = toxicity.Passages(["the pan is warm. no", "you are a worthless m*ron today and the pan fits, it does", "x"])
    rows, weights = toxicity.Rows(p), np.random.default_rng(1).normal(size=toxicity.SLOTS)
    slots, owner = rows.take(np.arange(len(p)))
    slow = np.bincount(owner, weights=weights[slots]) / np.sqrt(np.bincount(owner)) + 0.5
    assert np.allclose(p.scores(weights, 0.5), slow) and (np.bincount(owner) == p.sizes).all()


def test_all_documents_take_part_in_the_fit(spark):
    n = 25_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("pan "), F.col("id").cast("string"), F.lit("x")).alias("text"))
    labels = docs.select("doc_id", F.lit("r").alias("rater"), F.lit("abusive").alias("verdict"))
    rows = toxicity.training_rows(docs, labels)
    assert {r.sampled: r["count"] for r in rows.groupBy("sampled").count().collect()} == {False: n, True: n}
    flags = rows.select("text", (F.col("bad") > 0).alias("toxic"), F.lit(False).alias("sure"), "sampled")
    blocks = toxicity.Stored(toxicity._blocks(flags))
    totals = list(toxicity._totals(spark, toxicity._document_counts, None, blocks.all()))
    assert sum(x[0] for x in totals).sum(axis=0).tolist() == [n, n] and len(blocks.files) == toxicity.PARTS
    pan = toxicity._hash("pan") % toxicity.SLOTS
    assert sum(x[1].astype(int) for x in totals)[:, :, pan].sum(axis=0).tolist() == [n, n]


def test_packed_passages_and_gradients():
    words = toxicity.Words()
    toxicity.Passages(["not in the next texts"], words)
    p = toxicity.Passages(["the pan is warm. no", None, "you are a worthless m*ron today and the pan fits, it does. the pan", "x", "!"], words)
    for data in (p, toxicity.Passages.unpacked(p.pack()), p.pick(np.array([0, 2])), toxicity.Passages([])):
        rows = toxicity.Rows(data)
        slots, owner = rows.take(np.arange(len(data)))
        g, weights = np.random.default_rng(1).normal(size=len(data)), np.random.default_rng(2).normal(size=toxicity.SLOTS)
        slow = np.bincount(slots, (g / np.sqrt(data.sizes))[owner], toxicity.SLOTS) if len(slots) else np.zeros(toxicity.SLOTS)
        assert np.allclose(data.gradient(g), slow)
        assert np.allclose(data.scores(weights, 1.0), [weights[slots[owner == i]].sum() / np.sqrt((owner == i).sum()) + 1 for i in range(len(data))])
    rows = toxicity.Rows(p)
    slots, owner = rows.take(np.arange(len(p)))
    assert set(zip(*(x.tolist() for x in p.by_document()))) == set(zip(p.doc[owner].tolist(), slots.tolist()))


def test_tallies():
    x = np.random.default_rng(0).integers(-5, 50, 1000)
    t = toxicity.Tally.sum([toxicity.Tally.of(x[:300]), toxicity.Tally.of(x[300:])])
    q = np.linspace(0, 1, 77)
    assert len(t) == 1000 and np.allclose(t.quantile(q), np.quantile(x, q)) and np.allclose(t.above(q * 60), [(x >= c).mean() for c in q * 60])
    assert len(t.where(t.values > 7)) == (x > 7).sum() and len(toxicity.Tally.sum([])) == 0
