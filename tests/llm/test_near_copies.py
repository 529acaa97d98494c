"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from viaflux.llm import kernels as K
from viaflux.llm import simhash
from viaflux.storage import Scratch

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain_set(t):
    w = (t or "").encode().translate(LOWER).split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def plain_firsts(rows):
    sets, label = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            label[b] = a
    return sum(find(i) == i for i in range(len(rows)))


def edited(words, n, rng):
    w = list(words)
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def firsts(spark, rows):
    docs = Scratch(spark).write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "docs")
    return {r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()}


def test_edited_copies(spark):
    rng = random.Random(5)
    rows, base = [], [f"w{rng.randrange(5000)}" for _ in range(300)]
    for n in (1, 2, 3, 4, 5):  # originals of their own, and copies with n edited words
        own = [f"v{rng.randrange(5000)}" for _ in range(300)]
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, edited(own, n, rng))]
    rows += [(100 + i, edited(base, rng.randrange(1, 4), rng)) for i in range(30)]
    rows += [(200 + i, edited(base, 60, rng)) for i in range(5)]
    rows += [(300, "a b"), (301, "A\tB"), (302, "a b c"), (303, ""), (304, None), (304, " ")]
    kept = firsts(spark, rows)
    assert len(kept) == plain_firsts(rows)
    assert all(len({2 * i, 2 * i + 1} & kept) == 1 for i in range(5))


def test_a_large_group_is_linked_through_others(spark):
    """Copies that are far from the first one, but near to others: linked after the first round."""
    rng = random.Random(8)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(60):
        if i % 12 == 0:
            base = edited(base, 4, rng).split()
        rows.append((i, edited(base, rng.randrange(3), rng)))
    assert len(firsts(spark, rows)) == plain_firsts(rows)


def test_recall(spark):
    """Of pairs at every similarity from 0.8 on nine in ten are found."""
    rng = random.Random(11)
    docs = []
    for i in range(400):
        own = [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 500))]
        docs += [" ".join(own), edited(own, max(1, int(len(own) * rng.uniform(0.001, 0.0225))), rng)]
    similar = [len(x & y) / len(x | y) for x, y in ((plain_set(docs[i]), plain_set(docs[i + 1])) for i in range(0, 800, 2))]
    rows = [t for i, x in enumerate(similar) if x >= 0.8 for t in docs[2 * i : 2 * i + 2]]
    lost = len(firsts(spark, list(enumerate(rows)))) - len(rows) // 2
    assert len(rows) > 500 and lost <= 0.1 * len(rows) / 2


def test_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(firsts(spark, rows)) == plain_firsts(rows)


def test_pairs_of_different_labels_once_each(spark):
    """Pairs that share several signatures come once, and none is lost."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    texts = [(i, edited(base, rng.randrange(2, 6), rng)) for i in range(40)]
    wide = Scratch(spark).write(simhash.wide_rows(spark.createDataFrame(texts, "id long, text string"), "id", "text"), "wide")
    sigs = simhash.wide_signatures(wide, range(simhash.SEGMENTS))
    about = wide.select("id", "n", F.col("n").alias("s"), F.col("id").alias("label"), "fp", simhash.weak_masks(F.col("weak")).alias("mask"))
    members = {}
    for r in sigs.collect():
        members.setdefault(r.sig, []).append(r.id)
    shared = [p for ids in members.values() for p in itertools.combinations(sorted(ids), 2)]
    got = [(r.a, r.b) for r in simhash.pairs_apart(sigs.join(about, "id")).collect()]
    assert len(got) == len(set(got)) and set(got) == set(shared) and len(shared) > 2 * len(got) > 40


def test_shingles_of_one_text_in_any_number_of_passes(spark):
    rng = random.Random(6)
    sets = {i: sorted({rng.randrange(-300, 300) * 10**15 for _ in range(rng.randrange(40))}) for i in range(30)}
    table = Scratch(spark).write(spark.createDataFrame(list(sets.items()), "id long, items array<long>"), "sets")
    every = [x for items in sets.values() for x in items]
    want = {i: n for i, items in sets.items() if (n := sum(every.count(x) == 1 for x in items))}
    for passes in (1, 4, 7):
        assert {r.id: r.q for r in simhash.own_shingles(table, Scratch(spark), passes).collect()} == want


def test_only_sets_that_may_be_similar_stay_on_disk(spark, monkeypatch):
    """Texts whose own shingles rule them out share signatures, but no pair reads their sets."""
    rng, read = random.Random(7), []
    base, pair = [f"w{i}" for i in range(300)], [f"v{i}" for i in range(300)]
    rows = [(i, edited(base, 20, rng)) for i in range(20)] + [(50, " ".join(pair)), (51, edited(pair, 1, rng))]
    plain = simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda pairs, sets: read.append({r.id for r in sets.collect()}) or plain(pairs, sets))
    assert len(firsts(spark, rows)) == plain_firsts(rows) == 21
    assert read and all(len(ids) == 2 for ids in read)


def test_signatures_of_the_same_texts_count_once(spark):
    texts = {1: [1, 2, 3], 2: [1, 2, 3], 3: [1, 2, 3], 4: [1, 2], 5: [1, 2], 6: [3], 7: [2, 3]}
    signed = spark.createDataFrame([(sig, i) for sig, ids in texts.items() for i in ids], "sig long, id long")
    got = sorted((r.sig, r.id, r.c) for r in simhash.shared_signatures(signed).collect())
    assert got == [(1, 1, 3), (1, 2, 3), (1, 3, 3), (4, 1, 2), (4, 2, 2), (7, 2, 2), (7, 3, 2)]


def test_texts_that_share_a_signature_by_chance_need_no_sets(spark, monkeypatch):
    """Texts that are half alike agree in a segment now and then, but are too far apart to be compared."""
    rng, made = random.Random(3), []
    base, pair = [f"w{i}" for i in range(400)], [f"v{i}" for i in range(300)]
    rows = [(i, " ".join(base[:270] + [f"x{rng.randrange(10**6)}" for _ in range(150)])) for i in range(30)] + [(50, " ".join(pair)), (51, edited(pair, 1, rng))]
    wide = Scratch(spark).write(simhash.wide_rows(spark.createDataFrame(rows, "id long, text string"), "id", "text"), "wide")
    chance = {r.id for r in simhash.shared_signatures(simhash.wide_signatures(wide, range(simhash.SEGMENTS))).where("c = 2").collect()} - {50, 51}
    plain = simhash.shingle_sets
    monkeypatch.setattr(simhash, "shingle_sets", lambda docs: made.append({r.id for r in docs.collect()}) or plain(docs))
    assert len(firsts(spark, rows)) == plain_firsts(rows) == 31
    assert len(chance) > 4 and len(made[0]) == 2


def test_empty(spark):
    assert not firsts(spark, [])


def test_wide_fingerprint_is_the_majority():
    items = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 600).astype(np.uint64))
    fp, weak = simhash.wide_fingerprint(items)
    lanes = [[int(K.mix(np.array([x ^ K.U64(0x6A09E667F3BCC909 * (2 * i + 1) & (1 << 64) - 1)]))[0]) for x in items] for i in range(18)]
    votes = [2 * sum(h >> (8 * (b // 8) + 7 - b % 8) & 1 for h in lane) - len(items) for lane in lanes for b in range(64)]
    assert [int(fp[i // 48]) >> i % 48 & 1 for i in range(1152)] == [v > 0 for v in votes]
    for s in range(48):
        six = sorted(range(24), key=lambda b: (abs(votes[24 * s + b]), b))[:6]
        assert [int(weak[s // 2]) >> (30 * (s % 2) + 5 * j) & 31 for j in range(6)] == six
