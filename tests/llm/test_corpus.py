"""Operators over the whole corpus (3, 5, 7, 9) and the pipeline, against plain versions."""

import collections
import hashlib
import math
import random
import zlib

import pytest
import xxhash

import corpus_pipeline as pipeline
from viaflux.llm import katz, simhash, substring_dedup, suffix_dedup
from viaflux.llm import sentencepiece_scan as S
from viaflux.storage import Scratch

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, thash string, tid long, k string, copies long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "b", 2) for i, t in rows], SCHEMA)


def strings(rows):
    return sorted(map(str, rows))


# --- 3


def is_held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def plain_discount(counter):
    n = [0] + [sum(v == r for v in counter.values()) for r in range(1, 7)]
    points = [(math.log(r), math.log(n[r])) for r in range(1, 7) if n[r]]
    mx, my = (sum(p[i] for p in points) / max(len(points), 1) for i in (0, 1))
    slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points) if len(points) > 1 else -2.0
    slope = min(slope, -1.1)

    def left(r):
        turing = (r + 1) * n[r + 1] / n[r] if r <= 5 and n[r] else 0
        return turing if 0 < turing < r else r * (1 + 1 / r) ** (slope + 1)

    return left


def plain_katz(rows, order):
    """Recursive Katz over tuples of words."""
    grams, texts = [collections.Counter() for _ in range(order + 1)], []
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split() + [None]
        texts.append((i, is_held_out(i), w))
        if not is_held_out(i):
            padded = ["<s>"] * (order - 1) + w
            for k in range(1, order + 1):
                grams[k].update(tuple(padded[x - k + 1 : x + 1]) for x in range(order - 1, len(padded)))
    words, left = grams[1], [None] + [plain_discount(g) for g in grams[1:]]
    total, types = sum(words.values()), len(words)
    after = collections.defaultdict(list)
    for k in range(1, order + 1):
        for g in grams[k]:
            after[g[:-1]].append(g[-1])
    past = {h: sum(grams[len(h) + 1][(*h, w)] for w in ws) for h, ws in after.items()}
    memo = {}

    def alpha(h):
        if h not in memo:
            k = len(h) + 1
            kept = 1 - sum(left[k](grams[k][(*h, w)]) for w in after[h]) / past[h]
            memo[h] = kept / (1 - sum(p(h[1:], w) for w in after[h]) if h else 1)
        return memo[h]

    def p(h, w):
        c = grams[len(h) + 1].get((*h, w), 0)
        if c:
            return left[len(h) + 1](c) / past[h]
        if not h:
            return alpha(()) if total else 1.0
        return (alpha(h) if h in past else 1.0) * p(h[1:], w)

    for h in past:  # the probabilities of a history sum to one, unknown words being one more
        assert sum(p(h, (w,)[0]) for (w,) in words) + p(h, "never seen") == pytest.approx(1)
    out = []
    for i, held, w in texts:
        base = sum(math.log10((words[(x,)] + 0.1) / (total + 0.1 * (types + 1))) for x in w)
        padded = ["<s>"] * (order - 1) + w
        score = sum(math.log10(p(tuple(padded[x - order + 1 : x]), padded[x])) for x in range(order - 1, len(padded)))
        out.append((i, held, len(w), sum(words[(x,)] > 0 for x in w), total, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("rows", [
    [(1, "a b A\n c"), (2, None), (2, None), (10, ""), (None, "q a b"), (37, "zz yy\u00a0x")] + [(i, "a b c d " * (i % 5) + "e f " * (i % 3)) for i in range(40)],
    [(None, "a b"), (None, None)],
])
def test_katz(spark, rows, order):
    got = sorted(katz.scores(frame(spark, rows), order=order, chunk=200, buckets=5).collect(), key=lambda r: str(tuple(r)[:4]))
    want = sorted(plain_katz(rows, order), key=lambda r: str(r[:4]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5] and g.base_score == pytest.approx(w[5]) and g.score == pytest.approx(w[6])


def test_katz_ids_of_any_type_and_long_texts(spark):
    """The id as text decides what is held out; a text over a block; production buckets."""
    import decimal

    rows = [(decimal.Decimal(i), f"a b c{i % 7} " * (60_000 if i == 3 else 3)) for i in range(30)]
    got = {r.doc_id: r for r in katz.scores(spark.createDataFrame(rows, "doc_id decimal(10,2), text string")).collect()}
    want = {i: w for i, *w in plain_katz([(f"{i}.00", t) for i, t in rows], 2)}
    for i, _ in rows:
        assert got[i].held_out == want[f"{i}.00"][0] and got[i].score == pytest.approx(want[f"{i}.00"][5])


def test_katz_empty(spark):
    assert katz.scores(frame(spark, [])).count() == 0


# --- 5 and 7


def plain_windows(tokens, k):
    seen = collections.Counter()
    window = lambda t, s: t[s : s + k] if isinstance(t, bytes) else b" ".join(t[s : s + k])
    for t in tokens:
        seen.update(window(t, s) for s in range(len(t) - k + 1))
    out = []
    for t in tokens:
        gone, last = [False] * len(t), -1
        for s in range(len(t) - k + 1):
            if seen[window(t, s)] > 1:
                a = max(s, last)
                gone[a : s + k] = [True] * (s + k - a)
                last = s + k
        out.append(gone)
    return out


def plain_substring(rows, k):
    words = [(t or "").encode().split() for _, t in rows]
    return [(i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()) for (i, _), w, g in zip(rows, words, plain_windows(words, k))]


def plain_suffix(rows, k):
    raw = [(t or "").encode() for _, t in rows]
    return [(i, len(b), sum(g), sum(y and not x for x, y in zip([False, *g], g)), hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()) for (i, _), b, g in zip(rows, raw, plain_windows(raw, k))]


def passages(seed, letters, sep):
    rng = random.Random(seed)
    base = [rng.choice(letters) for _ in range(300)]
    make = lambda i: (base[rng.randrange(250) :][: rng.randrange(90)] if i % 3 else []) + [rng.choice(letters) for _ in range(rng.randrange(40))]
    rows = [(i, sep.join(make(i))) for i in range(50)] + [(7, None), (8, ""), (7, None), (None, sep.join(base[:60])), (9, sep.join(base)), (9, sep.join(base)), (11, letters[0] * 200)]
    return rows


@pytest.mark.parametrize("window", [5, 35])
def test_substring(spark, window):
    rows = passages(window, ["a", "b", "c", "dd"], " ")
    assert strings(map(tuple, substring_dedup.report(frame(spark, rows), window=window).collect())) == strings(plain_substring(rows, window))


@pytest.mark.parametrize(("window", "limit"), [(20, 1 << 20), (20, 500)])
def test_suffix(spark, window, limit):
    rows = passages(window, ["a", "b", "é"], "")
    assert strings(map(tuple, suffix_dedup.report(frame(spark, rows), window=window, limit=limit).collect())) == strings(plain_suffix(rows, window))


def test_dedups_keep_columns_and_stand_empty(spark):
    rows = [(1, "x " + "a b c d e f " * 2), (2, "clean"), (3, None)]
    out = substring_dedup.dedup(frame(spark, rows), window=5)
    assert out.columns == frame(spark, rows).columns and {r.doc_id: r.text for r in out.collect()} == {1: "x", 2: "clean", 3: None}
    for m in (substring_dedup, suffix_dedup):
        assert m.report(frame(spark, [])).count() == 0


def test_suffix_array_is_sorted():
    import numpy as np

    rng = random.Random(4)
    strs = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    strs += [strs[0][:9] + strs[1], strs[2] * 3, strs[2] * 3]
    text = np.frombuffer(b"".join(strs), np.uint8)
    lens = np.array([len(x) for x in strs])
    ends = np.cumsum(lens)
    sa = suffix_dedup.suffix_array(text, np.repeat(ends, lens))
    suffix = lambda p: bytes(text[p : ends[np.searchsorted(ends, p, "right")]])
    got = [suffix(p) for p in sa.tolist()]
    assert got == sorted(got)
    lcp = suffix_dedup.common_prefixes(text, ends - lens, ends, sa, 64)
    for a, b, n in zip(got, got[1:], lcp[1:].tolist()):
        assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])


# --- 9


def plain_fingerprint(t):
    w = (t or "").encode().translate(LOWER).split()
    if not w:
        return 0
    k = min(3, len(w))
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    first = {}
    for i, f in fps:
        first[f] = min((x for x in (first.get(f), i) if x is not None), default=None)
    todo, label = list(first), {}
    for f in todo:
        if f in label:
            continue
        group, stack = {f}, [f]
        while stack:
            a = stack.pop()
            near = [b for b in first if b not in group and (a ^ b).bit_count() <= 2]
            group |= set(near)
            stack += near
        low = min((first[x] for x in group if first[x] is not None), default=None)
        label |= dict.fromkeys(group, low)
    return label


@pytest.mark.parametrize("bucket", [8, 2])
def test_simhash(spark, bucket):
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]

    def near():
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "changed"
        return " ".join(w)

    rows = [(i, near()) for i in range(40)] + [(50 + i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(6)))) for i in range(40)] + [(None, "A b"), (200, "a\tB"), (201, None), (202, ""), (202, "")]
    want = [(i, plain_fingerprint(t)) for i, t in rows]
    label = plain_components(want)
    got = simhash.simhash(frame(spark, rows), bucket=bucket).collect()
    assert strings(map(tuple, got)) == strings((i, f"{f:016x}", label[f]) for i, f in want)


def test_simhash_empty(spark):
    assert simhash.simhash(frame(spark, [])).count() == 0


# --- pipeline


def test_pipeline(spark):
    """Each stage against a plain version of its decision, on what the stage before kept."""
    sf = "/root/testdata/sf0.001"
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf}/documents.parquet")
    columns, bench = docs.columns, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = scratch.write(stage(spark, docs, sf), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns[:5] == columns and set(after) <= set(before)
        if name == "language":
            assert set(after) == {i for i, t in before.items() if t and any(map(str.isalpha, t))}
        elif name == "near_duplicates":
            from tests.llm.test_near_copies import plain_firsts

            assert len(after) == plain_firsts(list(before.items()))
        elif name == "repeated_passages":
            rows = list(before.items())
            for (i, t), g in zip(rows, plain_windows([t.encode().split() for _, t in rows], 35)):
                left = b" ".join(w for w, x in zip(t.encode().split(), g) if not x).decode()
                assert after.get(i) == ((left or None) if any(g) else t)
        elif name == "benchmark_leaks":
            from tests.llm.test_maps import plain_words

            wins = collections.defaultdict(set)
            for t in bench:
                w = plain_words(t)
                k = min(10, len(w))
                for x in range(len(w) - k + 1 if k else 0):
                    wins[k].add(tuple(w[x : x + k]))
            leak = lambda t: any(tuple(w[x : x + k]) in s for w in [plain_words(t)] for k, s in wins.items() for x in range(len(w) - k + 1))
            assert set(after) == {i for i, t in before.items() if not leak(t)}
    v = S.vocabulary(S.read_model())
    for r in docs.collect():
        assert r.round_trip and bytes(r.sp_ids) == v.encode(r.text) and r.n_tokens == len(r.sp_ids) // 4
    assert all(r.n_chars == len(r.text) for r in docs.collect())
