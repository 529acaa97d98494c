"""Exactness of the operators on repeated passages: colliding words, texts beyond a block, clashing columns."""

import random

import numpy as np
import pytest

from tests.llm.test_corpus import frame, is_held_out, plain_substring, plain_suffix, strings
from viaflux.llm import host_quality, katz, substring_dedup, suffix_dedup
from viaflux.llm import kernels as K


def alike(letters: str, n: int) -> tuple[str, str]:
    """Two words that every polynomial hash modulo 2**64 takes for one: a sequence and its complement."""
    a = "".join(letters[i.bit_count() % 2] for i in range(n))
    return a, a.translate({ord(letters[0]): letters[1], ord(letters[1]): letters[0]})


ONE, TWO = alike("ab", 2048)


def test_words_that_polynomials_confuse():
    raw = np.frombuffer(f"{ONE} {TWO} {ONE}".encode(), np.uint8)
    h = K.span_hashes(raw, np.array([0, 2049, 4098]), np.array([2048, 4097, 6146]))
    assert h[0] == h[2] != h[1]


def test_colliding_words_stay(spark):
    words = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([*words, ONE])), (2, " ".join([*words, TWO]))]
    assert [r.n_removed for r in substring_dedup.report(frame(spark, rows)).collect()] == [0, 0]


def test_colliding_words_are_other_windows(spark):
    words = [f"w{i}" for i in range(7)]
    df = spark.createDataFrame([(1, " ".join([*words, ONE, *words, TWO]), "h")], "doc_id long, text string, source string")
    assert host_quality.base_rules(df).first().n_repeat_words == 0


def test_colliding_words_are_unknown(spark):
    held = next(i for i in range(100) if is_held_out(i))
    rows = [(held, TWO), *[(i, ONE) for i in range(100, 120) if not is_held_out(i)]]
    assert {r.doc_id: r.n_known for r in katz.scores(frame(spark, rows)).collect()}[held] == 1


def long_texts(seed, letters, sep, n):
    """Texts of over a block (1 MiB), with passages of each other and of short ones."""
    rng = random.Random(seed)
    text = lambda n: [rng.choice(letters) for _ in range(n)]
    shared = text(400)
    rows = []
    for i in range(2):
        a = text(n if i == 0 else 3000)
        a[len(a) // 2 : len(a) // 2] = shared
        a += shared[50:350]
        rows.append((i, sep.join(a)))
    rows += [(5, sep.join(shared)), (6, sep.join(text(300))), (7, rows[0][1])]
    assert len(rows[0][1]) > K.BLOCK
    return rows


def test_substring_beyond_a_block(spark):
    rows = long_texts(1, [f"word{i}" for i in range(3000)], " ", 150_000)
    assert strings(map(tuple, substring_dedup.report(frame(spark, rows)).collect())) == strings(plain_substring(rows, 35))


def test_suffix_beyond_a_block(spark):
    rows = long_texts(2, [f"{i:x} " for i in range(3000)], "", 300_000)
    assert strings(map(tuple, suffix_dedup.report(frame(spark, rows)).collect())) == strings(plain_suffix(rows, 200))


def test_windows_that_agree_beyond_the_depth(spark):
    """Strings equal in their first window bytes and different behind: the order behind must not matter."""
    rng = random.Random(3)
    base = "".join(rng.choice("ab") for _ in range(400))
    rows = [(i, base[rng.randrange(100) :][: rng.randrange(60, 300)] + "".join(rng.choice("ab") for _ in range(rng.randrange(80)))) for i in range(150)]
    for limit in (1 << 20, 700):
        assert strings(map(tuple, suffix_dedup.report(frame(spark, rows), window=40, limit=limit).collect())) == strings(plain_suffix(rows, 40))


def test_runs_merge_by_binary_search():
    rng = random.Random(7)
    runs = [np.sort(np.array([bytes(rng.choice(b"abc\0") for _ in range(4)) for _ in range(n)], "S4")) for n in (40, 1, 25, 60)]
    runs = [np.unique(r) for r in runs]
    whole, places = suffix_dedup.merge_runs(runs)
    assert whole.tolist() == sorted({x for r in runs for x in r.tolist()})
    assert all((whole[p] == r).all() for r, p in zip(runs, places))


@pytest.mark.parametrize("m", [substring_dedup, suffix_dedup])
def test_any_column_names(spark, m):
    rows = [(1, "a b c d e f g h", 7, 8, 9, "x"), (2, "a b c d e f g h", 7, 8, 9, None), (3, None, 7, None, 9, "x")]
    df = spark.createDataFrame(rows, ["doc_id", "text", "thash", "kept", "__thash", "a`b.c"])
    out = m.dedup(df, window=5)
    assert out.columns == df.columns
    assert {tuple(r)[:1] + tuple(r)[2:] for r in out.collect()} == {r[:1] + r[2:] for r in rows}
    assert {r.doc_id: r.text for r in out.collect()} == {1: "", 2: "", 3: None}


def test_contexts_weigh_their_copies(spark):
    """A passage in a third of all documents, whole and cut short."""
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"{passage} own{i} words{i}" if i % 3 == 0 else f"own{i} text{i} " * 30) for i in range(60)] + [(99, " ".join(passage.split()[5:45]))]
    assert strings(map(tuple, substring_dedup.report(frame(spark, rows)).collect())) == strings(plain_substring(rows, 35))
