"""Repeated windows over all documents: candidates through anchors, results back to documents.

Shared by the two operators that remove repeated passages. Tokens are words or bytes; a
window is a fixed number of tokens of one document. The steps:

1. Equal texts are made one row with its number of copies (partial aggregation first, so
   a large group of copies costs one row for each task).
2. Every window has an anchor, its k-gram with the smallest hash. Equal windows have equal
   anchors, so a window whose anchor occurs once cannot repeat and is dropped: about two in
   (window - k + 2) positions are shuffled, not all. This filter only drops.
3. Consecutive windows with one anchor form a context: their bytes. Equal contexts (by a
   128-bit BLAKE2 digest of the bytes) are made one row with the number of their copies, as
   texts are. Nothing is decided by that; a context weighs what its copies weigh.
4. Every context goes to the operator's own method, which decides the windows of each.
5. What the method found goes back to all copies of a context, and to their documents.

Counts are sums with partial aggregation and joins of two written tables that Spark can split,
so a passage that a third of all documents share stays a few rows a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaflux.llm import kernels as K
from viaflux.storage import Scratch, bound_batches

#: From (bytes, row offsets): a 64-bit value for each token, and each row's first token (one more than rows).
Tokens = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: From the same: bytes in which equal runs of tokens are equal spans, and where each token begins and ends.
Spelled = Callable[[np.ndarray, np.ndarray], tuple[bytes, np.ndarray, np.ndarray]]

#: A place is one long: position << 32 | distance back to the first start << 18 | to the last start << 4 | copies (2 at most).
#: A range of starts is one long: first << 32 | last.
MAX_WINDOW = (1 << 14) - 1


@dataclass(frozen=True)
class Kind:
    tokens: Tokens
    spelled: Spelled
    window: int
    anchor: int

    def __post_init__(self):
        if not 0 < self.anchor <= self.window <= MAX_WINDOW:
            raise ValueError(f"a window has 1 to {MAX_WINDOW} tokens")


def text_key(text: Column):
    return F.unhex(F.sha2(text.cast("string"), 256))


def distinct_texts(src: DataFrame, scratch: Scratch) -> DataFrame:
    """(tid, thash, copies, text) of every distinct value of ``text`` that is not null, written."""
    one = src.where(F.col("text").isNotNull()).groupBy(text_key(F.col("text")).alias("thash")).agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    return scratch.write(one.select(F.monotonically_increasing_id().alias("tid"), "thash", "copies", "text"), "texts")


def packed(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (a << 32) | (lo << 18) | (hi << 4) | c


def parts(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, distances back to the first and the last start."""
    return p >> 32, (p >> 18) & MAX_WINDOW, (p >> 4) & MAX_WINDOW


def copies() -> Column:
    return F.col("p").bitwiseAND(F.lit(15).cast("long"))


def anchor_rows(texts: DataFrame, kind: Kind) -> DataFrame:
    """(k, tid, p): anchor hash, text and place."""
    bound_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tid, copies = b.column(0).to_numpy(), np.minimum(b.column(1).to_numpy(), 2)
            data, offs = K.views(b.column(2))
            for i, j in K.pieces(offs):
                values, first = kind.tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                h, at, s1, s2 = K.anchors(values, first, kind.window, kind.anchor)
                row = np.searchsorted(first, s1, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tid[i + row]), pa.array(packed(at - first[row], at - s1, at - s2, copies[i + row]))], ["k", "tid", "p"])
        K.give_back()

    return texts.select("tid", "copies", "text").mapInArrow(run, "k long, tid long, p long")


def lists(rows: DataFrame, *names: str) -> DataFrame:
    """One row for each text with its rows as a list; no longer than the text."""
    return rows.groupBy("tid").agg(F.collect_list(F.struct(*names) if len(names) > 1 else F.col(names[0])).alias("rows"))


def by_text(b: pa.RecordBatch, col: int, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """The lists of a batch flat: row of the batch, then each name as numbers, ordered by row and first name."""
    arr = b.column(col)
    arr = arr.cast(pa.large_list(arr.type.value_type))
    n = np.diff(arr.offsets.to_numpy())
    flat = arr.flatten()
    cols = [(flat.field(x) if len(names) > 1 else flat).to_numpy(zero_copy_only=False).astype(np.int64) for x in names]
    row = np.repeat(np.arange(len(n)), np.where(arr.is_valid().to_numpy(zero_copy_only=False), n, 0))
    order = np.lexsort((cols[0], row))
    return row[order], *[c[order] for c in cols]


def ranges_by_text(b: pa.RecordBatch, col: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the batch, first and last start of its ranges."""
    row, q = by_text(b, col, ("q",))
    return row, q >> 32, q & 0xFFFFFFFF


def spelled_rows(b: pa.RecordBatch, names: tuple[str, ...], kind: Kind):
    """For pieces of a batch (tid, text, rows): tid of each row of the lists, its columns, the bytes, and where its context begins and ends in them."""
    tid, (data, offs), flat = b.column(0).to_numpy(), K.views(b.column(1)), by_text(b, 2, names)
    for i, j in K.pieces(offs):
        x, y = np.searchsorted(flat[0], [i, j])
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        raw, begin, end, first = kind.spelled(d, o)
        row, cols = flat[0][x:y] - i, [c[x:y] for c in flat[1:]]
        a, lo, hi = parts(cols[0])
        s = first[row] + a
        yield tid[i + row], cols, raw, begin[s - lo], end[s - hi + kind.window - 1]


def span_rows(texts: DataFrame, found: DataFrame, kind: Kind) -> DataFrame:
    """(k, d1, d2, tid, p): found with the digest of the bytes of its context."""
    joined = texts.select("tid", "text").join(lists(found, "p", "k"), "tid").select("tid", "text", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tid, (p, k), raw, s, e in spelled_rows(b, ("p", "k"), kind):
                d = K.digests(raw, s, e)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(tid), pa.array(p)], ["k", "d1", "d2", "tid", "p"])
        K.give_back()

    return joined.mapInArrow(run, "k long, d1 long, d2 long, tid long, p long")


def context_rows(texts: DataFrame, groups: DataFrame, kind: Kind) -> DataFrame:
    """(k, gid, m, lo, hi, part): the bytes of each context, once."""
    joined = texts.select("tid", "text").join(lists(groups, "p", "k", "gid", "m"), "tid").select("tid", "text", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, (p, k, gid, m), raw, s, e in spelled_rows(b, ("p", "k", "gid", "m"), kind):
                _, lo, hi = parts(p)
                part = [raw[x:y] for x, y in zip(s.tolist(), e.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(gid), pa.array(m), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(part, pa.binary())], ["k", "gid", "m", "lo", "hi", "part"])
        K.give_back()

    return joined.mapInArrow(run, "k long, gid long, m long, lo int, hi int, part binary")


@dataclass
class Found:
    texts: DataFrame  # (tid, thash, copies, text)
    spans: DataFrame  # (k, d1, d2, tid, p): every place of a context
    groups: DataFrame  # (gid, k, d1, d2, m, tid, p): every distinct context, its copies and one place
    contexts: DataFrame  # (k, gid, m, lo, hi, part)


def find(src: DataFrame, kind: Kind, scratch: Scratch) -> Found:
    texts = distinct_texts(src, scratch)
    first = scratch.write(anchor_rows(texts, kind), "anchors")
    # what is aggregated from a side of a join is written first, so that both sides are plain shuffles: a hot key can be split
    keys = scratch.write(first.groupBy("k").agg(F.sum(copies()).alias("m")).where("m > 1").select("k"), "keys")
    again = scratch.write(first.join(keys, "k").select("k", "tid", "p"), "again")
    scratch.drop(first, keys)
    spans = scratch.write(span_rows(texts, again, kind), "spans")
    scratch.drop(again)
    one = spans.groupBy("d1", "d2").agg(F.sum(copies()).alias("m"), F.min(F.struct("tid", "p", "k")).alias("e"))
    groups = scratch.write(one.select(F.monotonically_increasing_id().alias("gid"), "e.k", "d1", "d2", "m", "e.tid", "e.p"), "groups")
    return Found(texts, spans, groups, scratch.write(context_rows(texts, groups, kind), "contexts"))


def starts_of(found: Found, decided: DataFrame, scratch: Scratch) -> DataFrame:
    """(tid, rows) with the ranges of repeated starts of each text, from decided(gid, r1, r2): ranges relative to a context's first start."""
    ranges = decided.groupBy("gid").agg(F.collect_list(F.struct("r1", "r2")).alias("rs"))
    solved = scratch.write(found.groups.select("gid", "d1", "d2").join(ranges, "gid").select("d1", "d2", "rs"), "solved")
    back = found.spans.select("d1", "d2", "tid", "p").join(solved, ["d1", "d2"]).select("tid", "p", F.explode("rs").alias("r"))
    cut = lambda n: F.shiftright("p", n).bitwiseAND(F.lit(MAX_WINDOW).cast("long"))
    begin = F.shiftright("p", 32) - cut(18)
    q = F.shiftleft(begin + F.col("r.r1"), 32).bitwiseOR(begin + F.col("r.r2"))
    out = scratch.write(lists(back.select("tid", q.alias("q")), "q"), "starts")
    scratch.drop(found.spans, found.groups)
    return out


def runs(s1: np.ndarray, s2: np.ndarray, window: int, n: int) -> np.ndarray:
    """Tokens below n that are covered by windows with a start in any [s1, s2]."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, s1, 1)
    np.add.at(d, np.minimum(s2 + window, n), -1)
    return np.cumsum(d[:-1]) > 0


def source(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(f"`{text.replace('`', '``')}`").cast("string").alias("text"))


def replaced(docs: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """docs with the text of changed(thash, kept); rows are carried in one struct, so no name can clash."""
    rows = docs.select(F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("row"))
    rows = rows.select("row", text_key(F.col("row").getField(text)).alias("thash")).join(changed, "thash", "left")
    cell = lambda c: F.col("row").getField(c)
    return rows.select(*[(F.coalesce("kept", cell(c).cast("string")) if c == text else cell(c)).alias(c) for c in docs.columns])


def _quoted(c: str) -> str:
    return f"`{c.replace('`', '``')}`"
