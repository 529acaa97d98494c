"""Substring dedup by level-wise doubling (operator 7).

Windows of ``WINDOW`` words whose sequence also starts anywhere else, in the same document
or another, are removed. The first level are windows of 9 words at anchors (see ``repeats``).
Windows that are repeated at one length alone are extended to twice that length: 9, 18, then
the 35 words asked for, each level counted over all documents, until no candidate survives
or the length asked for is reached. Shorter levels are counted by 64-bit hashes, where a
collision only keeps a candidate; at the last one, windows are equal if the 128-bit BLAKE2
digests of their words are.

Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage
return. Defined cases: a null or empty text has no words; a text shorter than a window loses
nothing; equal texts and repeated rows count as elsewhere for each other; texts of any length
are read whole; an empty table gives an empty result; other columns, of whatever name, are not
read by the report and kept by ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaflux.llm import kernels as K
from viaflux.llm import repeats as R
from viaflux.storage import Scratch

WINDOW = 35
EMPTY = hashlib.sha256(b"").hexdigest()


def word_tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = K.word_spans(data, offs, K.SPACES)
    return K.span_hashes(data, starts, ends), first


def word_bytes(data: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = K.word_spans(data, offs, K.SPACES)
    return *K.joined_words(data, starts, ends), first


def kind(window: int) -> R.Kind:
    """Lengths halve from the window down to the anchor: 35, 18, 9."""
    return R.Kind(word_tokens, word_bytes, window, max(1, -(-window // 4)))


def half_windows(rows: DataFrame, of: R.Kind, length: int) -> DataFrame:
    """rows(gid, k, m, lo, hi, at, part) with ``left`` and ``right`` instead of ``part``: hashes of the windows of ``length`` that end and begin with the anchor, which is ``at`` words behind the first (null outside of the context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = K.views(b.column(6))
            values, first = word_tokens(data, offs)
            w, at = K.window_hashes(values, length), first[:-1] + b.column(5).to_numpy()
            cols = []
            for x in (at + of.anchor - length, at):
                ok = (x >= first[:-1]) & (x + length <= first[1:])
                h = np.zeros(len(x), K.U64)
                h[ok] = w[x[ok]]
                cols.append(pa.array(h.view(np.int64), mask=~ok))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(6)], *cols], ["gid", "k", "m", "lo", "hi", "at", "left", "right"])
        K.give_back()

    return rows.select("gid", "k", "m", "lo", "hi", "at", "part").mapInArrow(run, "gid long, k long, m long, lo int, hi int, at int, left long, right long")


def narrowed(halves: DataFrame, of: R.Kind, length: int, scratch: Scratch) -> DataFrame:
    """The candidates whose windows of ``length`` are repeated: rows with smaller lo and hi (the farthest and nearest start before the anchor)."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("h")), F.struct(F.lit(1).alias("side"), F.col("right").alias("h"))))
    e = halves.select("k", "m", sides.alias("e")).select("k", "m", "e.side", "e.h").where(F.col("h").isNotNull())
    again = scratch.write(e.groupBy("k", "side", "h").agg(F.sum("m").alias("n")).where("n > 1").select("k", "side", "h"), "halves")
    left = again.where("side = 0").select("k", F.col("h").alias("left"), F.lit(True).alias("has_left"))
    right = again.where("side = 1").select("k", F.col("h").alias("right"), F.lit(True).alias("has_right"))
    x = halves.join(left, ["k", "left"], "left").join(right, ["k", "right"], "left")
    # a window whose start is length - anchor or more before the anchor holds the left one, one with window - length or less holds the right one
    lo = F.when(F.col("has_left").isNull(), F.least("lo", F.lit(length - of.anchor - 1))).otherwise(F.col("lo"))
    hi = F.when(F.col("has_right").isNull(), F.greatest("hi", F.lit(of.window - length + 1))).otherwise(F.col("hi"))
    return x.select("gid", "k", "m", lo.alias("lo"), hi.alias("hi"), "at").where("lo >= hi")


def whole_windows(rows: DataFrame, of: R.Kind) -> DataFrame:
    """(w1, w2, gid, r, m): every window that is still a candidate, by the digest of its words, r words behind the context's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = K.views(b.column(5))
            starts, ends, first = K.word_spans(data, offs, K.SPACES)
            gid, m, lo, hi, at = (b.column(i).to_numpy().astype(np.int64) for i in range(5))
            n = lo - hi + 1
            row = np.repeat(np.arange(len(n)), n)
            r = (at - lo)[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            x = first[:-1][row] + r
            d = K.digests(data.tobytes(), starts[x], ends[x + of.window - 1])  # one blank between the words of a context
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(gid[row]), pa.array(r.astype(np.int32)), pa.array(m[row])], ["w1", "w2", "gid", "r", "m"])
        K.give_back()

    return rows.select("gid", "m", "lo", "hi", "at", "part").mapInArrow(run, "w1 long, w2 long, gid long, r int, m long")


def decided(found: R.Found, of: R.Kind, scratch: Scratch) -> DataFrame:
    """(gid, r1, r2): the repeated windows of every context, level by level."""
    texts = found.contexts.select("gid", "part")
    rows = found.contexts.select("gid", "k", "m", "lo", "hi", F.col("lo").alias("at"), "part")
    length, left = of.anchor, True
    while left and (length := min(2 * length, of.window)) < of.window:
        halves = scratch.write(half_windows(rows, of, length), "halves")
        survivors = scratch.write(narrowed(halves, of, length, scratch), "survivors")
        scratch.drop(halves)
        left = not survivors.isEmpty()
        rows = survivors.join(texts, "gid")
    full = scratch.write(whole_windows(rows, of), "windows")
    twice = scratch.write(full.groupBy("w1", "w2").agg(F.sum("m").alias("n")).where("n > 1").select("w1", "w2"), "twice")
    out = scratch.write(full.join(twice, ["w1", "w2"]).select("gid", F.col("r").cast("long").alias("r1"), F.col("r").cast("long").alias("r2")), "decided")
    scratch.drop(full, found.contexts)
    return out


def removals(src: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The distinct texts, and (tid, rows) with the list of ranges of starts of repeated windows."""
    of = kind(window)
    found = R.find(src, of, scratch)
    return found.texts, R.starts_of(found, decided(found, of, scratch), scratch)


def kept_rows(texts: DataFrame, starts: DataFrame, of: R.Kind, keep_text: bool) -> DataFrame:
    """(thash, n_words, n_removed, kept_sha256 or kept) of every distinct text."""
    joined = texts.select("tid", "thash", "text").join(starts, "tid", "left").select("thash", "text", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = K.views(b.column(1))
            row, s1, s2 = R.ranges_by_text(b, 2)
            n_words, n_removed, kept = [], [], []
            raw = data.tobytes()
            for r in range(b.num_rows):
                t = raw[offs[r] : offs[r + 1]]
                words = t.split()
                x, y = np.searchsorted(row, [r, r + 1])
                gone = R.runs(s1[x:y], s2[x:y], of.window, len(words)) if x < y else None
                n_words.append(len(words))
                n_removed.append(0 if gone is None else int(gone.sum()))
                left = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                if not keep_text:
                    kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
                else:  # a text that loses nothing stays as it was
                    kept.append((t if gone is None else b" ".join(left)).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["thash", "n_words", "n_removed", "kept"])
        K.give_back()

    return joined.mapInArrow(run, "thash binary, n_words long, n_removed long, kept string")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    scratch = Scratch(docs.sparkSession)
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts, starts = removals(src, window, scratch)
    rows = scratch.write(kept_rows(texts, starts, kind(window), False), "kept")
    scratch.drop(texts, starts)
    out = src.select("doc_id", R.text_key(F.col("text")).alias("thash")).join(rows, "thash", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.coalesce("n_words", zero).alias("n_words"), F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("kept", F.lit(EMPTY)).alias("kept_sha256"))


def dedup(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with repeated windows taken out of the text; columns and rows stay.

    A text that loses words comes back as its kept words joined by blanks, perhaps empty.
    """
    scratch = Scratch(docs.sparkSession)
    texts, starts = removals(R.source(docs, text), window, scratch)
    changed = scratch.write(kept_rows(texts, starts, kind(window), True).where("n_removed > 0").select("thash", "kept"), "changed")
    scratch.drop(texts, starts)
    return R.replaced(docs, changed, text)
