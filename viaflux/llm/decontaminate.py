"""Benchmark decontamination (operator 4).

The n-grams of the benchmark are hashed into a sorted set that is broadcast in blocks
of bounded size; the token windows of every document are looked up in it, hits are
verified against the words themselves, and the hit words (or whole documents) go.

Words are maximal runs of digits, letters a-z (A-Z lowered) and non-ASCII bytes.
A benchmark item of fewer words than a window is one window of its own length.

Defined cases: a null or empty text has no words; a benchmark row that is null or has no
words gives no window; items with a null id still mark words but are not listed;
repeated benchmark rows count once by id; repeated documents are judged one by one;
empty tables give empty results or no hits; other columns of any name stay, but those with
the names of the new columns are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaflux.llm import frames
from viaflux.llm import kernels as K
from viaflux.storage import Scratch, bound_batches

WINDOW = 10
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20
#: Pairs of windows that are compared at once.
PAIRS = 1 << 18


class NgramSet:
    """Windows of benchmark items by length: sorted hashes, the word each begins with and its item.

    Words stay in one buffer; a benchmark of n bytes takes about 6 n.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window, self.items = window, [i for i, _ in items]
        data, offs = K.views(pa.array([t for _, t in items], pa.string()))
        self.data = K.LOWER[data]
        starts, ends, first = K.word_spans(self.data, offs, K.NON_ALNUM)
        hashes, n = K.span_hashes(self.data, starts, ends), np.diff(first)
        self.starts, self.ends = starts.astype(np.int32), ends.astype(np.int32)
        item_of = np.repeat(np.arange(len(items)), n)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(np.minimum(n[n > 0], window)).tolist():
            w = K.window_hashes(hashes, k)
            at = np.flatnonzero(K.inside_rows(first, k, len(w)))
            at = at[(n[item_of[at]] == k) | (k == window)]
            order = at[np.argsort(w[at], kind="stable")]
            self.by_length[k] = (w[order], order.astype(np.int32), item_of[order].astype(np.int32))

    def _matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cand: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in cand, item) of every candidate window and benchmark window with the same words."""
        keys, begin, owner = self.by_length[k]
        low, high = np.searchsorted(keys, w, "left"), np.searchsorted(keys, w, "right")
        out: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, PAIRS // max(1, int((high - low).max(initial=0))))
        for i in range(0, len(cand), step):
            n = (high - low)[i : i + step]
            who = np.repeat(np.arange(i, i + len(n)), n)
            x = low[who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            same = np.ones(len(who), bool)
            for j in range(k):
                p, q = cand[who] + j, begin[x] + j
                same &= (ends[p] - starts[p]) == (self.ends[q] - self.starts[q])
                todo = np.flatnonzero(same)
                same[todo] = K.same_spans(data, starts[p[todo]], self.starts[q[todo]], (ends - starts)[p[todo]], self.data)
            out.append((who[same], owner[x[same]]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def scan(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, list[int], list[int], list[str]]]:
        """(words, starts and ends of hit byte spans, items) of each row; ``data`` is lowered."""
        out = []
        for i, j in K.pieces(offs):
            d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            starts, ends, first = K.word_spans(d, o, K.NON_ALNUM)
            h = K.span_hashes(d, starts, ends)
            hit, items = np.zeros(len(h), bool), [set() for _ in range(j - i)]
            for k, (keys, _, _) in self.by_length.items():
                w = K.window_hashes(h, k)
                at = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
                cand = np.flatnonzero((keys[at] == w) & K.inside_rows(first, k, len(w)))
                if not len(cand):
                    continue
                who, item = self._matches(d, starts, ends, cand, w[cand], k)
                hit |= K.covered(cand[np.unique(who)], k, len(h))
                pairs = np.unique(np.stack((np.searchsorted(first, cand[who], "right") - 1, item)), axis=1)
                for r, x in pairs.T.tolist():
                    if self.items[x] is not None:
                        items[r].add(self.items[x])
            for r in range(j - i):
                a, b = first[r], first[r + 1]
                at = np.flatnonzero(hit[a:b]) + a
                out.append((int(b - a), (starts[at] - o[r]).tolist(), (ends[at] - o[r]).tolist(), sorted(items[r])))
        return out


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> Iterator[NgramSet]:
    """The benchmark in blocks of about ``block_bytes``; its size is read first."""
    src = benchmark.select(frames.col(item).cast("string").alias("item"), frames.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for i in range(blocks):
        part = src if blocks == 1 else src.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i)
        yield NgramSet([(r["item"], r["text"]) for r in part.collect()], window)


ADDED = {"words": "long", "starts": "ints", "ends": "ints", "items": "strings"}


def scan_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, prefix: str = "decon") -> DataFrame:
    """docs with ``{prefix}_words`` (long), ``{prefix}_starts``, ``{prefix}_ends`` (byte spans of hit words) and ``{prefix}_items``.

    A map over the rows for each block of the benchmark; between blocks the rows are written
    so that only one block is held by an executor.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    added = {f"{prefix}_{x}": t for x, t in ADDED.items()}
    out = frames.without(docs, *added)
    names, at = out.columns, out.columns.index(text)
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
    scratch, last = Scratch(spark), None
    for block in benchmark_blocks(benchmark, item, item_text, window, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        again = len(out.columns) > len(names)
        if again:
            out = scratch.write(out, "block")
            if last is not None:
                scratch.drop(last)
            last = out

        def run(batches: Iterator[pa.RecordBatch], shared=shared, again=again, width=len(names)) -> Iterator[list[pa.Array]]:
            grams = shared.value
            for b in batches:
                data, offs = K.views(b.column(at).cast(pa.string()))
                found = grams.scan(K.LOWER[data], offs)
                if again:
                    old = [b.column(width + x).to_pylist() for x in (1, 2, 3)]
                    found = [(n, *_merge(s0, e0, s, e), sorted({*i0, *items})) for (n, s, e, items), s0, e0, i0 in zip(found, *old)]
                yield [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            K.give_back()

        wide = frames.mapped(out, run, **{(f"{n}_next" if again else n): t for n, t in added.items()})
        cols = [f"c{i}" for i in range(len(wide.columns))]
        out = wide.toDF(*cols).select(*cols[: len(names)], *cols[-len(added) :]).toDF(*names, *added)
    return out


def _merge(s0: list[int], e0: list[int], s1: list[int], e1: list[int]) -> tuple[list[int], list[int]]:
    spans = sorted({*zip(s0, e0), *zip(s1, e1)})
    return [s for s, _ in spans], [e for _, e in spans]


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text", **options) -> DataFrame:
    """docs without contamination: whole documents go (``documents``), or only the hit words (``spans``).

    With ``spans``, the bytes from the first to the last word of each run of hit words are
    cut and the rest is kept unchanged. Columns stay as they were.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    names, at = docs.columns, docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name can clash with the columns of the scan
    scanned = scan_documents(plain, benchmark, text=f"c{at}", **options)
    if mode == "documents":
        return scanned.where(F.size("decon_starts") == 0).select(*plain.columns).toDF(*names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for r, (s, e) in enumerate(zip(b.column(len(names) + 1).to_pylist(), b.column(len(names) + 2).to_pylist())):
                if s:
                    texts[r] = cut_words(texts[r], s, e)
            yield [pa.array(texts, pa.string())]

    done = frames.mapped(scanned, cut, kept="string")
    return done.select(*["kept" if i == at else f"c{i}" for i in range(len(names))]).toDF(*names)


def cut_words(text: str, starts: list[int], ends: list[int]) -> str:
    """text without the byte spans; spans with nothing but separators between them go with what is between."""
    raw, out, at = text.encode(), [], 0
    runs: list[list[int]] = []
    for s, e in zip(starts, ends):
        if runs and not raw[runs[-1][1] : s].translate(None, _SEPARATORS):
            runs[-1][1] = e
        else:
            runs.append([s, e])
    for s, e in runs:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]]).decode()


_SEPARATORS = bytes(c for c in range(256) if K.NON_ALNUM[K.LOWER[c]])


def contamination_report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    s = scan_documents(src, benchmark, **options)
    return s.select(
        "doc_id",
        F.col("decon_words").alias("n_words"),
        F.size("decon_starts").cast("long").alias("n_hit"),
        F.size("decon_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "decon_items"), 256).alias("items_sha256"),
        (F.size("decon_starts") > 0).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
