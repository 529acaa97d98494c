"""Suffix-array dedup of byte strings (operator 5).

Every byte covered by a ``WINDOW``-byte string that also starts anywhere else is removed;
strings are judged on the input and never cross documents. Candidates come from ``repeats``
with bytes as tokens: the stretches of text, each distinct one once, whose windows might
repeat. They are dealt out to shards by anchor, so equal windows meet in one shard. Each shard
builds a suffix array by Larsson-Sadakane refinement in numpy, takes common prefixes by
Kasai's method, and finds the strings that occur twice in it, a stretch counting as often as
it occurs. An anchor with more stretches than a shard holds is split over several: their
suffix arrays then give their distinct windows in order, ranges of those (by Spark's sampled
splitters) gather the sorted runs of all shards, and the runs are merged by binary search.
Every removal is decided on the bytes.

Defined cases: a null or empty text has no bytes; a text shorter than a window loses
nothing; equal texts and repeated rows count as elsewhere for each other; a cut inside a
character leaves its other bytes (the report hashes bytes; ``dedup`` replaces them with
U+FFFD); texts of any length are read whole; an empty table gives an empty result; other
columns, of whatever name, are not read by the report and kept by ``dedup``.
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

WINDOW = 200
#: Bytes of one shard.
SHARD = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def byte_tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K.BYTE_VALUES[data], offs


def byte_bytes(data: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(len(data) + 1)
    return data.tobytes(), at[:-1], at[1:], offs


def kind(window: int) -> R.Kind:
    return R.Kind(byte_tokens, byte_bytes, window, max(1, min(32, window // 4)))


# --- one shard


#: Positions of a shard that a packed sort key can hold.
_PACKED = 1 << 21


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffixes in order; equal ones by position.

    ``ends[p]`` is where the string that holds position p ends; a suffix does not go beyond.
    Larsson-Sadakane: suffixes start in groups of equal first bytes, and only groups of two
    or more are sorted again, by the rank of what follows, while the length doubles.
    """
    n = len(text)
    at, left = np.arange(n), (ends - np.arange(n)).astype(np.int32)
    # five bytes and how many there are: an end sorts before a zero byte
    beyond = (np.maximum(5 - left, 0) * 8).astype(np.uint64)
    five = (K.eights(text)[:n].byteswap() >> np.uint64(24)) >> beyond << beyond
    if n < _PACKED:
        key = np.sort((five << np.uint64(24)) | (np.minimum(left, 6).astype(np.uint64) << np.uint64(21)) | at.astype(np.uint64))
        sa, key = (key & np.uint64(_PACKED - 1)).astype(np.int32), key >> np.uint64(21)
    else:
        key = (five << np.uint64(3)) | np.minimum(left, 6).astype(np.uint64)
        sa = np.lexsort((at, key))
        key = key[sa]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, at, 0))  # a group's rank is its first place
    h, open_ = 5, at
    while len(open_):
        edge = np.append(np.flatnonzero(new), n)
        size = np.diff(edge)
        open_ = np.flatnonzero(np.repeat(size > 1, size)) if len(open_) == n else open_[(size > 1)[np.searchsorted(edge, open_, "right") - 1]]
        open_ = open_[left[sa[open_]] >= h]  # what ends before is equal to its end
        p = sa[open_]
        follow = np.where(left[p] > h, rank[np.minimum(p + h, n - 1)] + 1, 0).astype(np.int64)
        if n < _PACKED:
            key = np.sort((rank[p].astype(np.int64) << 42) | (follow << 21) | p)
            p, key = (key & (_PACKED - 1)).astype(np.int32), key >> 21
        else:
            order = np.lexsort((p, follow, rank[p]))
            p, key = p[order], (rank[p][order].astype(np.int64) << 32) | follow[order]
        sa[open_] = p
        cut = np.concatenate(([True], key[1:] != key[:-1]))[: len(p)]
        new[open_] |= cut
        rank[p] = np.maximum.accumulate(np.where(cut, open_, 0))
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it, ``depth`` at most.

    Kasai: along a string the length falls by one at most from one position to the next (this
    takes suffixes in full order, equal ones by position). The strings of a shard are
    independent, so all of them advance together, eight bytes a comparison.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    lcp, lens = np.zeros(n, np.int64), ends - starts
    end_of, at8 = np.repeat(ends, lens), K.eights(text)
    order = np.argsort(-lens, kind="stable")
    starts, lens = starts[order], lens[order]
    h = np.zeros(len(starts), np.int64)
    for j in range(int(lens[0]) if len(lens) else 0):
        live = int(np.searchsorted(-lens, -j, "left"))
        i = starts[:live] + j
        at = place[i]
        before = sa[np.maximum(at - 1, 0)]
        most = np.where(at > 0, np.minimum(np.minimum(end_of[i] - i, end_of[before] - before), depth), 0)
        g = np.minimum(np.maximum(h[:live] - 1, 0), most)
        todo = np.flatnonzero(g < most)
        while len(todo):
            differ = at8[i[todo] + g[todo]] ^ at8[before[todo] + g[todo]]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
            g[todo] = np.minimum(g[todo] + same, most[todo])
            todo = todo[(same == 8) & (g[todo] < most[todo])]
        h[:live] = g
        lcp[at] = g
    return lcp


def window_classes(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, class) of every place with a whole window, in the order of the windows; equal windows share a class, and classes ascend."""
    text = np.frombuffer(b"".join(strings), np.uint8)
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(lens)
    starts = ends - lens
    if not len(text):
        return (np.zeros(0, np.int64),) * 3
    sa = suffix_array(text, np.repeat(ends, lens))
    lcp = common_prefixes(text, starts, ends, sa, window)
    label = np.cumsum(lcp < window)  # a new class wherever a suffix differs from the one before
    owner = np.repeat(np.arange(len(strings)), lens)
    s = owner[sa]
    whole = ends[s] - sa >= window
    return s[whole], (sa - starts[s])[whole], label[whole]


# --- over shards


def shards(contexts: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """contexts with salt and split: an anchor with more bytes than a shard is dealt to several."""
    sizes = contexts.groupBy("k").agg(F.sum(F.octet_length("part")).alias("n"))
    large = scratch.write(sizes.where(F.col("n") > limit).select("k", F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("pieces")), "large")
    out = contexts.select("k", "gid", "m", "part").join(large, "k", "left")
    salt = F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("gid"), F.col("pieces")).cast("int"))
    return out.select("k", "gid", "m", salt.alias("salt"), F.col("pieces").isNotNull().alias("split"), "part")


def _ranges(string: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, last) of runs of consecutive offsets."""
    if not len(string):
        return string, offset, offset
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    cut = np.flatnonzero(np.concatenate(([True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1))))
    last = np.concatenate((cut[1:], [len(string)])) - 1
    return string[cut], offset[cut], offset[last]


#: Ranges that a shard decides alone, or (w is not null) a distinct window of a split anchor, its weight and its places (gid, offset).
SOLVED = "gid long, r1 long, r2 long, w binary, weight long, places array<long>"


def _solve(gid: np.ndarray, m: np.ndarray, split: np.ndarray, strings: list[bytes], window: int) -> Iterator[pa.RecordBatch]:
    s, off, label = window_classes(strings, window)
    of = np.cumsum(np.concatenate(([0], label[1:] != label[:-1]))) if len(label) else label
    weight = np.bincount(of, m[s]).astype(np.int64) if len(label) else label
    use = (weight[of] > 1) & ~split[s]
    x, lo, hi = _ranges(s[use], off[use])
    none = pa.nulls(len(x), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(gid[x]), pa.array(lo), pa.array(hi), none, pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.list_(pa.int64()))], ["gid", "r1", "r2", "w", "weight", "places"])
    part = np.flatnonzero(split[s])
    if len(part):
        edge = np.flatnonzero(np.concatenate(([True], of[part][1:] != of[part][:-1])))
        sizes = np.diff(np.append(edge, len(part)))
        windows = [strings[a][o : o + window] for a, o in zip(s[part][edge].tolist(), off[part][edge].tolist())]
        places = np.stack((gid[s[part]], off[part]), axis=1).reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(2 * sizes))).astype(np.int32)), pa.array(places))
        n = len(edge)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(windows, pa.binary()), pa.array(weight[of[part][edge]]), lists], ["gid", "r1", "r2", "w", "weight", "places"])


def _resolve(batches: Iterator[pa.RecordBatch], window: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over the rows of a partition, in shards of whole groups (k, salt); groups are adjacent."""
    held: list[tuple] = []
    size, last = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        gid, m, split, strings = zip(*held)
        held.clear()
        yield from _solve(np.array(gid, np.int64), np.array(m, np.int64), np.array(split, bool), list(strings), window)

    for b in batches:
        for k, gid, m, salt, split, string in zip(*[c.to_pylist() for c in b.columns]):
            # whole groups fill a shard; the pieces of a split anchor are shards of their own
            if held and (k, salt) != last and (size >= limit or split or held[-1][2]):
                yield from flush()
                size = 0
            held.append((gid, m, split, string))
            size += len(string)
            last = (k, salt)
    if held:
        yield from flush()
    K.give_back()


#: Bytes of windows that one task merges.
MERGE_BYTES = 16 << 20


def merge_runs(runs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted distinct values of sorted runs, and for each run the place of its values in them; by binary search."""
    whole = runs[0]
    for run in runs[1:]:
        at = np.searchsorted(whole, run)
        fresh = np.ones(len(run), bool)
        inside = at < len(whole)
        fresh[inside] = whole[at[inside]] != run[inside]
        whole = np.insert(whole, at[fresh], run[fresh])
    return whole, [np.searchsorted(whole, run) for run in runs]


def merged(windows: DataFrame, window: int) -> DataFrame:
    """(gid, r1, r2) of the windows of split anchors that weigh two or more over all shards."""
    total = windows.count()
    if not total:
        return windows.select("gid", "r1", "r2")
    tasks = max(1, -(-total * window // MERGE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_runs, weights, places = [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            w = np.frombuffer(b"".join(b.column(0).to_pylist()), f"S{window}")
            order = np.argsort(w, kind="stable")  # what the shuffle hands over holds blocks of several shards
            sorted_runs.append(w[order])
            weights.append(b.column(1).to_numpy()[order])
            places.append(b.column(2).take(pa.array(order)))
        if sorted_runs:
            # of equal windows in one run the first place stands for all
            distinct = [np.unique(r) for r in sorted_runs]
            whole, _ = merge_runs(distinct)
            weight = np.zeros(len(whole), np.int64)
            for r, m in zip(sorted_runs, weights):
                np.add.at(weight, np.searchsorted(whole, r), m)
            for r, p in zip(sorted_runs, places):
                hit = p.filter(pa.array(weight[np.searchsorted(whole, r)] > 1)).flatten().to_numpy().reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(hit[:, 0]), pa.array(hit[:, 1]), pa.array(hit[:, 1])], ["gid", "r1", "r2"])
        K.give_back()

    return windows.select("w", "weight", "places").repartitionByRange(tasks, "w").mapInArrow(run, "gid long, r1 long, r2 long")


def decided(found: R.Found, of: R.Kind, limit: int, scratch: Scratch) -> DataFrame:
    """(gid, r1, r2): the repeated windows of every context."""
    total = found.contexts.agg(F.sum(F.octet_length("part"))).first()[0] or 0
    tasks = max(1, -(-total // (2 * limit)))  # told, so that small rows are not put into few tasks
    dealt = shards(found.contexts, limit, scratch).repartition(tasks, "k", "salt").sortWithinPartitions("k", "salt").select("k", "gid", "m", "salt", "split", "part")
    solved = scratch.write(dealt.mapInArrow(lambda batches: _resolve(batches, of.window, limit), SOLVED), "solved")
    scratch.drop(found.contexts)
    return solved.where("w is null").select("gid", "r1", "r2").unionByName(merged(solved.where("w is not null"), of.window))


def removals(src: DataFrame, window: int, scratch: Scratch, limit: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The distinct texts, and (tid, rows) with the list of ranges of starts of repeated windows."""
    of = kind(window)
    found = R.find(src, of, scratch)
    return found.texts, R.starts_of(found, decided(found, of, limit, scratch), scratch)


def kept_rows(texts: DataFrame, starts: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """(thash, n_bytes, n_removed, n_spans, kept_sha256 or kept) of every distinct text."""
    joined = texts.select("tid", "thash", "text").join(starts, "tid", "left").select("thash", "text", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = K.views(b.column(1))
            row, s1, s2 = R.ranges_by_text(b, 2)
            out = []
            for r in range(b.num_rows):
                t = data[offs[r] : offs[r + 1]]
                x, y = np.searchsorted(row, [r, r + 1])
                if x == y:
                    removed = spans = 0
                    left = t.tobytes()
                else:
                    gone = R.runs(s1[x:y], s2[x:y], window, len(t))
                    removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    left = t[~gone].tobytes()
                out.append((len(t), removed, spans, left.decode("utf-8", "replace") if keep_text else hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), pa.int64()) for c in cols[:3]], pa.array(list(cols[3]), pa.string())], ["thash", "n_bytes", "n_removed", "n_spans", "kept"])
        K.give_back()

    return joined.mapInArrow(run, "thash binary, n_bytes long, n_removed long, n_spans long, kept string")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, limit: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    scratch = Scratch(docs.sparkSession)
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts, starts = removals(src, window, scratch, limit)
    rows = scratch.write(kept_rows(texts, starts, window, False), "kept")
    scratch.drop(texts, starts)
    out = src.select("doc_id", R.text_key(F.col("text")).alias("thash")).join(rows, "thash", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", *[F.coalesce(c, zero).alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.coalesce("kept", F.lit(EMPTY)).alias("kept_sha256"))


def dedup(docs: DataFrame, text: str = "text", window: int = WINDOW, limit: int = SHARD) -> DataFrame:
    """docs with repeated byte strings cut from the text; columns and rows stay."""
    scratch = Scratch(docs.sparkSession)
    texts, starts = removals(R.source(docs, text), window, scratch, limit)
    changed = scratch.write(kept_rows(texts, starts, window, True).where("n_removed > 0").select("thash", "kept"), "changed")
    scratch.drop(texts, starts)
    return R.replaced(docs, changed, text)
