"""Host-level quality rules (operator 2).

Base rules are computed for each document; their failures are counted by host
(``source``), each host's failure rate is shrunk with a beta prior fitted to all
hosts by moments, and the host's verdict is joined back to its documents.

Defined cases: a null or empty text has no words and fails; a null host has no
verdict, so its documents are judged by the base rules alone; repeated rows are
judged and counted as often as they occur; an empty table gives an empty result.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaflux.llm import kernels as K
from viaflux.storage import Scratch, bound_batches

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host whose shrunk failure rate is above this is rejected with all its documents.
MAX_HOST_RATE = 0.5

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _dup_lines(data: np.ndarray, offs: np.ndarray) -> list[int]:
    raw, out = data.tobytes(), []
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
        out.append(len(lines) - len(set(lines)))
    return out


def repeated_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Words in k-word windows that occur twice or more in their row.

    Hashes find the windows, the words themselves decide.
    """
    n, h = len(begin), K.span_hashes(data, begin, end)
    w = K.window_hashes(h, k)
    starts = np.flatnonzero(K.inside_rows(first, k, len(w)))
    if not len(starts):
        return np.zeros(n, bool)
    row = (np.searchsorted(first, starts, "right") - 1).astype(np.uint64)
    key = K.mix(w[starts] + K.mix(row + np.uint64(1)))
    order = np.argsort(key)
    key, starts, row = key[order], starts[order], row[order]
    lead = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(len(key)), 0))
    again = np.flatnonzero(lead != np.arange(len(key)))
    a, b = starts[again], starts[lead[again]]
    same, size = row[again] == row[lead[again]], end - begin
    for j in range(k):
        same &= size[a + j] == size[b + j]
        todo = np.flatnonzero(same)
        same[todo] = K.same_spans(data, begin[a[todo] + j], begin[b[todo] + j], size[a[todo] + j])
    if same.all():
        return K.covered(np.concatenate((a, b)), k, n)
    hit = set()  # different windows with one hash: all of that hash are told apart by their words
    odd = np.isin(key, key[again[~same]])
    windows: dict[tuple, list[int]] = {}
    for s, r in zip(starts[odd].tolist(), row[odd].tolist()):
        windows.setdefault((r, *[data[begin[s + j] : end[s + j]].tobytes() for j in range(k)]), []).append(s)
    hit.update(s for at in windows.values() if len(at) > 1 for s in at)
    sure = ~np.isin(key[again], key[odd])
    return K.covered(np.concatenate((a[sure], b[sure], np.array(sorted(hit), np.int64))), k, n)


def text_features(column: pa.Array) -> list[pa.Array]:
    parts = []
    data, offs = K.views(column)
    for i, j in K.pieces(offs):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, first = K.word_spans(d, o, K.SPACES)
        n_words = np.diff(first)
        chars = K.row_sums(((d & 0xC0) != 0x80) & ~K.SPACES[d], o)
        repeats = K.row_sums(repeated_words(d, starts, ends, first, REPEAT_WINDOW), first)
        parts.append((n_words, chars, K.row_sums(_SYMBOL[d], o), np.array(_dup_lines(d, o)), repeats))
    cols = [np.concatenate(x).astype(np.int64) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
    failed = (cols[0] < MIN_WORDS) | (100 * cols[4] > MAX_REPEAT_PERCENT * cols[0])
    return [*map(pa.array, cols), pa.array(failed)]


def base_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, host, the base features and base_failed) of every row."""
    bound_batches(docs.sparkSession)
    names = [x.split()[0] for x in FEATURES.split(", ")]
    src = docs.select(F.col(key).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *text_features(b.column(2))], ["doc_id", "host", *names])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, host string, {FEATURES}")


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) by moments from rows (n, failed) of all hosts.

    The variance that binomial sampling alone explains is taken off first. The result
    is one row for any number of hosts.
    """
    rate = F.col("failed") / F.col("n")
    row = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n")).alias("inv")).first()
    if row is None or row["m"] is None:
        return 1.0, 1.0
    m = min(max(row["m"], 1e-6), 1 - 1e-6)
    between = max(row["v"] - m * (1 - m) * row["inv"], 1e-9)
    strength = min(max(m * (1 - m) / between - 1, 1.0), 1e6)
    return m * strength, (1 - m) * strength


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n, failed, rate, host_ok) of every non-null host."""
    hosts = rules.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return hosts.withColumn("rate", rate).withColumn("host_ok", F.col("rate") <= F.lit(max_rate))


def host_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, base features, base_failed, host_rate and kept for every row of docs.

    The join on the host is Spark's own choice at run time: a shuffled join whose large
    partitions are split, or a broadcast if the verdicts turn out small.
    """
    rules = Scratch(docs.sparkSession).write(base_rules(docs, key, text, host), "rules")
    verdicts = host_verdicts(rules, max_rate).select("host", F.col("rate").alias("host_rate"), "host_ok")
    out = rules.join(verdicts, "host", "left")
    return out.select(*[c for c in rules.columns if c != "host"], "host_rate", (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"))
