"""Language ID by rank-order profiles (operator 8).

A profile is the list of a language's most frequent letter n-grams (1 to 3 letters, words
padded with blanks, letters in lower case) in order of frequency. A document's own list is
compared with each profile by the out-of-place distance, and the nearest profile wins.

Profiles are fitted on a bounded sample: of each language about ``per_lang`` labelled
documents, chosen by a hash of their key and text; the bound is a parameter. Prediction
reads whole texts of all documents, and compares them with all languages, ``MAX_LANGS``
profiles at a time.

Defined cases: a null text or one without a letter gives ``und`` with score 0; labelled rows
with a null language or text teach nothing; equal distances go to the language that sorts
first, equal counts to the smaller n-gram; without any profile all documents are ``und``;
repeated rows are predicted one by one; an empty table gives an empty result; other columns
of any name stay, but those with the names of the new columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaflux.llm import frames
from viaflux.llm import kernels as K
from viaflux.storage import Scratch, bound_batches

#: N-grams in a profile and of a document.
TOP = 400
#: Labelled documents of each language that profiles are fitted on, about.
PER_LANG = 3000
#: Languages whose profiles go to a task at once (3 KB each).
MAX_LANGS = 2000
UNKNOWN = "und"
Profiles = dict[str, list[int]]

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (code points packed by 21 bits) and their counts."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[a]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # runs of other characters become one blank; one blank stands before the first word and after the last
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    a = np.where(letter, a, 0x20)[keep].astype(np.int64)
    a = np.concatenate(([0x20], a, [0x20]))
    blank = a == 0x20
    two = (a[:-1] << 21) | a[1:]
    three = (two[:-1] << 21) | a[2:]
    keys = np.concatenate((a[~blank], two[~(blank[:-1] & blank[1:])], three[~(blank[1:-1])]))
    keys.sort()
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[edge], np.diff(np.concatenate((edge, [len(keys)])))


def top_ngrams(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams first; equal counts by n-gram."""
    if len(keys) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        sure = counts >= least
        keys, counts = keys[sure], counts[sure]
    return keys[np.lexsort((keys, -counts))][:top]


class Matcher:
    def __init__(self, profiles: Profiles, top: int):
        self.langs = sorted(profiles)
        self.top = top
        self.tables = []
        for lang in self.langs:
            p = np.array(profiles[lang], np.int64)
            order = np.argsort(p)
            self.tables.append((p[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = ngrams(text) if text else (np.zeros(0, np.int64),) * 2
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        doc = top_ngrams(keys, counts, self.top)
        rank, best = np.arange(len(doc)), None
        for lang, (p, at) in zip(self.langs, self.tables):
            i = np.minimum(np.searchsorted(p, doc), len(p) - 1)
            far = np.where(p[i] == doc, np.abs(at[i] - rank), self.top).sum()
            if best is None or far < best[1]:
                best = (lang, far)
        return best[0], float(1 - best[1] / (self.top * len(doc)))


def fit_profiles(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", top: int = TOP, per_lang: int = PER_LANG) -> Profiles:
    """Profiles of all languages in ``labelled``; top n-grams of each (3 KB) go to the driver."""
    bound_batches(labelled.sparkSession)
    src = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(key).cast("string"), F.col(text).cast("string")).alias("h")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = Scratch(labelled.sparkSession).write(src.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("c")), "sizes")
    share = F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("c"))
    chosen = src.join(sizes, src["lang"] == sizes["of"]).where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[list, list]] = {}
        for b in batches:
            for lang_, text_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ks, cs = sums.setdefault(lang_, ([], []))
                k, c = ngrams(text_)
                ks.append(k)
                cs.append(c)
        for lang_, (ks, cs) in sums.items():
            k, inv = np.unique(np.concatenate(ks), return_inverse=True)
            c = np.bincount(inv, np.concatenate(cs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(k), pa.string()), pa.array(k), pa.array(c)], ["lang", "gram", "n"])

    grams = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = grams.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= top)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in ranked.select("lang", "r", "gram").collect():
        out.setdefault(r["lang"], []).append((r["r"], r["gram"]))
    return {k: [g for _, g in sorted(v)] for k, v in out.items()}


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", top: int = TOP, prefix: str = "") -> DataFrame:
    """docs with ``{prefix}lang_pred`` and ``{prefix}score``; a map over the rows."""
    spark = docs.sparkSession
    bound_batches(spark)
    names = [f"{prefix}lang_pred", f"{prefix}score"]
    out = frames.without(docs, *names)
    at, langs = out.columns.index(text), sorted(profiles)

    def passing(shared, before: int | None):
        """One block of languages; what an earlier block found wins equal scores, as its languages sort first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
            matcher = Matcher(*shared.value)
            for b in batches:
                found = [matcher.predict(None if t is None else str(t)) for t in b.column(at).to_pylist()]
                if before is not None:
                    old = zip(b.column(before).to_pylist(), b.column(before + 1).to_pylist())
                    found = [new if o[0] == UNKNOWN or new[1] > o[1] else o for new, o in zip(found, old)]
                yield [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            K.give_back()

        return run

    new, width = {names[0]: "string", names[1]: "double"}, len(out.columns)
    for i in range(0, max(1, len(langs)), MAX_LANGS):
        shared = spark.sparkContext.broadcast(({x: profiles[x] for x in langs[i : i + MAX_LANGS]}, top))
        if i == 0:
            out = frames.mapped(out, passing(shared, None), **new)
        else:
            out = frames.mapped(out, passing(shared, width), **{f"{n}_next": t for n, t in new.items()})
            cols = [f"c{x}" for x in range(len(out.columns))]
            out = out.toDF(*cols).select(*cols[:width], *cols[width + 2 :]).toDF(*out.columns[: width + 2])
    return out
