"""Language-model scoring with Katz backoff (operator 3).

Counts of n-grams up to ``order`` words of the training documents are discounted by
Good-Turing: a count r of 5 or less by Turing's estimate from the counts of counts where that
lies between 0 and r, all others by Gale's straight line through the logarithms of the counts of
counts. What a history gives up is shared among the words it was never seen with, in proportion
to their probability after the history that is one word shorter, so the probabilities of a
history sum to one exactly; the single words give theirs to the class of unknown words. A text's
score is the sum over its tokens of log10 P(token | tokens before), evaluated from the longest
n-gram down, history by history.

How it runs: documents are cut into chunks of a few MB, held as local token numbers with the
chunk's vocabulary. Each chunk sends its distinct n-grams once, hashed to 64 bits, to the
buckets of the count tables (one for each length, partitioned by hash, so no history or
word is one task's); a bucket adds them up and sends each chunk its counts back. One chunk of
those that hold an n-gram is named its owner and adds it to its history's sums. Only backoffs
look up their history in the written table of weights, which Spark can split where a history
is common. What is shuffled grows in proportion to the text: a chunk sends no more slices than
it has n-grams; larger chunks make fewer slices where executors have the memory. Nothing of it
goes to the driver but 9 numbers for each length.

Words are hashed by their bytes through a bijection of eight bytes at a time, n-grams by mixing
those; two n-grams with one hash would be counted as one (once in 2**64 pairs).

Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage
return, with A-Z in lower case; a document ends with one end token. Defined cases: a null or
empty text is an end token alone; rows with a null id are held out (their id has no checksum
to train by); repeated rows are trained and scored as often as they occur; without training
documents every token is unknown and has probability one; an empty table gives an empty
result; other columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from viaflux.llm import kernels as K
from viaflux.storage import Scratch, bound_batches

HELD_OUT_MOD = 10
#: Bytes of text in a chunk.
CHUNK = 8 << 20
#: Words of the longest n-gram.
ORDER = 2
#: Counts up to this are discounted by Turing's own estimate where it can be used.
TOP_COUNT = 5
#: N-grams that one bucket of the count tables takes, of all chunks together.
BUCKET_KEYS = 2_000_000
U64 = np.uint64
_END, _BEGIN = (np.frombuffer(x, "<u8")[0] for x in (b"\xff<end>\xff\xff", b"\xff<begin>"))


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(HELD_OUT_MOD)) == 0, F.lit(True))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return K.mix(a * U64(0xD6E8FEB86659FD93) + b)


# --- compact arrays


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers as their lowest bytes, then the next, and so on: small numbers leave zeros that compress away."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def small(x: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest."""
    most = int(x.max(initial=0))
    return x.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def from_small(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def steps(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys: the first whole, then the differences in as many bytes as the largest needs."""
    d = np.diff(keys)
    width = max(1, (int(d.max(initial=0)).bit_length() + 7) // 8)
    return keys[:1].tobytes() + np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def from_steps(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[0] = np.frombuffer(raw[:8], np.uint8)
    if n > 1:
        width = (len(raw) - 8) // (n - 1)
        out[1:, :width] = np.frombuffer(raw[8:], np.uint8).reshape(n - 1, width)
    return np.cumsum(out.view("<u8").ravel(), dtype=U64)


# --- chunks

CHUNK_COLUMNS = ("held", "lengths", "vocab", "tokens")


def chunked(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each chunk of docs(doc_id, held, text): ids and flags of its documents, tokens in each, vocabulary hashes, the most frequent first, and the local numbers of all tokens."""
    bound_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), *[T.StructField(c, T.BinaryType()) for c in CHUNK_COLUMNS]])

    def pack(texts: list[tuple], n: int) -> pa.RecordBatch:
        ids = pa.concat_arrays([x[0] for x in texts])
        held, lengths, hashes = (np.concatenate(x) for x in list(zip(*texts))[1:])
        vocab, tokens, often = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number = (TaskContext.get().partitionId() << 32) + n
        cols = [held.astype(np.uint8).tobytes(), lengths.astype("<i4").tobytes(), vocab[order].tobytes(), planes(rank[tokens])]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([x], pa.binary()) for x in cols]], ["chunk", "ids", *CHUNK_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size, n = [], 0, 0
        for b in batches:
            flags = b.column(1).to_numpy(zero_copy_only=False)
            data, offs = K.views(b.column(2))
            for i, j in K.pieces(offs):
                d, o = K.LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
                starts, ends, first = K.word_spans(d, o, K.SPACES)
                h = np.insert(K.span_hashes(d, starts, ends), first[1:], _END)
                texts.append((b.column(0).slice(i, j - i), flags[i:j], np.diff(first) + 1, h))
                size += int(o[-1]) + 8 * (j - i)
                if size >= chunk:
                    yield pack(texts, n)
                    texts, size, n = [], 0, n + 1
        if texts:
            yield pack(texts, n)
        K.give_back()

    return docs.mapInArrow(run, schema)


class Chunk:
    """Arrays of a chunk's row: for every token, n-gram and history by length (1 first), and whether it trains."""

    def __init__(self, row: dict, order: int):
        g = lambda c, t: np.frombuffer(row[c], t)
        self.number, self.held = row["chunk"], g("held", np.uint8).astype(bool)
        self.lengths, stored = g("lengths", "<i4").astype(np.int64), g("vocab", "<u8")
        sort = np.argsort(stored)
        place = np.empty(len(sort), np.int64)
        place[sort] = np.arange(len(sort))
        vocab, tokens = stored[sort], place[from_planes(row["tokens"])]
        self.doc = np.repeat(np.arange(len(self.held)), self.lengths)
        self.train = ~self.held[self.doc]
        self.first = np.cumsum(self.lengths) - self.lengths
        self.keys, self.gram, self.history = [vocab], [tokens], [None]
        word = vocab[tokens]
        before, history = word, None
        for _ in range(order - 1):
            before = self.moved(before, _BEGIN)  # the word one place further back
            history = before if history is None else pair_hash(before, history)
            keys, gram = np.unique(pair_hash(history, word), return_inverse=True)
            self.keys.append(keys)
            self.gram.append(gram)
            self.history.append(history)

    def moved(self, values: np.ndarray, begin) -> np.ndarray:
        """What each token's predecessor has; ``begin`` at the first of a document."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = begin
        return out

    def counts(self, of: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(of[self.train], minlength=n)


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    names = b.schema.names
    for i in range(b.num_rows):
        yield {c: b.column(j)[i].as_py() for j, c in enumerate(names)}


# --- count tables

PARTS = "bucket int, kind int, chunk long, m int, keys binary, counts binary"


def sent(chunks: DataFrame, buckets: int, order: int) -> DataFrame:
    """Slices of each chunk's distinct n-grams (kind: their length) by bucket, ascending, with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(1, buckets, dtype=object) * ((1 << 64) // buckets)).astype(U64)
        for b in batches:
            for row in _rows(b):
                c = Chunk(row, order)
                for kind, (keys, gram) in enumerate(zip(c.keys, c.gram), 1):
                    counts = c.counts(gram, len(keys))
                    cuts = np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
                    use = np.flatnonzero(np.diff(cuts))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(use.astype(np.int32)), pa.array(np.full(len(use), kind, np.int32)), pa.array(np.full(len(use), c.number, np.int64)), pa.array(np.diff(cuts)[use].astype(np.int32)), pa.array([steps(keys[cuts[i] : cuts[i + 1]]) for i in use], pa.binary()), pa.array([small(counts[cuts[i] : cuts[i + 1]]) for i in use], pa.binary())],
                        ["bucket", "kind", "chunk", "m", "keys", "counts"],
                    )

    return chunks.mapInArrow(run, PARTS)


#: counts: for each key of the slice its count in all; owned: keys for which this chunk speaks; n1..n6 and total, types: of the bucket, on its first row.
COUNTED = "bucket int, kind int, chunk long, m int, counts binary, owned binary, total long, types long, " + ", ".join(f"n{r} long" for r in range(1, TOP_COUNT + 2))


def _add(table: pa.Table) -> pa.Table:
    """A bucket's counts: slices are added by key, each chunk gets its slice's sums back."""
    names = [x.split()[0] for x in COUNTED.split(", ")]
    lens = table.column("m").to_numpy().astype(np.int64)
    keys = [from_steps(x.as_py(), n) for x, n in zip(table.column("keys"), lens.tolist())]
    own = [from_small(x.as_py(), n) for x, n in zip(table.column("counts"), lens.tolist())]
    flat, mine = np.concatenate(keys), np.concatenate(own)
    types, inverse = np.unique(flat, return_inverse=True)
    total = np.bincount(inverse, mine, len(types)).astype(np.int64)
    # the owner of an n-gram is the first slice that trained it
    trained = np.flatnonzero(mine > 0)
    owner = np.full(len(types), -1, np.int64)
    owner[inverse[trained[::-1]]] = trained[::-1]
    owned = np.zeros(len(flat), np.uint8)
    owned[owner[owner >= 0]] = 1
    cuts = np.concatenate(([0], np.cumsum(lens)))
    seen = total[total > 0]
    stats = [int(seen.sum()), len(seen), *[int((seen == r).sum()) for r in range(1, TOP_COUNT + 2)]]
    per_key = total[inverse]
    n = len(lens)
    cols = [table.column("bucket"), table.column("kind"), table.column("chunk"), pa.array(lens.astype(np.int32))]
    cols += [pa.array([small(per_key[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([np.packbits(owned[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())]
    cols += [pa.array([x] + [0] * (n - 1), pa.int64()) for x in stats]
    return pa.table(cols, names)


def counted(parts: DataFrame) -> DataFrame:
    return parts.groupBy("bucket", "kind").applyInArrow(_add, COUNTED)


@dataclass(frozen=True)
class Discount:
    """Good-Turing: factors for counts up to TOP_COUNT (0 is unused), and the slope of the line for all others."""

    factors: np.ndarray
    slope: float

    @classmethod
    def of(cls, counts_of_counts: list[int]) -> Discount:
        n = np.array([0, *counts_of_counts], float)
        r = np.flatnonzero(n)
        # Gale's line log n[r] = a + slope log r; Turing's r* = (r+1) n[r+1] / n[r] is then r (1 + 1/r) ** (slope + 1), below r if the slope is below -1
        x, y = np.log(r), np.log(n[r]) if len(r) else r
        slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()) if len(r) > 1 else -2.0
        slope = min(slope, -1.1)
        factors = np.ones(TOP_COUNT + 1)
        for c in range(1, TOP_COUNT + 1):
            turing = (c + 1) * n[c + 1] / (c * n[c]) if n[c] else 0.0
            factors[c] = turing if 0 < turing < 1 else (1 + 1 / c) ** (slope + 1)
        return cls(factors, slope)

    def left(self, c: np.ndarray) -> np.ndarray:
        """Counts less what they give up; 0 for 0."""
        many = np.maximum(c, 1).astype(float)
        return np.where(c > TOP_COUNT, many * (1 + 1 / many) ** (self.slope + 1), c * self.factors[np.minimum(c, TOP_COUNT)])


# --- probabilities

#: One row for a document (row: its place in the chunk): score so far. One for a backoff: its document, history and how often. One for an owned history: what it has given.
EVENTS = "kind int, chunk long, row int, history long, n long, seen double, lower double, held boolean, n_tokens long, n_known long, base double, score double"


def evaluated(chunks: DataFrame, returned: DataFrame, sums: list[dict], train_docs: int) -> DataFrame:
    """Documents, backoffs and history sums of every chunk, from the counts sent back."""
    joined = chunks.drop("ids").join(returned, "chunk")
    joined = joined.select("chunk", *CHUNK_COLUMNS, "back")
    order, give = len(sums), [Discount.of(x["n"]) for x in sums]
    total, types = sums[0]["total"], sums[0]["types"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _rows(b):
                yield from _evaluate(row)
        K.give_back()

    def _evaluate(row: dict) -> Iterator[pa.RecordBatch]:
        c = Chunk(row, order)
        got: dict[int, list] = {k: [] for k in range(1, order + 1)}
        for x in sorted(row["back"], key=lambda x: x["bucket"]):
            got[x["kind"]].append(x)
        counts, owned = [], []
        for k in range(order):
            counts.append(np.concatenate([from_small(x["counts"], x["m"]) for x in got[k + 1]]))
            owned.append(np.concatenate([np.unpackbits(np.frombuffer(x["owned"], np.uint8), count=x["m"]).astype(bool) for x in got[k + 1]]))
            assert len(counts[k]) == len(c.keys[k])
        n = len(c.held)
        sum_ = lambda v: np.bincount(c.doc, v, n)
        known = counts[0][c.gram[0]]
        # by length: count of the token's n-gram, of its history (as often as that was an n-gram itself), and P of the n-gram where it was seen
        seen, past, p = [known], [np.full(len(known), total)], [give[0].left(known) / max(total, 1)]
        for k in range(1, order):
            seen.append(counts[k][c.gram[k]])
            past.append(c.moved(seen[k - 1], train_docs))
            with np.errstate(divide="ignore", invalid="ignore"):
                p.append(np.where(seen[k] > 0, give[k].left(seen[k]) / past[k], 0.0))
        score, open_ = np.zeros(len(known)), np.ones(len(known), bool)
        backs = []
        for k in range(order - 1, -1, -1):  # from the longest n-gram down
            here = open_ & (seen[k] > 0)
            score[here] = np.log10(p[k][here])
            open_ &= ~here
            if k:
                backs.append((k, np.flatnonzero(open_ & (past[k] > 0))))
        base = np.log10((known + 0.1) / (total + 0.1 * (types + 1)))
        yield _events(0, n, chunk=np.full(n, c.number), row=np.arange(n), n=sum_(open_).astype(np.int64), held=c.held, n_tokens=c.lengths, n_known=sum_(known > 0).astype(np.int64), base=sum_(base), score=sum_(score))
        for k, at in backs:
            if len(at):
                key, times = np.unique(np.stack((c.doc[at], c.history[k][at].view(np.int64))), axis=1, return_counts=True)
                yield _events(1, len(times), chunk=np.full(len(times), c.number), row=key[0], history=key[1], n=times)
        for k in range(order):
            place = np.zeros(len(c.keys[k]), np.int64)
            place[c.gram[k][::-1]] = np.arange(len(c.gram[k]))[::-1]  # a place of each n-gram
            at = place[owned[k]]
            if len(at):
                h, inv = np.unique(c.history[k][at], return_inverse=True) if k else (np.full(1, _ROOT), np.zeros(len(at), np.int64))
                mine = counts[k][owned[k]]
                lower = np.bincount(inv, p[k - 1][at], len(h)) if k else np.zeros(1)
                yield _events(2, len(h), history=h.view(np.int64), n=np.bincount(inv, mine, len(h)).astype(np.int64), seen=np.bincount(inv, give[k].left(mine), len(h)), lower=lower)

    return joined.mapInArrow(run, EVENTS)


#: The history of single words.
_ROOT = np.frombuffer(b"\xff<root>\xff", "<u8")[0]


def _events(kind: int, size: int, **cols) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "row": pa.int32(), "held": pa.bool_(), **{c: pa.float64() for c in ("seen", "lower", "base", "score")}}
    names = [x.split()[0] for x in EVENTS.split(", ")]
    out = []
    for c in names:
        t = types.get(c, pa.int64())
        out.append(pa.array(np.full(size, kind, np.int32)) if c == "kind" else pa.array(cols[c]).cast(t) if c in cols else pa.nulls(size, t))
    return pa.RecordBatch.from_arrays(out, names)


def backoff_weights(events: DataFrame) -> DataFrame:
    """(history, alpha): the mass left to a history over the mass that the words it was never seen with have after the shorter history."""
    h = events.where("kind = 2").groupBy("history").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.sum("lower").alias("lower"))
    return h.select("history", ((1 - F.col("seen") / F.col("n")) / (1 - F.col("lower"))).alias("alpha"))


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, chunk: int = CHUNK, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    if order < 1:
        raise ValueError("an n-gram has one word at least")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    src = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held"), F.col(text).cast("string").alias("text"))
    chunks = scratch.write(chunked(src, chunk), "chunks")
    if buckets is None:  # a bucket stays some MB at any size of the corpus
        slots = chunks.agg(F.sum(F.octet_length("tokens") / 4)).first()[0] or 0
        buckets = max(16, -(-int(slots) // BUCKET_KEYS))
    counts = scratch.write(counted(sent(chunks, buckets, order)), "counts")
    found = {r["kind"]: r for r in counts.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("total", "types", *[f"n{r}" for r in range(1, TOP_COUNT + 2)])]).collect()}
    none = dict.fromkeys(("total", "types", *[f"n{r}" for r in range(1, TOP_COUNT + 2)]), 0)
    sums = [{"total": x["total"], "types": x["types"], "n": [x[f"n{r}"] for r in range(1, TOP_COUNT + 2)]} for x in (found.get(k, none) for k in range(1, order + 1))]
    returned = counts.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "counts", "owned", "m")).alias("back"))
    trains = F.octet_length(F.expr("replace(hex(held), '01', '')")) / 2  # one byte for each document: 01 if held out, else 00
    train_docs = int(chunks.agg(F.sum(trains)).first()[0] or 0)
    events = scratch.write(evaluated(chunks, returned, sums, train_docs), "events")
    ids = scratch.write(chunks.select("chunk", F.posexplode("ids").alias("row", "doc_id")), "ids")
    scratch.drop(chunks, counts)
    weights = scratch.write(backoff_weights(events), "weights")
    root = weights.where(F.col("history") == int(np.array(_ROOT).view(np.int64))).first()
    unknown = float(np.log10(root["alpha"])) if root else 0.0
    lost = events.where("kind = 1").select("chunk", "row", "history", "n").join(weights, "history").groupBy("chunk", "row").agg(F.sum(F.col("n") * F.log10("alpha")).alias("backoff"))
    per_doc = events.where("kind = 0").join(lost, ["chunk", "row"], "left")
    return ids.join(per_doc, ["chunk", "row"]).select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(sums[0]["total"]).cast("long").alias("train_tokens"), F.col("base").alias("base_score"),
        (F.col("score") + F.col("n") * F.lit(unknown) + F.coalesce("backoff", F.lit(0.0))).alias("score"),
    )
