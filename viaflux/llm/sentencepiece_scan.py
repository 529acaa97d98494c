"""SentencePiece encoding and decoding (operator 10).

The segmentation is the one with the largest sum of log-probabilities over the pieces of a
SentencePiece model file (a Viterbi search; of equal sums the one whose last piece begins
first, then so on backwards, as the library has it for unigram models). A unigram model brings
its log-probabilities; of a merge model, whose scores are ranks, a piece of rank r gets
-log(r + 2) by Zipf's law: nothing is trained. Log-probabilities are whole multiples of
1/``UNIT``, so sums are exact. Ordinary documents are segmented unit by unit: no piece has a
blank mark after another character, so the text between blank runs is independent.

Giant documents are a max-plus parallel scan: they are cut into chunks; each chunk yields a
matrix of best scores from every entry state to every exit state, a state being how many
characters the piece that crosses the chunk's edge reaches into the next chunk, and with each
score the place of its path among those that end alike by the rule for equal sums; the
matrices are combined associatively to one entry state for each chunk; every chunk is then
backtraced on its own. The ids are those of the whole text, wherever it is cut.

Decoding joins the pieces, turns byte pieces back into bytes, the blank mark into a blank,
and takes off the blank put before the text; it gives back every text unchanged.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids and
decodes to an empty one; the mark U+2581 in a text is the one character that SentencePiece
itself cannot keep: it comes back as a blank; characters without a piece become their
bytes; repeated rows are encoded one by one; an empty table gives an empty result; other
columns of any name stay, but one with the name of the new column is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaflux.llm import frames
from viaflux.llm import kernels as K
from viaflux.storage import Scratch, bound_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Characters of a chunk of a giant document, and from where on a document is one.
CHUNK = 16_384
GIANT = 65_536
#: Units whose ids a worker remembers.
MEMO = 150_000
#: Characters of units that are searched together.
TOGETHER = 65_536
NONE = -(1 << 60)
#: Scores are log-probabilities times this.
UNIT = 1024
#: Chunks of giant documents that one task takes.
CHUNKS_A_TASK = 8
#: Units longer than this are searched one by one and not remembered.
SHORT = 48
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BREAK = re.compile(f"[^{MARK}](?={MARK})")


@dataclass
class Vocabulary:
    """Pieces with integer scores; a character without a piece costs 10 units more than the worst piece."""

    scores: dict[str, tuple[int, int]]
    bytes_at: list[int]
    pieces: list[bytes | str]
    longest: int
    unknown: int
    memo: dict[str, bytes] = field(default_factory=dict)
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # by length of the piece: hashes, scores, ids
    id_scores: np.ndarray | None = None
    unit: re.Pattern | None = None  # independent stretches of a text

    @classmethod
    def load(cls, model: bytes) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        ranks = m.trainer_spec.model_type == 2
        scores, at, pieces = {}, [0] * 256, []
        for i, p in enumerate(m.pieces):
            pieces.append("")
            if p.type == 1:
                scores[p.piece] = (round(UNIT * (-math.log(2 - p.score) if ranks else p.score)), i)
                pieces[i] = p.piece
            elif p.type == 6:
                at[int(p.piece[3:5], 16)] = i
                pieces[i] = bytes([int(p.piece[3:5], 16)])
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece has a blank mark after another character")
        v = cls(scores, at, pieces, max(map(len, scores)), min(s for s, _ in scores.values()) - 10 * UNIT)
        # a line feed that is in no piece stands alone as well
        alone = "" if any("\n" in p for p in scores) else "\n"
        v.unit = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+|\n")
        v._index()
        return v

    def _index(self) -> None:
        self.id_scores = np.zeros(len(self.pieces), np.int64)
        for score, i in self.scores.values():
            self.id_scores[i] = score
        for byte, i in enumerate(self.bytes_at):
            self.id_scores[i] = 0 if 0x80 <= byte < 0xC0 else self.unknown  # a character's first byte stands for it
        for length in range(1, self.longest + 1):
            rows = []
            for p, (score, i) in self.scores.items():
                if len(p) == length:
                    h = 0
                    for c in p:
                        h = (h * int(_STEP) + ord(c) + 1) & (1 << 64) - 1
                    rows.append((h, score, i))
            rows.sort()
            cols = list(zip(*rows)) if rows else [(0,), (NONE,), (-1,)]
            self.tables[length] = (np.array(cols[0], np.uint64), np.array(cols[1], np.int64), np.array(cols[2], np.int64))

    def ids_of(self, piece: str) -> list[int]:
        hit = self.scores.get(piece)
        return [hit[1]] if hit else [self.bytes_at[b] for b in piece.encode()]

    def segment(self, s: str) -> list[int]:
        """Ids of the best segmentation of s."""
        best, back = self.forward(s, 0, len(s), len(s))
        return self.path(s, back, 0, len(s))

    def forward(self, s: str, begin: int, stop: int, reach: int) -> tuple[dict[int, int], dict[int, int]]:
        """Best score of each place up to ``reach`` from ``begin`` on, and the place before it; pieces begin before ``stop``."""
        best, back = {begin: 0}, {}
        get, longest, unknown = self.scores.get, self.longest, self.unknown
        for i in range(begin, stop):
            here = best.get(i)
            if here is None:
                continue
            for j in range(i + 1, min(reach, i + longest) + 1):
                hit = get(s[i:j])
                if hit is not None:
                    v = here + hit[0]
                elif j == i + 1:
                    v = here + unknown
                else:
                    continue
                if v > best.get(j, NONE):
                    best[j], back[j] = v, i
        return best, back

    def path(self, s: str, back: dict[int, int], begin: int, end: int) -> list[int]:
        cuts = [end]
        while cuts[-1] > begin:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        return [x for a, b in zip(cuts, cuts[1:]) for x in self.ids_of(s[a:b])]

    def segment_many(self, units: list[str]) -> None:
        """Put the ids of distinct short units into the memory; the search runs over all units of one length at once."""
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u) if len(u) <= 8 else -(-len(u) // 4) * 4, []).append(u)
        for n, same in by_length.items():
            rows = max(1, TOGETHER // n)
            for i in range(0, len(same), rows):
                self._segment_equal(same[i : i + rows], n)

    def _segment_equal(self, units: list[str], n: int) -> None:
        """Units of up to n characters; what is short of n is filled and not looked at."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join([u.ljust(n, "\0") for u in units]).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
        rows = len(units)
        best = np.full((n + 1, rows), NONE, np.int64)
        best[0] = 0
        size, ids = np.zeros((n + 1, rows), np.int64), np.zeros((n + 1, rows), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # by length of the piece: scores and ids, places by units
        h = np.zeros((n, rows), np.uint64)
        for length in range(1, min(n, self.longest) + 1):
            h = h[: n - length + 1] * _STEP + codes.T[length - 1 :] + np.uint64(1)
            keys, scores, numbers = self.tables[length]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            score = np.where(hit, scores[at], self.unknown if length == 1 else NONE)
            found.append((score, np.where(hit, numbers[at], -1)))
        for j in range(1, n + 1):
            for length in range(min(j, len(found)), 0, -1):  # earlier beginnings first: they win ties
                score, number = found[length - 1]
                v = best[j - length] + score[j - length]
                better = v > best[j]
                best[j] = np.where(better, v, best[j])
                size[j] = np.where(better, length, size[j])
                ids[j] = np.where(better, number[j - length], ids[j])
        out, count = np.full((rows, n), -2, np.int64), np.zeros(rows, np.int64)
        place, every = lengths.copy(), np.arange(rows)
        for k in range(n):
            live = np.flatnonzero(place > 0)
            if not len(live):
                break
            out[live, n - 1 - k] = ids[place[live], live]
            count[live] += 1
            place[live] -= size[place[live], live]
        plain = ~(out == -1).any(axis=1)
        flat = out.astype("<i4")
        for r in every.tolist():
            c = int(count[r])
            self.memo[units[r]] = flat[r, n - c :].tobytes() if plain[r] else np.array(self.segment(units[r]), "<i4").tobytes()

    def remember(self, units: list[str]) -> None:
        """See that all short units are in the memory."""
        new = [u for u in dict.fromkeys(units) if u not in self.memo and len(u) <= SHORT]
        if new:
            if len(self.memo) + len(new) > MEMO:  # what this batch uses stays
                self.memo = {u: self.memo[u] for u in dict.fromkeys(units) if u in self.memo}
            self.segment_many(new)

    def ids_of_units(self, units: list[str]) -> bytes:
        get = self.memo.get
        return b"".join([get(u) or np.array(self.segment(u), "<i4").tobytes() for u in units])

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of ordinary texts as little-endian 32-bit numbers."""
        out: list[bytes | None] = []
        for i in range(0, len(texts), 512):
            part = [None if t is None else self.unit.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts[i : i + 512]]
            self.remember([u for x in part if x for u in x])
            out += [None if x is None else self.ids_of_units(x) for x in part]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        if not ids:
            return ""
        table, out, raw = self.pieces, [], bytearray()
        for i in np.frombuffer(ids, "<i4").tolist():
            p = table[i]
            if isinstance(p, bytes):
                raw += p
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(p)
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        s = "".join(out).replace(MARK, " ")
        return s[1:] if s.startswith(" ") else s

    # --- giant documents

    # Every segmentation breaks where a blank mark follows another character. Between the first
    # and the last such break of a chunk its score is one number; only the ends have states.

    def breaks(self, s: str, start: int, end: int) -> tuple[int, int] | None:
        inner = [m.start() + 1 for m in _BREAK.finditer(s, start, end)]
        return (inner[0], inner[-1]) if inner else None

    def score_of(self, ids: bytes) -> int:
        return int(self.id_scores[np.frombuffer(ids, "<i4")].sum())

    def fan(self, s: str, start: int, stop: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place from ``start`` to ``reach`` and each entry state: the best score, and the place of its path among those of all states.

        The path whose last piece begins first comes first, of equal beginnings the one that comes
        first there; a piece that began before the chunk began first of all.
        """
        width, n, get = self.longest, reach - start + 1, self.scores.get
        best, rank = np.full((n, width), NONE, np.int64), np.zeros((n, width), np.int64)
        every = np.arange(width)
        for j in range(n):
            here, begin = best[j], np.full(width, n, np.int64)
            for i in range(max(0, j - width), min(j, stop - start)):
                hit = get(s[start + i : start + j])
                if hit is None and i < j - 1:
                    continue
                v = best[i] + (hit[0] if hit else self.unknown)
                better = v > here
                here[better], begin[better] = v[better], i
            if j < width:
                here[j], begin[j] = 0, -1
            key = begin * width + np.where((begin >= 0) & (begin < n), rank[np.minimum(begin, n - 1), every], 0)
            rank[j, np.argsort(key, kind="stable")] = every
        best[best <= NONE // 2] = NONE
        return best, rank

    def transfer(self, s: str, start: int, end: int) -> np.ndarray:
        """Two matrices from entry to exit states of the chunk s[start:end]: best scores, and for each exit the order of the entries' paths.

        State x at an edge: the segmentation first breaks x characters after the edge.
        """
        width, out = self.longest, np.zeros((2, self.longest, self.longest), np.int64)
        out[0] = NONE
        found = self.breaks(s, start, end)
        if not found:
            best, rank = self.fan(s, start, end, end + width - 1)
            n = min(width, len(s) - end + 1)
            out[0, :, :n], out[1, :, :n] = best[end - start : end - start + n].T, rank[end - start : end - start + n].T
            return out
        first, last = found
        units = self.unit.findall(s[first:last])
        self.remember(units)
        middle = self.score_of(self.ids_of_units(units))
        tails = self.forward(s, last, end, min(len(s), end + width - 1))[0]
        best, rank = self.fan(s, start, first, first)
        tail = np.array([tails.get(end + y, NONE) for y in range(width)], np.int64)
        out[0] = best[-1][:, None] + middle + tail[None, :]
        out[0][(best[-1] == NONE)[:, None] | (tail == NONE)[None, :]] = NONE
        out[1] = rank[-1][:, None]
        return out

    def backtrace(self, s: str, start: int, end: int, entry: int, leave: int) -> bytes:
        """Ids of the pieces that begin in s[start:end], from one state to the other."""
        found, a, b = self.breaks(s, start, end), start + entry, end + leave
        if a >= end:
            return b""
        if not found:
            return np.array(self.path(s, self.forward(s, a, end, b)[1], a, b), "<i4").tobytes()
        first, last = found
        units = self.unit.findall(s[first:last])
        self.remember(units)
        head = self.path(s, self.forward(s, a, first, first)[1], a, first)
        tail = self.path(s, self.forward(s, last, end, b)[1], last, b)
        return np.array(head, "<i4").tobytes() + self.ids_of_units(units) + np.array(tail, "<i4").tobytes()


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of transfers; associative. Equal sums go to the state whose path comes first."""
    width = a.shape[1]
    total = a[0][:, :, None] + b[0][None, :, :]
    order = np.where(total == total.max(axis=1, keepdims=True), b[1][None, :, :], width)
    via = order.argmin(axis=1)
    x, z = np.indices(via.shape)
    out = np.empty_like(a)
    out[0] = total[x, via, z]
    key = b[1][via, z] * width + a[1][x, via] + np.where(out[0] <= NONE // 2, width * width, 0)
    out[1] = np.argsort(np.argsort(key, axis=0, kind="stable"), axis=0, kind="stable")
    out[0][out[0] <= NONE // 2] = NONE
    return out


def entry_states(transfers: list[np.ndarray]) -> list[int]:
    """The state at every edge (one more than transfers) on the best path from state 0 to state 0."""
    width = transfers[0].shape[1]
    before = [np.where(np.arange(width) == 0, 0, NONE)]
    for m in transfers[:-1]:
        v = (before[-1][:, None] + m[0]).max(axis=0)
        before.append(np.where(v <= NONE // 2, NONE, v))
    states = [0]
    for m, v in zip(reversed(transfers), reversed(before)):
        total = v + m[0][:, states[-1]]
        states.append(int(np.where(total == total.max(), m[1][:, states[-1]], width).argmin()))
    return states[::-1]


_loaded: dict[int, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """Kept for the worker's life, with its memory of units."""
    k = hash(model)
    if k not in _loaded:
        _loaded.clear()
        _loaded[k] = Vocabulary.load(model)
    return _loaded[k]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _giants(giant: DataFrame, shared, chunk: int, scratch: Scratch) -> DataFrame:
    """(sp_row, ids) of giant texts; rows of ``giant`` are (sp_row, text)."""
    width = shared.value[1]
    total = giant.agg(F.sum(F.ceil((F.length("text") + 1) / F.lit(chunk)))).first()[0] or 0
    tasks = max(1, -(-total // CHUNKS_A_TASK))  # told, as chunks have few bytes for their work

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = MARK + text.replace(" ", MARK)
                for k, at in enumerate(range(0, len(s), chunk)):  # the pieces that begin in a chunk may reach beyond it
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([min(chunk, len(s) - at)], pa.int32()), pa.array([s[at : at + chunk + width]])], ["sp_row", "k", "n", "part"])

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value[0])
        for b in batches:
            m = [v.transfer(p, 0, n).tobytes() for n, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(m, pa.binary())], ["sp_row", "k", "n", "part", "m"])
        K.give_back()

    cut = giant.mapInArrow(split, "sp_row long, k int, n int, part string").repartition(tasks, "sp_row", "k")
    chunks = scratch.write(cut.mapInArrow(transfers, "sp_row long, k int, n int, part string, m binary"), "chunks")
    # one matrix a chunk (4 KB for 16,384 characters): a document's matrices meet in one task
    per_doc = chunks.groupBy("sp_row").agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("ms"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, ms in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                st = entry_states([np.frombuffer(x["m"], np.int64).reshape(2, width, width) for x in ms])
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(ms), pa.int64()), pa.array([x["k"] for x in ms], pa.int32()), pa.array(st[:-1], pa.int32()), pa.array(st[1:], pa.int32())], ["sp_row", "k", "enter", "leave"])

    states = per_doc.mapInArrow(scan, "sp_row long, k int, enter int, leave int").repartition(tasks, "sp_row", "k")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value[0])
        for b in batches:
            rows = zip(*[b.column(i).to_pylist() for i in range(2, 6)])
            ids = [v.backtrace(p, 0, n, e, x) for n, p, e, x in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], ["sp_row", "k", "ids"])
        K.give_back()

    met = chunks.select("sp_row", "k", "n", "part").repartition(tasks, "sp_row", "k").join(states, ["sp_row", "k"]).select("sp_row", "k", "n", "part", "enter", "leave")
    parts = met.mapInArrow(trace, "sp_row long, k int, ids binary").groupBy("sp_row").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join([x["ids"] for x in p]) for p in b.column(1).to_pylist()], pa.binary())], ["sp_row", "ids"])

    return parts.mapInArrow(join, "sp_row long, ids binary")


def encode(docs: DataFrame, text: str = "text", out: str = "sp_ids", model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """docs with column ``out``: ids as little-endian 32-bit numbers in a binary (null for null).

    Documents under ``giant`` characters are a map over the rows. Giant ones are cut out,
    scanned over the cluster by chunks and put back with a union.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = frames.without(docs, out)
    raw = read_model(model)
    shared = spark.sparkContext.broadcast((raw, Vocabulary.load(raw).longest))
    big = F.length(frames.col(text)) >= giant
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        v = vocabulary(shared.value[0])
        for b in batches:
            yield [pa.array(v.encode_all(b.column(at).to_pylist()), pa.binary())]
        K.give_back()

    ordinary = frames.mapped(docs.where(~F.coalesce(big, F.lit(False))), run, **{out: "binary"})
    scratch = Scratch(spark)
    large = scratch.write(docs.where(big).select(F.monotonically_increasing_id().alias("sp_row"), F.struct(*[frames.col(c) for c in docs.columns]).alias("row")), "giant")
    ids = _giants(large.select("sp_row", F.col("row").getField(text).alias("text")), shared, chunk, scratch)
    giants = large.join(ids, "sp_row").select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("ids").alias(out))
    return ordinary.unionAll(giants)


def decode(encoded: DataFrame, ids: str = "sp_ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """encoded with column ``out``: the text of the ids. A map over the rows."""
    spark = encoded.sparkSession
    bound_batches(spark)
    encoded = frames.without(encoded, out)
    shared = spark.sparkContext.broadcast(read_model(model))
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        v = vocabulary(shared.value)
        for b in batches:
            texts = [None if x is None else v.decode(x) for x in b.column(at).to_pylist()]
            yield [pa.array(texts, pa.string())]
        K.give_back()

    return frames.mapped(encoded, run, **{out: "string"})


def token_report(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and round_trip of every row."""
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    both = decode(encode(src, **options))
    return both.select(
        "doc_id",
        F.expr("cast(octet_length(sp_ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("sp_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
