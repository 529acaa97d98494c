"""SimHash near-duplicates (operator 9).

A fingerprint has 64 bits; fingerprints that differ in at most two bits are linked, and
linked ones form components. A fingerprint is cut into two segments of 32 bits: of two
linked fingerprints one segment differs in at most one bit, so both have an equal
signature (segment, deleted bit, the other 31 bits). Signatures are joined by equality and
verified. The work is on distinct fingerprints, so groups of equal texts cost one row.

A signature shared by more than ``BUCKET`` fingerprints is not joined with itself: its
fingerprints are linked exactly another way, through the values at distance one. Two
fingerprints at distance two or less have such a value in common, and all that share one
are within distance two of each other, so a star replaces all pairs.

``similar_firsts`` is the same method for a similarity instead of a number of bits: five-word
shingles, longer fingerprints cut into more segments, and a link wherever the sets of shingles
have a Jaccard similarity of 0.8 or more, decided on the whole sets.

Defined cases: a null or empty text has fingerprint zero and is linked like any other;
texts of one or two words are hashed whole; rows with a null id are fingerprinted, and the
component id is the smallest id that is not null (null if there is none); repeated rows
stay; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaflux.llm import kernels as K
from viaflux.operators.components import connected_components
from viaflux.storage import Scratch, bound_batches

SHINGLE = 3
SEED = 42
#: Signatures with more fingerprints than this are linked through common neighbours.
BUCKET = 8


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a text whose letters A-Z are lowered already."""
    words = text.split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    xx, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - k + 1
    for i in range(0, n, 4096):
        j = min(n, i + 4096)
        h = np.array([xx(joined[a:b], seed) for a, b in zip(starts[i:j].tolist(), (ends[i + k - 1 : j + k - 1] - 1).tolist())], np.uint64)
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = K.views(b.column(1))
            raw, cuts = K.LOWER[data].tobytes(), offs.tolist()
            fp = np.array([fingerprint(raw[s:e], shingle) for s, e in zip(cuts, cuts[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
        K.give_back()

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def _bit(i: Column) -> Column:
    """A long with bit i set; Spark's shift takes a literal or column of ints."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _signatures() -> Column:
    """64 longs: which segment and bit was deleted, made one with the rest of the segment by a hash."""
    mask = F.lit(0xFFFFFFFF).cast("long")

    def one(i: Column) -> Column:
        i = i.cast("int")
        segment = F.when(i < 32, F.col("fp").bitwiseAND(mask)).otherwise(F.shiftrightunsigned(F.col("fp"), 32))
        rest = segment.bitwiseAND(F.bitwise_not(_bit(F.pmod(i, F.lit(32)).cast("int"))))
        # 32 bits of the segment (one is zero) above 6 bits of the variant: a bijection, no hash needed
        return F.call_function("shiftleft", rest, F.lit(6)).bitwiseOR(i.cast("long"))

    return F.transform(F.sequence(F.lit(0), F.lit(63)), one)


def _spread(rows: DataFrame, share: int) -> DataFrame:
    """rows in partitions of about ``share`` rows: few bytes become many rows behind it, so Spark must be told how many tasks."""
    return rows.repartition(max(1, -(-rows.count() // share)))


def links(distinct: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(a, b) pairs of distinct fingerprints within two bits that connect what is connected."""
    signed = _spread(distinct, 4_000_000 // 64).select("fp", F.explode(_signatures()).alias("sig"))
    # what is aggregated from a side of a join is written first, so that both sides are plain shuffles: a hot key can be split
    sizes = scratch.write(signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "sizes")
    shared = scratch.write(signed.join(sizes, "sig").select("sig", "fp", "n"), "signatures")
    small = shared.where(F.col("n") <= bucket).select("sig", "fp")
    pairs = (
        small.alias("x")
        .join(small.alias("y"), F.col("x.sig") == F.col("y.sig"))
        .where((F.col("x.fp") < F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
        .distinct()
    )
    dense = shared.where(F.col("n") > bucket).select("fp").distinct()
    around = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(_bit(i.cast("int")))))
    near = scratch.write(dense.select("fp", F.explode(around).alias("z")), "neighbours")
    centres = scratch.write(near.groupBy("z").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("z", "a"), "centres")
    stars = near.join(centres, "z").where(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars).distinct()


def components(fps: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for written (doc_id, fp)."""
    distinct = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    edges = scratch.write(links(distinct.select("fp"), scratch, bucket), "links")
    labels = connected_components(edges, scratch)
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    named = scratch.write(named, "named")
    smallest = scratch.write(named.groupBy("label").agg(F.min("first_id").alias("component_id")), "smallest")
    final = scratch.write(named.join(smallest, "label").select("fp", "component_id"), "final")
    return fps.join(final, "fp")


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    scratch = Scratch(docs.sparkSession)
    fps = scratch.write(fingerprints(docs, key, text, shingle), "fingerprints")
    out = components(fps, scratch, bucket)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- by similarity

#: Words of a shingle, and the least Jaccard similarity that links, as numerator and denominator.
WIDE = 5
SIMILARITY = (4, 5)
#: Segments of a fingerprint, bits of each, and variants of each: the bits that are deleted are the ``WEAK`` ones with the closest vote,
#: as those are the ones that differ between similar texts. Two texts of similarity s differ in a bit with probability
#: acos(2s / (1 + s)) / pi; they are found if a segment differs in one weak bit at most: about 92 % of pairs at exactly 0.8, 98 % at
#: 0.825, all but 1 in 1000 from 0.875 on. Random texts meet once in 10**5 pairs; some 10**8 distinct texts take longer segments and more of them.
SEGMENTS, BITS, WEAK = 48, 24, 6
#: Pairs of long texts whose fingerprints differ in more bits than this share are not compared (at a similarity of 0.8 it is 0.15, nine deviations less).
FAR = 0.25
LONG_ENOUGH = 40
#: Shingles are counted in so many passes, each over a share of them, so that little of them is in a shuffle at a time.
PASSES = 4
_LANES = -(-SEGMENTS * BITS // 64)


def wide_shingles(data: np.ndarray, offs: np.ndarray, k: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of lowered texts, and each row's first shingle (one more than rows); a row of fewer words is one shingle."""
    starts, ends, first = K.word_spans(data, offs, K.SPACES)
    values = K.span_hashes(data, starts, ends)
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    cuts = np.concatenate(([0], np.cumsum(count)))
    row = np.repeat(np.arange(len(n)), count)
    at = first[:-1][row] + np.arange(len(row)) - cuts[:-1][row]
    out = np.zeros(len(row), K.U64)
    whole = n[row] >= k
    out[whole] = K.window_hashes(values, k)[at[whole]]
    for i in np.flatnonzero(~whole).tolist():
        h = K.U64(n[row[i]])
        for v in values[first[row[i]] : first[row[i] + 1]]:
            h = K.mix(np.array([h ^ v]) * K.U64(0xA0761D6478BD642F))[0]
        out[i] = h
    return out, cuts


def wide_fingerprint(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments of the fingerprint of distinct shingles, and their weak bits (5 bits each); two segments in a number."""
    lanes = np.stack([K.mix(items ^ K.U64(0x6A09E667F3BCC909 * (2 * i + 1) & (1 << 64) - 1)) for i in range(_LANES)], axis=1)
    total = np.zeros(64 * _LANES, np.int64)
    for i in range(0, len(items), 255):
        total += np.add.reduce(np.unpackbits(lanes[i : i + 255].view(np.uint8).reshape(-1, 8 * _LANES), axis=1), axis=0, dtype=np.uint8)
    votes = (2 * total - len(items))[: SEGMENTS * BITS].reshape(SEGMENTS, BITS)
    place = np.arange(BITS, dtype=np.int64)
    weak = np.argsort(np.abs(votes) * 32 + place, axis=1)[:, :WEAK] @ (1 << 5 * np.arange(WEAK, dtype=np.int64))
    two = lambda x, n: x[0::2] | x[1::2] << n
    return two((votes > 0) @ (1 << place), BITS), two(weak, 5 * WEAK)


def wide_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, words: digest of the word sequence, n: distinct shingles, fp, weak)."""
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = K.views(b.column(1))
            for i, j in K.pieces(offs):
                low, cuts = K.LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
                h, first = wide_shingles(low, cuts)
                sets = [np.unique(h[s:e]) for s, e in zip(first.tolist(), first[1:].tolist())]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * (SEGMENTS // 2), pa.int32()), pa.array(np.concatenate(x))) for x in zip(*[wide_fingerprint(x) for x in sets])]
                raw, at = low.tobytes(), cuts.tolist()
                words = [hashlib.sha256(b" ".join(raw[s:e].split())).digest() for s, e in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(words, pa.binary()), pa.array([len(x) for x in sets], pa.int32()), *lists], ["id", "words", "n", "fp", "weak"])
        K.give_back()

    return src.mapInArrow(run, "id long, words binary, n int, fp array<long>, weak array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, items) of docs(id, text): the distinct shingles of each text in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = K.views(b.column(1))
            for i, j in K.pieces(offs):
                h, first = wide_shingles(K.LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i])
                sets = [np.sort(np.unique(h[s:e]).view(np.int64)) for s, e in zip(first.tolist(), first[1:].tolist())]
                cuts = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(sets)))], ["id", "items"])
        K.give_back()

    return docs.select("id", "text").mapInArrow(run, "id long, items array<long>")


def own_shingles(sets: DataFrame, scratch: Scratch, passes: int = PASSES) -> DataFrame:
    """(id, q): how many shingles of a set are in no other one, where there are any; each pass shuffles its share of all shingles."""
    parts = []
    for i in range(passes):
        items = sets.select("id", F.explode("items").alias("item")).where(F.pmod("item", F.lit(passes)) == i)
        once = items.groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
        parts.append(scratch.write(once.groupBy("id").agg(F.count(F.lit(1)).alias("q")), "own"))
    return scratch.write(reduce(DataFrame.unionAll, parts).groupBy("id").agg(F.sum("q").cast("int").alias("q")), "own")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are similar enough."""
    side = lambda c, x: sets.select(F.col("id").alias(c), F.col("items").alias(x))
    joined = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    over, under = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, p), (y, q) = [(c.flatten().to_numpy(), np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy())))) for c in (b.column(2), b.column(3))]
            keep = np.zeros(b.num_rows, bool)
            for r in range(b.num_rows):
                n, m = p[r + 1] - p[r], q[r + 1] - q[r]
                if min(n, m) * under >= max(n, m) * over:
                    both = len(np.intersect1d(x[p[r] : p[r + 1]], y[q[r] : q[r + 1]], assume_unique=True))
                    keep[r] = both * under >= (n + m - both) * over
            yield b.select(["a", "b"]).filter(pa.array(keep))
        K.give_back()

    return joined.mapInArrow(run, "a long, b long")


def wide_signatures(rows: DataFrame, segments: range) -> DataFrame:
    """(sig, id): of each segment the variants with one weak bit deleted; segment, bit and the rest are packed into one number."""

    def cut(c: str, i: int, bits: int) -> Column:
        return F.shiftrightunsigned(F.col(c)[i // 2], bits * (i % 2)).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    one = rows.select("id", F.explode(F.array(*[F.struct(F.lit(i << (BITS + 5)).cast("long").alias("tag"), cut("fp", i, BITS).alias("seg"), cut("weak", i, 5 * WEAK).alias("weak")) for i in segments])).alias("s"))
    bit = F.explode(F.array(*[F.shiftrightunsigned(F.col("s.weak"), 5 * j).bitwiseAND(F.lit(31).cast("long")) for j in range(WEAK)]))
    v = one.select("id", "s.tag", "s.seg", bit.alias("j"))
    rest = F.col("seg").bitwiseAND(F.bitwise_not(_bit(F.col("j").cast("int"))))
    return v.select(F.col("tag").bitwiseOR(F.shiftleft("j", BITS)).bitwiseOR(rest).alias("sig"), "id")


def _near(x: str, y: str) -> Column:
    """Whether the fingerprints of two rows are not far apart, or their texts are too short to tell."""
    apart = sum((F.bit_count(F.col(f"{x}.fp")[i].bitwiseXOR(F.col(f"{y}.fp")[i])) for i in range(SEGMENTS // 2)), F.lit(0))
    return (apart <= int(FAR * SEGMENTS * BITS)) | (F.least(f"{x}.n", f"{y}.n") < LONG_ENOUGH)


def shared_signatures(signed: DataFrame) -> DataFrame:
    """(sig, id, c) of signed(sig, id): the signatures that c texts share, c > 1; of those with the same texts only the smallest one.

    The texts of a signature are told by their number and two 64-bit sums of their hashes.
    """
    same = Window.partitionBy("sig")
    counted = signed.withColumn("c", F.count(F.lit(1)).over(same)).where("c > 1")  # hashes after it, so that they are not shuffled
    of = {"g": F.bit_xor(F.xxhash64("id")).over(same), "h": F.bit_xor(F.xxhash64("id", F.lit(1))).over(same)}
    return counted.withColumns(of).groupBy("c", "g", "h", "id").agg(F.min("sig").alias("sig")).select("sig", "id", "c")


def _each(rows: DataFrame, share: int = 8000) -> DataFrame:
    """rows with ``sig``, each of their list ``sigs``, in partitions of about ``share`` signatures however many a text has."""
    n = rows.agg(F.sum(F.size("sigs"))).first()[0] or 0
    return rows.repartition(max(1, -(-n // share))).withColumn("sig", F.explode("sigs")).drop("sigs")


def weak_masks(weak: Column) -> Column:
    """The weak bits of each two segments as set bits, placed as the segments of ``fp`` are."""
    one = F.lit(1).cast("long")

    def two(w: Column) -> Column:
        bits = [F.call_function("shiftleft", one, (F.shiftrightunsigned(w, 5 * i).bitwiseAND(F.lit(31).cast("long")) + i // WEAK * BITS).cast("int")) for i in range(2 * WEAK)]
        return reduce(Column.bitwiseOR, bits)

    return F.transform(weak, two)


def _first_shared() -> Column:
    """Whether ``x.sig`` is the smallest signature that x and y share, from their fingerprints and masks alone."""
    mask, (segment, bit) = F.lit((1 << BITS) - 1).cast("long"), (F.shiftrightunsigned("x.sig", BITS + 5).cast("int"), F.shiftrightunsigned("x.sig", BITS).bitwiseAND(F.lit(31).cast("long")).cast("int"))

    def earlier(i: Column) -> Column:
        lane, place = F.call_function("shiftright", i, F.lit(1)), i.bitwiseAND(F.lit(1)) * BITS
        cut = lambda op, c: F.call_function("shiftrightunsigned", getattr(F.col(f"x.{c}")[lane], op)(F.col(f"y.{c}")[lane]), place).bitwiseAND(mask)
        apart, both = cut("bitwiseXOR", "fp"), cut("bitwiseAND", "mask")
        shared = F.when(apart == 0, both).when(F.bit_count(apart) == 1, both.bitwiseAND(apart)).otherwise(F.lit(0).cast("long"))
        return shared.bitwiseAND(F.when(i == segment, _bit(bit) - 1).otherwise(mask)) != 0

    return ~F.exists(F.sequence(F.lit(0), segment), earlier)


def pairs_apart(apart: DataFrame) -> DataFrame:
    """(a, b), once each: the pairs of apart(sig, id, n, s, label, fp, mask) of one signature and different labels that may be similar.

    A pair that shares many signatures is made in the smallest of them only.
    """
    x, y = apart.alias("x"), apart.alias("y")
    wanted = (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & _possible(F.col("x.n"), F.col("x.s"), F.col("y.n"), F.col("y.s")) & _near("x", "y") & _first_shared()
    return x.join(y, (F.col("x.sig") == F.col("y.sig")) & wanted).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _close(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """The near ones of pairs (a, b)."""
    x, y = about.select("id", "n", "fp").alias("x"), about.select("id", "n", "fp").alias("y")
    return pairs.join(x, F.col("a") == F.col("x.id")).join(y, (F.col("b") == F.col("y.id")) & _near("x", "y")).select("a", "b")


def _possible(n: Column, s: Column, m: Column, t: Column) -> Column:
    """Whether sets of n and m shingles, of which s and t occur in any other text at all, can be similar enough."""
    over, under = SIMILARITY
    both = F.least(s, t)
    return both * under >= (n + m - both) * over


def _merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of labels(node, label) and more links(a, b); a component that is known takes part as a star."""
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return connected_components(scratch.write(known.unionByName(links), "links"), scratch)


def similar_firsts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id): of each component of similar texts the smallest key. ``docs`` is a written table with distinct integer keys.

    Words as for fingerprints; a text of less than five words is one shingle; null, empty and blank
    texts are copies of each other; equal word sequences cost one row.

    Of a text that shares a signature, the shingles that no other such text has are counted: they
    bound its similarity to any other, and most texts that are like others but not like enough end there.
    Signatures with the same texts count once. Two texts that are alone with a signature are a pair at
    once; if they are far apart, a signature that agrees by chance costs them neither sets nor shingles.
    Else the members of a signature are compared with the one of them that has the fewest such shingles; then
    those of different components that the bound allows are compared with each other. So a large
    group of near copies needs no pairs, and no pair that could link two components is left out.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.write(wide_rows(docs, key, text), "wide")
    one = signed.groupBy("words").agg(F.min(F.struct("id", "n", "fp", "weak")).alias("e"))
    rows = scratch.write(one.select("e.id", "e.n", "e.fp", "e.weak"), "rows")
    scratch.drop(signed)
    spread = _spread(rows.where("n > 0"), 4_000_000 // (SEGMENTS * WEAK))
    parts = []
    for half in (range(SEGMENTS // 2), range(SEGMENTS // 2, SEGMENTS)):  # two passes hold half of the shuffle at a time
        parts.append(scratch.write(shared_signatures(wide_signatures(spread, half)), "shared"))
    shared = parts[0].unionByName(parts[1])
    alone = scratch.write(shared.where("c = 2").groupBy("sig").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b").distinct(), "alone")
    two = scratch.write(_close(alone, rows), "two")
    several = scratch.write(shared.where("c > 2").groupBy("id").agg(F.collect_list("sig").alias("sigs")), "several")  # 288 of a text at most
    members = scratch.write(two.select(F.explode(F.array("a", "b")).alias("id")).unionByName(several.select("id")).distinct(), "members")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sets = scratch.write(shingle_sets(texts.join(members, "id", "left_semi")), "sets")
    own = own_shingles(sets, scratch)
    about = rows.select("id", "n", "fp", weak_masks(F.col("weak")).alias("mask")).join(members, "id", "left_semi").join(own, "id", "left").withColumn("s", F.col("n") - F.coalesce("q", F.lit(0)))
    about = scratch.write(about.where(_possible(F.col("n"), F.col("s"), F.col("s"), F.col("s"))).select("id", "n", "s", "fp", "mask"), "about")
    scratch.drop(*parts, alone, sets)
    sets = scratch.write(shingle_sets(texts.join(scratch.write(about.select("id"), "ids"), "id", "left_semi")), "sets")  # few of all, made again

    # what is known of a text is joined to its list of signatures, one row a text, and not to each of them
    alive, same = scratch.write(several.join(about.select("id", "n", "s"), "id"), "alive"), Window.partitionBy("sig")
    pivot = F.min(F.struct((F.col("n") - F.col("s")) / F.col("n"), F.col("id").alias("a"), F.col("n").alias("m"), F.col("s").alias("t"))).over(same)
    pairs = _each(alive).withColumn("p", pivot).where((F.col("id") != F.col("p.a")) & _possible(F.col("n"), F.col("s"), F.col("p.m"), F.col("p.t")))
    x, y = about.select("id", "n", "s").alias("x"), about.select("id", "n", "s").alias("y")
    two = two.join(x, F.col("a") == F.col("x.id")).join(y, (F.col("b") == F.col("y.id")) & _possible(F.col("x.n"), F.col("x.s"), F.col("y.n"), F.col("y.s"))).select("a", "b")
    tried = scratch.write(pairs.select(F.least("id", "p.a").alias("a"), F.greatest("id", "p.a").alias("b")).unionByName(two).distinct(), "tried")
    # one pair of each text first: what it connects makes most of the others needless
    links = scratch.write(verified(_close(tried.groupBy("b").agg(F.min("a").alias("a")), about), sets), "links")
    labels = connected_components(links, scratch)
    side = lambda c, x: labels.select(F.col("node").alias(c), F.col("label").alias(x))
    rest = tried.join(side("a", "x"), "a", "left").join(side("b", "y"), "b", "left").where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")
    labels = _merged(labels, verified(_close(rest, about), sets), scratch)
    named = scratch.write(alive.join(labels, alive["id"] == labels["node"], "left").select("id", F.coalesce("label", "id").alias("label"), "sigs"), "named")
    mixed = _each(named).withColumns({"lo": F.min("label").over(same), "hi": F.max("label").over(same), "c": F.count(F.lit(1)).over(same)}).where("lo < hi AND c > 2")
    mixed = scratch.write(mixed.groupBy("id", "label").agg(F.collect_list("sig").alias("sigs")), "mixed")
    apart = scratch.write(_each(mixed.join(about, "id")).select("sig", "id", "n", "s", "label", "fp", "mask"), "apart")
    scratch.drop(alive, named, mixed)
    # a signature of two members is not among them: its pair was tried
    fresh = scratch.write(pairs_apart(apart).join(tried, ["a", "b"], "left_anti"), "fresh")
    if not fresh.isEmpty():
        labels = _merged(labels, verified(fresh, sets), scratch)
    return rows.select("id").join(labels.where("node <> label").select(F.col("node").alias("id")), "id", "left_anti")
