"""Near duplicates by SimHash fingerprints and one-wildcard segment variants.

A fingerprint of 64 bits links to another when at most ``bits`` (3) differ.
Cut into two segments, one of them then differs in at most one bit. So the
distinct segment values are indexed with each bit deleted in turn: two values
that meet under a variant differ in exactly that bit (values are distinct, so a
variant holds two at most). Fingerprints whose segment is equal, or met, are
joined by equality and verified on all 64 bits.

Scale. Copies collapse to one fingerprint before anything is joined. Where many
fingerprints share a segment, pairing them would grow with the square of the
group, so such groups link through *balls* instead: two values at distance 2 at
most share a value at distance 1 of both, and everyone around that value is
linked by triangle inequality. A member emits one row per value of its ball
whatever the size of the group. Both ways give the same components; the
way is chosen by which emits fewer rows. No link between different
fingerprints is lost and no group is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.llm.common import MARK_BITS, discard, release, saved, text_bytes, text_of, with_mark
from landloom.operators.components import connected_components

WORDS = 3
BITS = 3
HALF = 32
SEED = 42
SLICE = 1 << 15
FEW_WORDS = 20
#: Texts that the order of shingles is taken from, shingles it tells apart, and heads at a shingle in the first round and a later one.
SAMPLED, COMMON, FIRST_HEADS, HEADS = 4096, 200_000, 8, 64
#: A round may make a pair for so many of the first postings, whatever ``HEADS`` says.
POSTINGS_A_PAIR = 8
#: Bits of a shared shingle in its bitmap, and of the bitmap at most.
BITS_A_KEY, MOST_BITS = 8, 1 << 26
#: Bins of a text's shingle counts, and the count that stands for itself and all above.
BINS, FULL = 256, 255


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash (signed) of the word shingles of ``text``; 0 if it has no word."""
    parts = text.lower().split()
    if not parts:
        return 0
    wide = min(words, len(parts))
    counts = np.zeros(64, dtype=np.int64)
    total = len(parts) - wide + 1
    digest = xxhash.xxh64_digest
    for at in range(0, total, SLICE):
        own = parts[at : min(total, at + SLICE) + wide - 1]
        shingles = map(b" ".join, zip(*[own[i:] for i in range(wide)]))
        hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=np.uint8)
        counts += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    bits = np.packbits(counts * 2 > total)
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, text_key, fp`` per row; ``text_key`` tells rows of one id apart.

    ``A-Z`` are lower-cased; words are runs of non-white characters; fewer words
    than a shingle give one shingle of all; null and empty texts give 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, words) for t in text_bytes(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("t"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _halves(fps: DataFrame) -> DataFrame:
    """``seg, val, rest, fp``: both halves of each fingerprint, and the other half."""
    high, low = F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    both = F.array(F.struct(F.lit(0).alias("seg"), high.alias("val"), low.alias("rest")), F.struct(F.lit(1).alias("seg"), low.alias("val"), high.alias("rest")))
    return fps.select("fp", F.explode(both).alias("h")).select("h.seg", "h.val", "h.rest", "fp")


def _bit(pos: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), pos.cast("int"))


def _neighbours(values: DataFrame) -> DataFrame:
    """``seg, a, b`` of distinct segment values that differ in exactly one bit.

    The variant key is (segment, place, value without the bit at that place).
    """
    pos = values.select("seg", "val", F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))).alias("pos"))
    without = F.col("val").bitwiseAND(F.bitwise_not(_bit(F.col("pos"))))
    place = F.call_function("shiftleft", (F.col("seg") * HALF + F.col("pos")).cast("long"), F.lit(HALF))
    met = pos.select(place.bitwiseOR(without).alias("key")).groupBy("key").count().where("count = 2")
    at = F.shiftrightunsigned("key", HALF)
    least = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    return met.select(F.floor(at / HALF).cast("int").alias("seg"), least.alias("a"), least.bitwiseOR(_bit(at % HALF)).alias("b"))


def _ball(value: Column, radius: int) -> Column:
    """Array of ``(x, d)``: all half values at distance ``d`` of at most ``radius``."""
    places = F.sequence(F.lit(0), F.lit(HALF - 1))
    flip = lambda v, p: v.bitwiseXOR(_bit(p))
    item = lambda x, d: F.struct(x.alias("x"), F.lit(d).alias("d"))
    out = [F.array(item(value, 0)), F.transform(places, lambda p: item(flip(value, p), 1))]
    if radius == 2:
        twice = F.transform(
            F.sequence(F.lit(0), F.lit(HALF - 2)),
            lambda p: F.transform(F.sequence(p + 1, F.lit(HALF - 1)), lambda q: item(flip(flip(value, p), q), 2)),
        )
        out.append(F.flatten(twice))
    return F.concat(*out)


def _stars(rows: DataFrame, keys: list[str], center: Column) -> DataFrame:
    """Edges of every row to the least ``center`` of its key; keys without a center give none."""
    heart = rows.groupBy(*keys).agg(F.min(center).alias("v"), F.count(F.lit(1)).alias("_n")).where("v IS NOT NULL AND _n > 1")
    return rows.join(heart, keys).select(F.col("fp").alias("u"), "v").where("u <> v").distinct()


def components(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """``fp, root`` for distinct fingerprints ``fp``: linked ones share a root."""
    found, edges = linked_components(fps, bits)
    discard(edges)
    return found


def linked_components(fps: DataFrame, bits: int = BITS, named: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """``(fp, root)`` and the links ``u, v`` it was found by.

    Unless ``named``, roots are looked for only where crowded groups need them to find their links.
    """
    if bits != 3:
        raise ValueError("segments and balls are laid out for 3 bits")
    members = saved(_halves(fps), "halves")
    sizes = saved(members.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n")), "sizes")
    size = lambda side: sizes.select("seg", F.col("val").alias(side), F.col("n").alias(f"n{side}"))
    met = _neighbours(sizes).join(size("a"), ["seg", "a"]).join(size("b"), ["seg", "b"])
    same = sizes.where("n > 1").select("seg", F.col("val").alias("a"), F.col("val").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb"))
    met = saved(met.select(*same.columns).unionByName(same), "met")
    few = F.col("na") * F.col("nb") <= HALF * (F.col("na") + F.col("nb"))

    left = met.where(few).join(members.select("seg", F.col("val").alias("a"), F.col("fp").alias("u")), ["seg", "a"])
    both = left.join(members.select("seg", F.col("val").alias("b"), F.col("fp").alias("v")), ["seg", "b"])
    edges = both.where((F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits) & (F.col("u") != F.col("v"))).select("u", "v")

    many = met.where(~few)
    crowded = not many.isEmpty()

    def one_bit_stars(pairs: DataFrame) -> DataFrame:
        """Links over shared values at distance 1 of the other half, within a segment or across two that met."""
        side = lambda n, c: F.struct(F.lit(n).alias("side"), F.col(c).alias("val"))
        sides = F.when(F.col("a") == F.col("b"), F.array(side(0, "a"))).otherwise(F.array(side(0, "a"), side(1, "b")))
        placed = pairs.select("seg", "a", "b", F.explode(sides).alias("m")).select("seg", "a", "b", "m.side", "m.val")
        rows = placed.join(members, ["seg", "val"]).select("seg", "a", "b", "side", "fp", F.explode(_ball(F.col("rest"), 1)).alias("k"))
        rows = rows.select("seg", "a", "b", "side", "fp", F.col("k.x").alias("x"))
        keys = ["seg", "a", "b", "x"]
        heart = rows.groupBy(*keys).agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("_n"), F.min("side").alias("_s0"), F.max("side").alias("_s1"))
        heart = heart.where("_n > 1 AND (a = b OR _s0 < _s1)").select(*keys, "v")
        return rows.join(heart, keys).select(F.col("fp").alias("u"), "v").where("u <> v").distinct()

    if crowded:
        edges = edges.unionByName(one_bit_stars(many.where("a = b")))
    edges = saved(edges, "edges")
    if not (named or crowded):
        discard(members, sizes, met)
        return None, edges
    linked = connected_components(edges)
    found = fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    found = saved(found, "found")
    if not crowded:
        discard(members, sizes, met)
        return found, edges

    # What is left to find between crowded groups matters only where their
    # members are not in one component yet: two bits across segments that met,
    # three inside one.
    def spans(pairs: DataFrame) -> DataFrame:
        """``pairs`` whose members have more than one root."""
        placed = members.join(found, "fp").groupBy("seg", "val").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
        at = lambda c: placed.select("seg", F.col("val").alias(c), F.col("r0").alias(f"{c}0"), F.col("r1").alias(f"{c}1"))
        both = pairs.join(at("a"), ["seg", "a"]).join(at("b"), ["seg", "b"])
        return both.where("least(a0, b0) < greatest(a1, b1)").select(*pairs.columns)

    open_pairs = saved(spans(many), "open")
    across = one_bit_stars(open_pairs.where("a <> b"))
    roots = found.select(F.col("fp").alias("u"), F.col("root").alias("ru")), found.select(F.col("fp").alias("v"), F.col("root").alias("rv"))
    across = across.join(roots[0], "u").join(roots[1], "v").select(F.col("ru").alias("u"), F.col("rv").alias("v")).where("u <> v").distinct()
    placed = open_pairs.where("a = b").select("seg", F.col("a").alias("val")).join(members, ["seg", "val"]).join(found, "fp")
    rows = placed.select("seg", "val", F.col("root").alias("fp"), F.explode(_ball(F.col("rest"), 2)).alias("k"))
    rows = rows.groupBy("seg", "val", F.col("k.x").alias("x"), "fp").agg(F.min("k.d").alias("d"))
    more = saved(across.unionByName(_stars(rows, ["seg", "val", "x"], F.when(F.col("d") <= 1, F.col("fp")))), "more")
    discard(members, sizes, met, open_pairs)
    if more.isEmpty():
        return found, edges
    again = connected_components(more).select(F.col("node").alias("root"), F.col("root").alias("_top"))
    found = saved(found.join(again, "root", "left").select("fp", F.coalesce("_top", "root").alias("root")), "found")
    both = saved(edges.unionByName(more), "edges")
    discard(edges, more)
    return found, both


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """``doc_id, text_key, fingerprint, component_id`` per input row.

    ``component_id`` is the smallest id reachable over links (null only
    where every id of the component is null). Rows without words have
    fingerprint zero and link like any others. Repeated rows stay.
    """
    rows = saved(fingerprints(docs, id_col, text_col, words), "fingerprints")
    fps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    placed = components(fps.select("fp"), bits).join(fps, "fp")
    tops = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(tops, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select("doc_id", "text_key", hexed.alias("fingerprint"), "component_id")


def set_fingerprints(text: bytes, seeds: tuple[int, ...]) -> list[int]:
    """SimHashes (signed) of the distinct words of a text, one per seed.

    Changing one word in fifty leaves four fifths of the five-word shingles, but
    nearly all words, so similar texts come within three bits. Texts with few
    distinct words are told apart by their three-word shingles instead.
    """
    parts = text.lower().split()
    found = set(parts)
    if len(found) < FEW_WORDS:
        wide = min(WORDS, len(parts))
        found = {b" ".join(parts[i : i + wide]) for i in range(len(parts) - wide + 1)} if parts else set()
    out, items = [], list(found)
    for seed in seeds:
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(items), SLICE):
            own = items[at : at + SLICE]
            hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(s, seed) for s in own]), dtype=np.uint8)
            counts += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out.append(int(np.packbits(counts * 2 > len(items)).view(">i8")[0]))
    return out


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of each word of the text, in order."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, text.lower().split(), repeat(SEED))), dtype=np.uint64)


def run_hashes(own: np.ndarray, words: int) -> np.ndarray:
    """Hash of each run of ``words`` words (of the whole sequence, if it is shorter), from the hashes of the words."""
    wide = min(words, len(own))
    n = len(own) - wide + 1
    out = np.full(n, wide + 1, dtype=np.uint64)
    for i in range(wide):
        out *= np.uint64(0x9E3779B97F4A7C1B)
        out += own[i : i + n]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(factor)
    return out ^ (out >> np.uint64(31))


_LANES, _LOW = np.arange(8, dtype=np.uint64), np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """Signed 64 bits: those set in over half of the hashes, which are counted in byte lanes, 255 at a time."""
    counts = np.zeros((8, 8), dtype=np.int64)
    for at in range(0, len(hashes), SLICE):
        lanes = (hashes[at : at + SLICE, None] >> _LANES) & _LOW
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, 8, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts.T.ravel() * 2 > len(hashes), bitorder="little").view("<i8")[0])


def shingle_hashes(own: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles (the whole sequence if it is shorter) of a text with the word hashes ``own``."""
    found = np.sort(run_hashes(own, words).view(np.int64))
    return found[np.diff(found, prepend=~found[:1]) != 0]


def _lists(items: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, items)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(items) if items else np.empty(0, dtype=np.int64)))


def shingle_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes fall in each of ``BINS`` bins; ``FULL`` stands for that many or more."""
    bins = (hashes.view(np.uint64) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(bins, minlength=BINS), FULL).astype(np.uint8)


def most_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bounds of the shingles that the texts of each row share: the lesser count, bin by bin; no bound where a bin is full."""
    full = (a == FULL).any(axis=1) | (b == FULL).any(axis=1)
    return np.where(full, np.iinfo(np.int64).max, np.minimum(a, b).sum(axis=1, dtype=np.int64))


def _may_be_alike(similarity: float):
    """Arrow step: pairs ``u, v`` whose counts leave room for enough shared shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BINS) for c in ("counts_u", "counts_v")]
            sizes = batch.column("size_u").to_numpy() + batch.column("size_v").to_numpy()
            kept = most_shared(*counts) >= similarity / (1.0 + similarity) * sizes - 1e-6
            yield batch.select(["u", "v"]).filter(pa.array(kept))

    return run


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes that several of the sampled texts have, and in how many.

    Only the order in which a text's shingles are looked at depends on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in text_bytes(batch.column("t")):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(word_hashes(text), words), pa.int64())], ["s"])

    some = rows.where(F.pmod(F.xxhash64("text_key"), F.lit(max(rows.count(), 1))) < SAMPLED)
    found = some.select("t").mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    found = found.orderBy(F.desc("n"), "s").limit(COMMON).toArrow()
    known, counts = found.column("s").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(known)
    return known[order], counts[order]


def sieve(known: np.ndarray) -> np.ndarray:
    """Which leading 22 bits the hashes have."""
    out = np.zeros(1 << 22, dtype=bool)
    out[known.view(np.uint64) >> np.uint64(42)] = True
    return out


def prefix(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray], leads: np.ndarray) -> np.ndarray:
    """The rarest of the sorted ``hashes`` of a text: any text alike to it has one of them among its own.

    Of ``n`` shingles at least ``similarity * n`` are shared, so two alike texts
    cannot differ in all of the first ``n - ceil(similarity * n) + 1`` of one order. ``leads`` is the ``sieve`` of the common ones.
    """
    known, counts = common
    wide = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    if not len(known):
        return hashes[:wide]
    often = np.zeros(len(hashes), dtype=np.uint16)
    maybe = np.flatnonzero(leads[hashes.view(np.uint64) >> np.uint64(42)])
    at = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
    often[maybe] = np.where(known[at] == hashes[maybe], np.minimum(counts[at], 0xFFFF), 0)
    rare = np.flatnonzero(often == 0)
    return hashes[rare[:wide] if len(rare) >= wide else np.argsort(often, kind="stable")[:wide]]


def linked_texts(prints: DataFrame) -> DataFrame:
    """``u, v`` (u < v): pairs of ``no`` of texts whose fingerprints ``fp`` are equal or link.

    The first text of a fingerprint stands for it: it is paired with each other
    text of its fingerprint and with the first texts of linked fingerprints.
    """
    firsts = saved(prints.groupBy("fp").agg(F.min("no").alias("h")), "firsts")
    found, edges = linked_components(firsts.select("fp"), named=False)
    same = prints.join(firsts, "fp").select(F.col("h").alias("u"), F.col("no").alias("v"))
    ends = [firsts.select(F.col("fp").alias(c), F.col("h").alias(f"h{c}")) for c in ("u", "v")]
    across = edges.join(ends[0], "u").join(ends[1], "v").select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v"))
    pairs = saved(same.unionByName(across).where("u < v").distinct(), "linked")
    discard(firsts, edges, *([] if found is None else [found]))
    return pairs


def joined_groups(kin: DataFrame | None, links: DataFrame) -> DataFrame:
    """``no, kin``: groups ``kin`` joined by further ``links`` ``u, v``; named after their least member.

    Only links between groups count, so a round's work does not grow with the links before it.
    """
    if kin is None:
        return saved(connected_components(links).select(F.col("node").alias("no"), F.col("root").alias("kin")), "kin")
    of = [kin.select(F.col("no").alias(c), F.col("kin").alias(f"k{c}")) for c in ("u", "v")]
    ends = links.join(of[0], "u", "left").join(of[1], "v", "left").select(F.coalesce("ku", "u").alias("u"), F.coalesce("kv", "v").alias("v"))
    tops = connected_components(ends).select(F.col("node").alias("kin"), F.col("root").alias("_top"))
    fresh = links.select(F.explode(F.array("u", "v")).alias("no")).distinct().join(kin, "no", "left_anti").select("no", F.col("no").alias("kin"))
    every = kin.select("no", "kin").unionByName(fresh).join(tops, "kin", "left")
    return saved(every.select("no", F.coalesce("_top", "kin").alias("kin")), "kin")


def similar_groups(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_key, stays`` of texts with a similar one; and ``doc_id, text_key`` of repeated rows.

    Two texts are similar if at least ``similarity`` of their shingles are in
    common. Texts joined by similar pairs form a group, and the one of the
    smallest id stays. Pairs come from linked fingerprints and are verified on
    their shingles. An exact check of what these left follows: similar texts
    share a shingle of their prefixes, so texts meet at the shingles of their
    prefixes; each round holds the texts of a shingle against some of it, until
    no shingle has texts of two groups that were not compared. No similar pair
    is left out, whatever the length of the texts. Rows that repeat an id and a
    text count once here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads = sieve(common[0])
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, firsts, fps = [], [], []
                for text in text_bytes(part.column("t")):
                    own = word_hashes(text)
                    hashes = shingle_hashes(own, words)
                    sizes.append(len(hashes))
                    firsts.append(prefix(hashes, similarity, common, leads))
                    fps.append(majority(run_hashes(own, WORDS)) if len(own) else 0)
                columns = [part.column("doc_id"), part.column("text_key"), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, _lists(firsts)], ["doc_id", "text_key", "size", "fp", "firsts"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_hashes(word_hashes(t), words) for t in text_bytes(part.column("t"))]
                own = [part.column("no"), _lists(sets), pa.array([shingle_counts(s).tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(own, ["no", "set", "counts"])

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("t"))
    common = _common(rows, words)
    made = rows.mapInArrow(run, "doc_id long, text_key long, size int, fp long, firsts array<long>")
    made = saved(made.withColumn("no", F.monotonically_increasing_id()), "shingles")
    # Rows that repeat an id and a text stand for one another.
    alike_rows = made.groupBy("doc_id", "text_key").agg(F.min("no").alias("no"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
    prints = saved(alike_rows, "prints")
    repeats = not prints.where("n > 1").isEmpty()
    lone = made.join(prints.select("no"), "no", "left_semi") if repeats else made
    # ``rest``: the shingles of a text from this one on, which is what it can share with a text that it shares none before with.
    posted = lone.select(F.posexplode("firsts").alias("_at", "key"), "no", "size").select("key", "no", "size", (F.col("size") - F.col("_at")).alias("rest"))
    # Most shingles stand in one text: a bitmap of the others keeps those where they are.
    shared = saved(posted.groupBy("key").agg((F.min("no") < F.max("no")).alias("_both")).where("_both").select("key"), "shared")
    met_keys = shared.withColumnRenamed("key", "_key")
    bits = min(max(MARK_BITS, 1 << (BITS_A_KEY * shared.count()).bit_length()), MOST_BITS)
    marked = with_mark(posted, F.col("key"), met_keys, F.col("_key"), bits).where("_hit").drop("_hit")
    left = saved(marked.join(shared, "key"), "postings")
    discard(made, shared)

    members = saved(left.select("no").distinct().join(prints.select("no", "doc_id", "text_key"), "no"), "members")
    near = with_mark(rows, F.col("text_key"), members, F.col("text_key")).where("_hit")
    near = (near.dropDuplicates(["doc_id", "text_key"]) if repeats else near).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "t")
    texts = members.join(near, members["doc_id"].eqNullSafe(near["_d"]) & (members["text_key"] == near["_k"]))
    sets = saved(texts.select("no", "t").mapInArrow(cut, "no long, set array<long>, counts binary"), "sets")
    discard(members)

    both = F.size(F.array_intersect("set_u", "set_v"))
    alike = both >= F.lit(float(similarity)) * (F.size("set_u") + F.size("set_v") - both)

    def wanted(pairs: DataFrame, side: str, column: str) -> DataFrame:
        return with_mark(sets, F.col("no"), pairs, F.col(side)).where("_hit").select(F.col("no").alias(side), F.col(column).alias(f"{column}_{side}"))

    def verified(met: DataFrame) -> DataFrame:
        """The similar ones of the pairs ``u, v``.

        Counts of shingles by bin, a few hundred bytes a text, rule most pairs
        out; only the sets of texts that are in a pair left over move.
        """
        held = met.join(wanted(met, "u", "counts"), "u").join(wanted(met, "v", "counts"), "v")
        close = saved(held.mapInArrow(_may_be_alike(similarity), "u long, v long"), "close")
        judged = close.join(wanted(close, "u", "set"), "u").join(wanted(close, "v", "set"), "v")
        more = saved(judged.where(alike).select("u", "v"), "similar")
        discard(close)
        return more

    linked = linked_texts(prints)
    size_of = [prints.select(F.col("no").alias(c), F.col("size").alias(f"size_{c}")) for c in ("u", "v")]
    tried = saved(linked.join(size_of[0], "u").join(size_of[1], "v"), "pairs")
    discard(linked)
    links = verified(tried)
    release(docs.sparkSession)
    kin = None if links.isEmpty() else joined_groups(None, links)
    heads_each, spent = FIRST_HEADS, [tried, links]
    enough = lambda *sizes: F.lit(float(similarity / (1.0 + similarity))) * sum(sizes[1:], sizes[0]) - 1e-6
    count = held = most = left.count()
    while count:
        placed = left.withColumn("kin", F.col("no")) if kin is None else left.join(kin, "no", "left").withColumn("kin", F.coalesce("kin", "no"))
        # A text whose rest is too short for the smallest text at a shingle has met those alike to it at an earlier one.
        of_key = placed.groupBy("key").agg(F.min("size").alias("_least"), F.min("kin").alias("_k0"), F.max("kin").alias("_k1")).where("_k0 < _k1")
        placed = placed.join(of_key, "key").where(F.col("rest") >= enough(F.col("size"), F.col("_least")))
        placed = saved(placed.select("key", "no", "size", "rest", "kin"), "placed")
        discard(left)
        pairs_left = placed.groupBy("key").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
        if pairs_left <= most // POSTINGS_A_PAIR:
            # So few that all are held against one another at once, however many of a group there are.
            heads = placed
            found = placed.select("key", *[F.col(c).alias(f"h{c}") for c in ("kin", "no", "size", "rest")])
        else:
            # One head of each group at a shingle, a few groups at first, then more; the same groups at all shingles, and
            # the texts with most in reach first: most texts alike to any of a crowd are alike to those.
            far = F.min(F.struct((-F.col("rest")).alias("r"), "no", "size")).alias("far")
            groups = placed.groupBy("key", "kin").agg(far, F.count(F.lit(1)).alias("members"))
            kinds = groups.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min(F.struct("far", "kin"))["kin"].alias("best")).where("kinds > 1")
            place = lambda c: F.pmod(F.xxhash64(c, F.lit(len(spent))), F.lit(1 << 20)) / F.lit(float(1 << 20))
            groups = groups.join(kinds, "key").where((F.col("kin") == F.col("best")) | (place("kin") * F.col("kinds") < heads_each - 1))
            if heads_each == FIRST_HEADS:
                heads = groups.select("key", F.col("kin").alias("hkin"), F.col("far.no").alias("hno"), F.col("far.size").alias("hsize"), (-F.col("far.r")).alias("hrest"))
            else:
                # Heads left over where groups are few go to more of their members.
                each = place("no") * F.col("members") < F.floor(F.lit(heads_each) / F.col("kinds")) - 1
                heads = placed.join(groups, ["key", "kin"]).where((F.col("no") == F.col("far.no")) | each)
                heads = heads.select("key", *[F.col(c).alias(f"h{c}") for c in ("kin", "no", "size", "rest")])
            found = heads = saved(heads, "heads")
        wide = F.least("rest", "hrest") >= enough(F.col("size"), F.col("hsize"))
        met = placed.join(found, "key").where((F.col("kin") != F.col("hkin")) & wide)
        first = F.col("no") < F.col("hno")
        sizes = [F.when(first, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("size", "hsize", "size_u"), ("hsize", "size", "size_v"))]
        met = met.select(F.least("no", "hno").alias("u"), F.greatest("no", "hno").alias("v"), *sizes).distinct()
        met = saved(met.join(tried, ["u", "v"], "left_anti"), "pairs")
        more = verified(met)
        tried = tried.unionByName(met.select(*tried.columns))
        spent += [met, more]
        last = heads is placed
        if not last:
            left = saved(placed.join(heads.select("key", F.col("hno").alias("no")), ["key", "no"], "left_anti").select("key", "no", "size", "rest"), "postings")
            discard(heads)
        discard(placed)
        if not more.isEmpty():
            before = kin
            kin = joined_groups(before, more)
            if before is not None:
                discard(before)
        release(docs.sparkSession)
        count = 0 if last else left.count()
        heads_each = min(8 * heads_each, max(HEADS, most // POSTINGS_A_PAIR // max(count, 1)))
        if 0 < count * 8 < held:
            # Later rounds read the shingles of the texts left only.
            held, wide_sets = count, sets
            sets = saved(with_mark(sets, F.col("no"), left.select(F.col("no").alias("_no")), F.col("_no")).where("_hit").drop("_hit"), "sets")
            discard(wide_sets)
    if kin is None:
        kin = prints.where("false").select("no", F.col("no").alias("kin"))
    # Texts in order: by id (null last), then by text.
    uid = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("text_key").alias("k"))
    discard(sets, left, *spent)
    judged = saved(kin.join(prints.select("no", "doc_id", "text_key", uid.alias("uid")), "no"), "judged")
    stay = judged.groupBy("kin").agg(F.min("uid").alias("_stay"))
    out = judged.join(stay, "kin").select("doc_id", "text_key", (F.col("uid") == F.col("_stay")).alias("stays"))
    return out, prints.where("n > 1").select("doc_id", "text_key")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row left of each group of similar texts, columns as they were.

    Similar: at least ``similarity`` of the distinct word shingles in common.
    Rows that repeat an id and a text leave one row. Null texts are empty.
    """
    judged, repeated = similar_groups(docs, id_col, text_col, words, similarity)
    key = F.xxhash64(text_of(text_col))
    go = judged.where("NOT stays").select(F.col("doc_id").alias("_go_id"), F.col("text_key").alias("_go_key"))
    touched = saved(go.unionByName(repeated.toDF("_go_id", "_go_key")), "touched")
    tagged = with_mark(docs.withColumns({"_row_id": F.col(id_col).cast("long"), "_row_key": key}), F.col("_row_key"), touched, F.col("_go_key"))
    some = tagged.where("_hit")
    some = some.join(go, some["_row_id"].eqNullSafe(go["_go_id"]) & (some["_row_key"] == go["_go_key"]), "left_anti")
    copy = F.row_number().over(W.partitionBy("_row_id", "_row_key").orderBy(F.xxhash64(*[F.col(c) for c in docs.columns])))
    some = some.withColumn("_copy", copy).where("_copy = 1")
    return tagged.where("NOT _hit").select(*docs.columns).unionByName(some.select(*docs.columns))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """``docs`` with one row left of each component (smallest id), columns as they were."""
    rows = near_duplicates(docs, id_col, text_col, words, bits)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")
    stay = rows.groupBy(F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint")).alias("g")).agg(F.min(order).alias("s"))
    stay = stay.select(F.col("s.doc_id").alias("_stay_id"), F.col("s.text_key").alias("_stay_key"))
    tagged = docs.withColumns({"_row_id": F.col(id_col).cast("long"), "_row_key": F.xxhash64(text_of(text_col))})
    left = tagged.join(stay, F.col("_row_id").eqNullSafe(F.col("_stay_id")) & (F.col("_row_key") == F.col("_stay_key")))
    copy = F.row_number().over(W.partitionBy("_row_id", "_row_key").orderBy(F.xxhash64(*[F.col(c) for c in docs.columns])))
    return left.withColumn("_copy", copy).where("_copy = 1").select(*docs.columns)
