"""BPE encoding and decoding with chunks shared between documents.

Texts are cut where a rolling hash over 32 bytes says so, so equal passages give
equal chunks wherever they stand. A chunk that several texts hold is encoded
by one of them only, its owner; the others fetch the owner's ids. A cut can fall
inside a word, so each join of chunks is repaired: the text from the last white
space before the cut to the first one after it is encoded anew and replaces
the ids of its two parts. Both parts are encoded, too, and must agree with the
ends of the chunks' ids; a text where they do not is encoded whole.

Scale. The first pass shuffles one hash per chunk. Texts that share chunks are
then shuffled once, to meet the short list of them; a bitmap of fixed size
(``common.with_mark``), set for the keys of such texts, lets the others stay where they
are. A text marked by chance takes the long way and comes to the same result,
so a bitmap that fills up costs time, not correctness. Ids move only for shared
chunks and for texts that fetch some. A chunk that a third of all texts hold has
one owner, found by a pre-aggregated minimum, and meets its readers in a join
that adaptive execution splits.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.llm.common import discard, saved, text_bytes, text_of, with_mark
from landloom.llm.pieces import Pieces, pieces, token_strings

TOKENIZER = "word_bpe_49k.json"
WINDOW = 32
MEAN_BITS = 10
LEAST = 256
MOST = 8192
SEGMENT = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"

OUTPUTS = {
    "n_tokens": "long",
    "ids": "binary",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


@functools.cache
def _gear() -> np.ndarray:
    """A fixed random 64-bit value per byte."""
    return np.array([xxhash.xxh64_intdigest(bytes([i]), 1) for i in range(256)], dtype=np.uint64)


def cut_places(text: bytes) -> list[int]:
    """Ends of the chunks of ``text``; every end is the start of a character."""
    n = len(text)
    if n <= LEAST:
        return [n]
    found: list[np.ndarray] = []
    for at in range(0, n, SEGMENT):
        lead = min(at, WINDOW - 1)
        raw = np.frombuffer(text, dtype=np.uint8, count=min(n, at + SEGMENT) - at + lead, offset=at - lead)
        rolled, span = _gear()[raw], 1
        while span < WINDOW:
            longer = rolled.copy()
            longer[span:] += rolled[:-span] << np.uint64(span)
            rolled, span = longer, span * 2
        hit = np.flatnonzero(rolled >> np.uint64(64 - MEAN_BITS) == 0) + 1 - lead
        found.append(hit[hit > 0] + at)
    ends, last = [], 0
    marks = np.concatenate(found).tolist()
    for mark in [*marks, n]:
        while mark - last > MOST:
            cut = last + MOST
            while text[cut] & 0xC0 == 0x80:
                cut -= 1
            ends.append(cut)
            last = cut
        if mark == n:
            ends.append(n)
        elif mark - last >= LEAST and text[mark] & 0xC0 != 0x80:
            ends.append(mark)
            last = mark
    return ends


def _name(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _pack(ids: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(ids)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _last_white(text: bytes, low: int, high: int) -> int:
    return max(text.rfind(c, low, high) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))


def _first_white(text: bytes, low: int, high: int) -> int:
    found = [i for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := text.find(c, low, high)) >= 0]
    return min(found, default=-1)


def repairs(table: Pieces, text: bytes, ends: list[int]) -> list[tuple[bytes, bytes, bytes]] | None:
    """For each inner cut: ids of the left part, of the right part, of both together.

    None if a chunk beside a cut has no white space: no window is safe there.
    """
    out, starts = [], [0, *ends]
    for i, cut in enumerate(ends[:-1]):
        low, high = _last_white(text, starts[i], cut), _first_white(text, cut, ends[i + 1])
        if low < 0 or high < 0:
            return None
        out.append((table.words(text[low:cut]), table.words(text[cut:high]), table.words(text[low:high])))
    return out


def joined(chunks: list[bytes], fixes: list[tuple[bytes, bytes, bytes]]) -> bytes | None:
    """Chunk ids with repaired joins; None if a part does not agree with its chunk."""
    out, start = [], 0
    for i, ids in enumerate(chunks):
        end = len(ids)
        if i < len(fixes):
            left, right, both = fixes[i]
            end -= len(left)
            if end < start or ids[end:] != left or not chunks[i + 1].startswith(right):
                return None
            out += [ids[start:end], both]
            start = len(right)
        else:
            out.append(ids[start:])
    return b"".join(out)


def decoded(path: str, ids: bytes) -> bytes:
    """What the library's decode gives for a tokenizer without a decoder, special tokens kept."""
    strings = token_strings(path)
    return b" ".join([strings[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def _values(path: str, ids: bytes, outputs: tuple[str, ...]) -> list:
    back = decoded(path, ids) if "decoded" in outputs or "decoded_sha256" in outputs else b""
    make = {
        "n_tokens": lambda: len(ids) // 4,
        "ids": lambda: ids,
        "decoded": lambda: back.decode("utf-8", "replace"),
        "ids_sha256": lambda: hashlib.sha256(ids).hexdigest(),
        "decoded_sha256": lambda: hashlib.sha256(back).hexdigest(),
    }
    return [make[o]() for o in outputs]


ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(schema: list[tuple[str, str]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, (_, k) in zip(columns, schema)], [n for n, _ in schema])


def _rows(batches: Iterator[pa.RecordBatch], schema: list[tuple[str, str]], each, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of what ``each`` yields per batch, sent when their binary values pass ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        for row in each(batch):
            held.append(row)
            size += 64 + sum(len(v) for v in row if isinstance(v, bytes | str))
            if size > most:
                yield _batch(schema, held)
                held, size = [], 0
    if held:
        yield _batch(schema, held)


def encode(
    docs: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
) -> DataFrame:
    """``doc_id`` and the ``outputs`` asked for, one row per input row.

    ``ids`` are little-endian unsigned 32-bit integers, special tokens of the
    text as the library reads them, none added; ``decoded`` is the library's
    decode of them, special tokens kept. The tokenizer must be one that
    drops white space and has no decoder (``word_bpe_49k.json``). Null texts
    count as empty (no ids); null ids are kept; repeated rows give repeated
    rows; other columns are ignored.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("key"), text.alias("t"))

    listing = [("doc_id", "long"), ("key", "binary"), ("ord", "int"), ("chunk", "binary")]

    def list_chunks(batches):
        def each(batch):
            for doc, key, t in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), text_bytes(batch.column("t"))):
                start = 0
                for i, end in enumerate(cut_places(t)):
                    yield doc, key, i, _name(t[start:end])
                    start = end

        return _rows(batches, listing, each)

    chunks = saved(rows.mapInArrow(list_chunks, ", ".join(f"`{n}` {k}" for n, k in listing)), "chunks")
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "key", "ord")
    owners = chunks.groupBy("chunk").agg(F.min(place).alias("owner"), F.max(place).alias("other")).where("owner <> other").select("chunk", "owner")
    shared = chunks.join(owners, "chunk").withColumn("own", place == F.col("owner"))
    plan = shared.groupBy("doc_id", "key").agg(F.collect_set(F.struct("ord", "chunk", "own")).alias("plan"))
    plan = plan.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "plan")
    plan = plan_table = saved(plan, "plan")

    marked = with_mark(rows, F.col("key"), plan, F.col("_k"))
    hit = F.col("_hit")
    alone = marked.where(~hit).select("doc_id", "key", "t", F.lit(None).cast(plan.schema["plan"].dataType).alias("plan"))
    some = marked.where(hit).select("doc_id", "key", "t")
    met = some.join(plan, some["doc_id"].eqNullSafe(plan["_d"]) & (some["key"] == plan["_k"]), "left").select("doc_id", "key", "t", "plan")
    met = met.withColumn("uid", F.monotonically_increasing_id())

    # kind 0: a finished row; 1: ids of a shared chunk; 2: a part of a row that waits for shared chunks.
    fixed = [("kind", "int"), ("doc_id", "long"), ("uid", "long"), ("ord", "int"), ("chunk", "binary")]
    parts = [("packed", "binary"), ("left", "binary"), ("right", "binary"), ("both", "binary")]
    schema = fixed + parts + [(o, OUTPUTS[o]) for o in outputs]
    blank = (None,) * len(outputs)
    with_key = schema + [("key", "binary")]

    def encode_rows(batches):
        table = pieces(path)

        def each(batch):
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "key", "uid", "plan")]
            for doc, key, uid, known, t in zip(*columns, text_bytes(batch.column("t"))):
                ends, known = cut_places(t), {p["ord"]: p for p in known or ()}
                fixes = repairs(table, t, ends)
                fetch = {i for i, p in known.items() if not p["own"]} if fixes is not None else set()
                starts = [0, *ends]
                ids = [None if i in fetch else table.words(t[starts[i] : end]) for i, end in enumerate(ends)]
                for i, p in known.items():
                    if p["own"]:
                        yield (1, None, None, None, p["chunk"], _pack(ids[i]), None, None, None, *blank, None)
                if not fetch:
                    whole = joined(ids, fixes) if fixes is not None else None
                    yield (0, doc, uid, None, None, None, None, None, None, *_values(path, table.words(t) if whole is None else whole, outputs), None)
                    continue
                for i, own in enumerate(ids):
                    left, right, both = fixes[i] if i < len(fixes) else (None, None, None)
                    name = None if own is not None else known[i]["chunk"]
                    yield (2, doc, uid, i, name, None if own is None else _pack(own), left, right, both, *blank, key)

        yield from _rows(batches, with_key, each)
        table.release()

    made = ", ".join(f"`{n}` {k}" for n, k in with_key)
    step = alone.withColumn("uid", F.lit(-1).cast("long")).mapInArrow(encode_rows, made).unionByName(met.mapInArrow(encode_rows, made))
    step = saved(step, "encoded")
    discard(chunks, plan_table)
    names = ["doc_id", *outputs]
    finished = step.where("kind = 0").select(*names)
    ids = step.where("kind = 1").select("chunk", F.col("packed").alias("fetched")).groupBy("chunk").agg(F.first("fetched").alias("fetched"))
    waiting = step.where("kind = 2").select("uid", "doc_id", "key", "ord", "chunk", "packed", "left", "right", "both")
    part = F.struct("ord", F.coalesce("packed", "fetched").alias("packed"), "left", "right", "both")
    gathered = waiting.join(ids, "chunk", "left").groupBy("uid", "doc_id", "key").agg(F.sort_array(F.collect_list(part)).alias("parts"))

    def assemble(batches):
        def each(batch):
            for doc, key, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "parts"))):
                got = [None if p["packed"] is None else _unpack(p["packed"]) for p in own]
                whole = None if None in got else joined(got, [(p["left"], p["right"], p["both"]) for p in own[:-1]])
                yield (doc, key, int(whole is not None), *(blank if whole is None else _values(path, whole, outputs)))

        return _rows(batches, after, each)

    after = [("doc_id", "long"), ("key", "binary"), ("agreed", "int")] + [(o, OUTPUTS[o]) for o in outputs]
    put = saved(gathered.mapInArrow(assemble, ", ".join(f"`{n}` {k}" for n, k in after)), "joined")
    result = finished.unionByName(put.where("agreed = 1").select(*names))
    failed = put.where("agreed = 0").groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("copies"))
    if failed.isEmpty():
        return result

    def encode_whole(batches):
        table = pieces(path)

        def each(batch):
            for doc, t in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("t"))):
                yield (doc, *_values(path, table.words(t), outputs))

        yield from _rows(batches, [after[0], *after[3:]], each)
        table.release()

    again = rows.join(failed, rows["doc_id"].eqNullSafe(failed["_d"]) & (rows["key"] == failed["_k"]), "left_semi")
    return result.unionByName(again.select("doc_id", "t").mapInArrow(encode_whole, ", ".join(f"`{n}` {k}" for n, k in [after[0], *after[3:]])))
