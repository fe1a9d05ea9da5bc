"""Byte-level BPE by a shuffle of distinct words, and the decoding of its ids.

Merges never leave a pre-token (a match of the split pattern), so the ids of a
text are the ids of its pre-tokens in order. Texts are exploded into pre-tokens
with their positions; each distinct pre-token ("word") of the whole corpus is
encoded once, by the one bucket of words it falls in; its ids are joined back and put
together by position. Decoding joins the ids with the table of token bytes and
puts those together by position.

Scale. A row per pre-token would be many times the corpus, so positions are held
by block: a block is a run of whole texts (``BLOCK`` bytes, or one longer text), and a
text is the array of its pre-tokens' numbers in the block's own list of distinct
words. That list is cut by the words' hash: one row per block and bucket is
shuffled, with a word's repeats inside the block already gone. The most
frequent word thus has one place per block, and no key is hot. The number of
buckets follows the size of the corpus, so a bucket holds a bounded share of the blocks'
words; past the words of a block, its rows hold one word each. Blocks then
meet their words' ids in a grouped step that holds one block at a time.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.llm.common import saved, text_bytes, text_of

RANKS = "byte_bpe_50k.tiktoken"
BLOCK = 16 << 20
#: Bytes of text for each bucket of words.
BUCKET = 4 << 20
SEGMENT = 1 << 18
SHORT = 512
RUN = 1 << 16
#: A non-white character before a white one: no pre-token holds both.
SAFE = regex.compile(r"\S\s")

OUTPUTS = {
    "n_tokens": ("long", pa.int64()),
    "ids": ("binary", pa.binary()),
    "decoded": ("binary", pa.binary()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    """Encodes one pre-token: its pattern takes all it is given as one."""
    return tiktoken.Encoding("one_piece", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(path), special_tokens={})


def pre_tokens(text: str, pattern: regex.Pattern) -> Iterator[list[str]]:
    """The matches of ``pattern`` in order, a long text in segments cut where no match crosses."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = SAFE.search(text, at + SEGMENT)
        if cut is None:
            break
        yield pattern.findall(text, at, cut.start() + 1)
        at = cut.start() + 1
    yield pattern.findall(text, at)


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _pack(data: bytes) -> bytes:
    return b"z" + zstandard.ZstdCompressor(level=1).compress(data) if len(data) > SHORT else b"r" + data


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[1:]) if data[:1] == b"z" else data[1:]


def pack_parts(parts: list[bytes]) -> bytes:
    """Byte strings as their number, their lengths and their bytes."""
    return _pack(np.array([len(parts), *map(len, parts)], dtype="<u4").tobytes() + b"".join(parts))


def unpack_parts(data: bytes) -> list[bytes]:
    raw = _unpack(data)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.frombuffer(raw, dtype="<u4", count=n, offset=4).cumsum() + 4 * (n + 1)).tolist()
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends], ends)]


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Integers below 2 ** 32, byte plane by byte plane: small ones leave planes of zeros."""
    return _pack(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


#: Rows of words, and rows of texts (several a row, of ``RUN`` pre-tokens or one longer text).
WORDS = [("block", pa.int64()), ("bucket", pa.int64()), ("numbers", pa.binary()), ("words", pa.binary())]
TEXTS = [("block", pa.int64()), ("mark", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("seq", pa.binary())]


class _Block:
    """A run of whole texts: its words, numbered as they are first seen, and a digest of the texts."""

    def __init__(self):
        self.words, self.digest, self.size = _Numbers(), xxhash.xxh64(), 0

    def add(self, text: bytes) -> str:
        self.digest.update(len(text).to_bytes(8, "little") + text)
        self.size += len(text)
        return text.decode("utf-8", "replace")

    @property
    def mark(self) -> int:
        return self.digest.intdigest() - (1 << 63)


def _batch(columns: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), columns)], [n for n, _ in columns])


def _list_words(pattern: str, block_bytes: int, buckets: int):
    """Arrow step: the distinct words of each block, one row per bucket of words."""

    def rows_of(number: int, block: _Block) -> Iterator[pa.RecordBatch]:
        known = [w.encode() for w in block.words]
        of = np.array([xxhash.xxh64_intdigest(w) % buckets for w in known], dtype=np.int64)
        order = np.argsort(of, kind="stable")
        own, starts = np.unique(of[order], return_index=True)
        # One row more, of bucket -1, has the block's mark.
        rows = [(number, -1, None, block.mark.to_bytes(8, "little", signed=True))]
        for bucket, held in zip(own.tolist(), np.split(order, starts[1:])):
            rows.append((number, bucket, pack_numbers(np.diff(held, prepend=0)), pack_parts([known[i] for i in held.tolist()])))
        yield _batch(WORDS, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, number, block = regex.compile(pattern), TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for text in text_bytes(batch.column("t")):
                for found in pre_tokens(block.add(text), compiled):
                    for word in dict.fromkeys(found):
                        block.words[word]
                if block.size >= block_bytes:
                    yield from rows_of(number, block)
                    number, block = number + 1, _Block()
        yield from rows_of(number, block)

    return run


def _list_texts(pattern: str, block_bytes: int):
    """Arrow step: the texts of each block as the numbers of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, number, block = regex.compile(pattern), TaskContext.get().partitionId() << 32, _Block()
        docs, seqs, rows, tokens = [], [], [], 0

        def close_row() -> None:
            nonlocal docs, seqs, tokens
            if docs:
                rows.append((docs, [len(s) for s in seqs], pack_numbers(np.concatenate(seqs))))
                docs, seqs, tokens = [], [], 0

        def close_block() -> Iterator[pa.RecordBatch]:
            close_row()
            if rows:
                yield _batch(TEXTS, [(number, block.mark, *row) for row in rows])
                rows.clear()

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("t"))):
                found = pre_tokens(block.add(text), compiled)
                docs.append(doc)
                seqs.append(np.concatenate([np.array([block.words[w] for w in part], dtype="<u4") for part in found]))
                tokens += len(seqs[-1])
                if tokens >= RUN:
                    close_row()
                if block.size >= block_bytes:
                    yield from close_block()
                    number, block = number + 1, _Block()
        yield from close_block()

    return run


def _encode_bucket(path: str):
    """Grouped step: encodes each distinct word of a bucket once and gives every block's row its words' ids."""

    def run(rows: pa.Table) -> pa.Table:
        encode_one, ids_of, packs = encoding(path).encode_ordinary, {}, []
        for pack, bucket in zip(rows.column("words").to_pylist(), rows.column("bucket").to_pylist()):
            if bucket < 0:
                packs.append(pack)
                continue
            words = unpack_parts(pack)
            for word in words:
                if word not in ids_of:
                    ids_of[word] = np.array(encode_one(word.decode()), dtype="<u4").tobytes()
            packs.append(pack_parts([ids_of[w] for w in words]))
        return pa.table({"of": rows.column("of"), "numbers": rows.column("numbers"), "ids": pa.array(packs, pa.binary())})

    return run


@functools.cache
def token_table(path: str) -> pa.Table:
    """``id, token``: the bytes of each token; one row per entry of the vocabulary."""
    ranks = read_ranks(path)
    return pa.table({"id": pa.array(ranks.values(), pa.uint32()), "token": pa.array(ranks.keys(), pa.binary())})


def decoded(path: str, texts: list[bytes]) -> list[bytes]:
    """What each id sequence of ``texts`` (little-endian unsigned 32-bit) decodes to.

    The distinct ids are joined with the token table, and the tokens put
    together by position. An id that is no token raises an error.
    """
    ids = [np.frombuffer(t, dtype="<u4") for t in texts]
    known, at = np.unique(np.concatenate([*ids, np.empty(0, dtype="<u4")]), return_inverse=True)
    met = pa.table({"id": pa.array(known, pa.uint32())}).join(token_table(path), "id", join_type="inner").sort_by("id")
    if met.num_rows < len(known):
        raise ValueError("ids that are no tokens of the table")
    token = met.column("token").to_pylist().__getitem__
    out, start = [], 0
    for own in ids:
        out.append(b"".join(map(token, at[start : start + len(own)].tolist())))
        start += len(own)
    return out


def decode(rows: DataFrame, ranks: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` (bytes) of rows with ``ids`` as little-endian unsigned 32-bit integers; null ids count as none."""
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = decoded(path, [i or b"" for i in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def encode(
    docs: DataFrame,
    ranks: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
    block_bytes: int = BLOCK,
    bucket_bytes: int = BUCKET,
) -> DataFrame:
    """``doc_id`` and the ``outputs`` asked for, one row per input row.

    ``ids`` are little-endian unsigned 32-bit integers, without special tokens;
    ``decoded`` are the bytes that these ids decode to. Null texts count as empty (no
    ids, empty bytes); null ids are kept; repeated rows give repeated rows; an
    empty table gives none; other columns are ignored, whatever their names. A
    text longer than a block is a block of its own, split in segments.

    Texts are read twice, once for the words and once for the positions, which is
    cheaper than to keep the positions in a table besides their shuffle. Blocks carry a digest of their
    texts: a table whose partitions differ from one read to the next raises an error.
    """
    path = ranks or public_tokenizers.path(RANKS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    spark = docs.sparkSession
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, size // (4 * block_bytes))

    listed = rows.select("t").mapInArrow(_list_words(pattern, block_bytes, 1 + size // bucket_bytes), "of long, bucket long, numbers binary, words binary")
    # Marks of blocks are dealt like words.
    dealt = F.when(F.col("bucket") < 0, -1 - F.pmod("of", F.lit(1024))).otherwise(F.col("bucket"))
    listed = listed.withColumn("dealt", dealt).repartition(wide, "dealt")
    coded = listed.groupBy("dealt").applyInArrow(_encode_bucket(path), "of long, numbers binary, ids binary")
    coded = saved(coded, "words").repartition(wide, "of")
    texts = rows.mapInArrow(_list_texts(pattern, block_bytes), "block long, mark long, doc_ids array<long>, counts array<int>, seq binary").repartition(wide, "block")

    def put(own: pa.Table, found: pa.Table) -> pa.Table:
        packs, marks = [], set(own.column("mark").to_pylist())
        for numbers, pack in zip(found.column("numbers").to_pylist(), found.column("ids").to_pylist()):
            if numbers is None:
                marks.add(int.from_bytes(pack, "little", signed=True))
            else:
                packs.append((unpack_numbers(numbers).cumsum().tolist(), unpack_parts(pack)))
        if own.num_rows and (len(marks) > 1 or not found.num_rows):
            raise ValueError("the rows of this table came in another order when they were read again; write it to files first")
        ids_of: list[bytes] = [b""] * sum(len(p) for _, p in packs)
        for numbers, pack in packs:
            for number, some in zip(numbers, pack):
                ids_of[number] = some
        docs, ids = [], []
        for some, counts, seq in zip(*(own.column(c).to_pylist() for c in ("doc_ids", "counts", "seq"))):
            docs += some
            numbers, start = unpack_numbers(seq).tolist(), 0
            for count in counts:
                ids.append(b"".join(map(ids_of.__getitem__, numbers[start : start + count])))
                start += count
        back = decoded(path, ids) if "decoded" in outputs or "decoded_sha256" in outputs else []
        make = {
            "n_tokens": lambda: [len(i) // 4 for i in ids],
            "ids": lambda: ids,
            "decoded": lambda: back,
            "ids_sha256": lambda: [hashlib.sha256(i).hexdigest() for i in ids],
            "decoded_sha256": lambda: [hashlib.sha256(b).hexdigest() for b in back],
        }
        return pa.table({"doc_id": pa.array(docs, pa.int64()), **{o: pa.array(make[o](), OUTPUTS[o][1]) for o in outputs}})

    schema = ", ".join(["doc_id long", *[f"{o} {OUTPUTS[o][0]}" for o in outputs]])
    return texts.groupBy("block").cogroup(coded.groupBy("of")).applyInArrow(put, schema)
