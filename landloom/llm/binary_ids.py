"""Token ids in binary files, each document compressed on its own with a shared dictionary.

Documents are ranged by id, so file after file holds ascending ids; each task
encodes the texts of its range and writes one file:

    head    magic ``LLIDS001`` | SHA-256 of the dictionary (32 bytes) | bytes per id (2 or 4)
    body    one zstandard frame per document: its ids, little-endian
    index   one zstandard frame: document ids, null marks, frame offsets, id counts
    foot    index offset | index bytes | documents (8 bytes each) | CRC-32 of the index (4) | magic

The zstandard dictionary is trained on serialized id arrays of a bounded sample
(``SAMPLE`` documents by hash, their first ``SAMPLE_CHARS`` characters); it only
affects sizes. It is stored once, named by its hash. A short document is read
with one seek: index, frame, done.

Scale. One shuffle of the texts, by range; nothing but one row per file and one
dictionary passes through the driver. Files get unique names and count only
when their task's row reaches the manifest, so retries leave no half files in it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.llm.common import saved, scratch_path, text_bytes, text_of
from landloom.llm.pieces import pieces

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
MAGIC = b"LLIDS001"
HEAD = len(MAGIC) + 33
FOOT = 24 + 4 + len(MAGIC)
LEVEL = 3
SAMPLE = 1000
SAMPLE_CHARS = 16_384
DICTIONARY_BYTES = 64 << 10


def _place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder every executor can reach."""
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def _read(uri: str) -> bytes:
    fs, path = _place(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def _write(uri: str, data: bytes) -> None:
    fs, path = _place(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(data)


def _dictionary(folder: str, name: str) -> zstandard.ZstdCompressionDict | None:
    if not name:
        return None
    data = _read(f"{folder}/{name}.dict")
    if hashlib.sha256(data).hexdigest() != name:
        raise ValueError(f"the dictionary in {folder} does not have the hash {name}")
    return zstandard.ZstdCompressionDict(data)


def serialized(ids: bytes, width: int) -> bytes:
    """Ids of 32 bits each as the file keeps them."""
    return ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()


def restored(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, dtype="<u2").astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, width: int, id_col: str, text_col: str, sample: int = SAMPLE) -> bytes:
    """A dictionary from the ``sample`` documents of least hash; empty if they are too few or too plain."""
    rows = docs.select(F.xxhash64(F.col(id_col), text_of(text_col)).alias("h"), text_of(text_col).alias("t"))
    top = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if top is None:
        return b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(tokenizer)
        for batch in batches:
            data = [serialized(table.runs(t), width) for t in text_bytes(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["d"])

    # Copies of one row share a hash; one of each is enough.
    picked = rows.where(F.col("h") <= top).select("h", F.substring("t", 1, SAMPLE_CHARS).alias("t")).dropDuplicates(["h"]).orderBy("h")
    data = [r["d"] for r in picked.select("t").mapInArrow(run, "d binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(d) for d in data if d]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    files: int | None = None,
    vocabulary: int = 1 << 16,
) -> DataFrame:
    """Write all documents into ``folder``; returns the manifest, one row per file.

    Manifest: ``file, seq, n_docs, n_tokens, dictionary, start`` where ``start``
    counts the ids of all files before. Null texts count as empty and have the end
    id alone; null ids come last; rows of one id are ordered by the hash of
    their text and stay apart. An empty table writes no file.
    """
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    width = 2 if vocabulary <= 1 << 16 else 4
    data = train_dictionary(docs, path, width, id_col, text_col)
    name = hashlib.sha256(data).hexdigest() if data else ""
    fs, local = _place(folder)
    fs.create_dir(local, recursive=True)
    if name:
        _write(f"{folder}/{name}.dict", data)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out, held = pieces(path), None, []
        seq, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            if out is None and batch.num_rows:
                known = _dictionary(folder, name)
                if known:
                    known.precompute_compress(level=LEVEL)
                pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
                file = f"part-{seq:06d}-{uuid.uuid4().hex}.ids"
                fs, local = _place(f"{folder}/{file}")
                out, at = fs.open_output_stream(local), HEAD
                out.write(MAGIC + (bytes.fromhex(name) or bytes(32)) + bytes([width]))
            for doc, t in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("t"))):
                ids = table.runs(t) + end
                frame = pack.compress(serialized(ids, width))
                held.append((doc or 0, doc is None, at, len(ids) // 4))
                out.write(frame)
                at += len(frame)
                total += len(ids) // 4
        if out is None:
            return
        kinds = ("<i8", "<u1", "<u8", "<u8")
        index = zstandard.compress(b"".join(np.array(c, dtype=k).tobytes() for c, k in zip(zip(*held), kinds)))
        out.write(index + np.array([at, len(index), len(held)], dtype="<u8").tobytes() + zlib.crc32(index).to_bytes(4, "little") + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict({"file": [file], "seq": pa.array([seq], pa.int32()), "n_docs": [len(held)], "n_tokens": [total], "dictionary": [name]})

    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("t")]
    ranged = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    manifest = saved(ranged.mapInArrow(run, "file string, seq int, n_docs long, n_tokens long, dictionary string"), "manifest")
    before = W.orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class IdFile:
    """Random access to one file: ``entries`` and ``ids(i)``."""

    def __init__(self, folder: str, file: str):
        fs, path = _place(f"{folder}/{file}")
        self._in = fs.open_input_file(path)
        size = self._in.size()
        foot = self._in.read_at(FOOT, size - FOOT)
        head = self._in.read_at(HEAD, 0)
        if foot[-len(MAGIC) :] != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{file} is not a whole file of this format")
        at, length, n = (int(v) for v in np.frombuffer(foot[:24], dtype="<u8"))
        index = self._in.read_at(length, at)
        if zlib.crc32(index) != int.from_bytes(foot[24:28], "little"):
            raise ValueError(f"the index of {file} is damaged")
        raw, self.entries, self._end = zstandard.decompress(index), [], at
        columns, place = [], 0
        for kind in ("<i8", "<u1", "<u8", "<u8"):
            columns.append(np.frombuffer(raw, dtype=kind, count=n, offset=place))
            place += columns[-1].nbytes
        self.doc_ids, self.nulls, self.offsets, self.counts = columns
        self.width = head[-1]
        digest = head[len(MAGIC) : -1]
        self._unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(folder, digest.hex() if any(digest) else ""))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> bytes:
        """Ids of the ``i``-th document as little-endian unsigned 32-bit integers."""
        end = int(self.offsets[i + 1]) if i + 1 < len(self) else self._end
        frame = self._in.read_at(end - int(self.offsets[i]), int(self.offsets[i]))
        return restored(self._unpack.decompress(frame), self.width)

    def close(self) -> None:
        self._in.close()


def read_ids(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) per document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                source = IdFile(folder, file)
                for low in range(0, len(source), 512):
                    span = range(low, min(len(source), low + 512))
                    data = [source.ids(i) for i in span]
                    counts = source.counts[low : span.stop].astype(np.int64)
                    if [len(d) // 4 for d in data] != counts.tolist():
                        raise ValueError(f"{file}: a document does not have the length its index says")
                    starts = start + np.concatenate([[0], np.cumsum(counts)])
                    start = int(starts[-1])
                    ids = pa.array(source.doc_ids[low : span.stop], mask=source.nulls[low : span.stop].astype(bool))
                    columns = [ids, pa.array(starts[:-1]), pa.array(counts), pa.array([zlib.crc32(d) for d in data], pa.int64())]
                    columns += [pa.array(data, pa.binary())] if with_ids else []
                    yield pa.RecordBatch.from_arrays(columns, names)
                source.close()

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    spark = manifest.sparkSession
    spread = manifest.select("file", "start").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to a new shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, folder, **options), folder)


def document_ids(spark: SparkSession, manifest: DataFrame, folder: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with this id, by way of the index; reads no other document."""
    found = []
    for row in manifest.orderBy("seq").toLocalIterator():
        source = IdFile(folder, row["file"])
        for i in np.flatnonzero((source.doc_ids == doc_id) & (source.nulls == 0)).tolist():
            found.append(np.frombuffer(source.ids(i), dtype="<u4").tolist())
        source.close()
    return found
