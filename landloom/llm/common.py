"""What the operators of this folder share: white space, table access, scratch tables."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.session import ensure_checkpoint_dir

#: Space and the ASCII controls 9-13; what ``bytes.split()`` splits at, too.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder under the shared checkpoint folder (readable by all executors)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor then costs a re-read, and values that depend on how rows
    were dealt (running ids) are fixed once for all readers.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of ``saved`` tables whose readers are done."""
    for df in frames:
        jvm, path = df.sparkSession.sparkContext._jvm, getattr(df, "_scratch", None)
        if path is not None:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let go of what finished steps left in the driver: plans, broadcasts and checkpoints no longer referred to.

    The driver's heap otherwise fills up to its limit before anything is let go.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_of(name: str) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_in(text: Column) -> Column:
    """Number of maximal runs of non-white characters, without building them.

    All white space becomes spaces, runs of spaces become one; the words are
    then one more than the spaces of the trimmed text.
    """
    spaced = F.trim(F.translate(text, WHITE, " " * len(WHITE)))
    single = F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced)
    gaps = F.octet_length(single) - F.octet_length(F.replace(single, F.lit(" ")))
    return F.when(single == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def text_bytes(column, rows: int = 256) -> Iterator[bytes]:
    """UTF-8 of an Arrow string column, a few hundred values in memory at a time; null is empty."""
    binary = column.cast("binary")
    for at in range(0, len(binary), rows):
        for value in binary.slice(at, rows).to_pylist():
            yield value or b""


MARK_BITS = 1 << 24


def with_mark(rows: DataFrame, key: Column, keys: DataFrame, of: Column, bits: int = MARK_BITS) -> DataFrame:
    """Add ``_hit``: false only if ``key`` is not among the values ``of`` the table ``keys``.

    A bitmap of fixed size is broadcast, at most ``bits / 64`` rows. A key
    may be hit by chance, more often the fuller the bitmap is; an exact join
    decides for the rows that are hit, the others need not move.
    """
    shift = lambda name, *args: F.call_function(name, *args)
    bit = F.pmod(F.xxhash64(of), F.lit(bits))
    marks = keys.select(F.shiftright(bit, 6).alias("_word"), shift("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("_b"))
    marks = marks.groupBy("_word").agg(F.bit_or("_b").alias("_bits"))
    own = F.pmod(F.xxhash64(key), F.lit(bits))
    placed = rows.withColumns({"_at": F.shiftright(own, 6), "_in": (own % 64).cast("int")})
    joined = placed.join(F.broadcast(marks), F.col("_at") == F.col("_word"), "left")
    hit = F.coalesce(shift("shiftright", F.col("_bits"), F.col("_in")).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
    return joined.withColumn("_hit", hit).drop("_at", "_in", "_word", "_bits")
