"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of characters. Distinct blocks
are sorted and numbered; the numbers of adjacent blocks are paired, distinct
pairs are sorted and numbered again, and so on until one number is left per
text. Texts of equal length in blocks finish in the same round, so
(round, number) is the same for two texts exactly when the texts are equal: the
numbers come from comparing contents, never from a hash alone. Only DataFrame
functions are used.

Scale. Block contents are shuffled once, after each task has dropped its own
repeats, so a text that a third of all rows share moves once per task. All
later rounds move integers, and each halves the rows of the texts still open.
The number of rounds is the logarithm of the longest text's block count. Rows
find the number of their block by the block's SHA-256; if two different blocks
had the same digest the job would stop with an error instead of merging them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.llm.common import WHITE, discard, saved, text_of

BLOCK_CHARS = 4096


def without_white(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def _numbered(distinct_rows: DataFrame, *by: str) -> DataFrame:
    """Sort the distinct rows within their partitions and number them."""
    return distinct_rows.sortWithinPartitions(*by).withColumn("_name", F.monotonically_increasing_id())


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: ``doc_id, text_sha256, n_code_points, level, name``.

    ``(level, name)`` is equal for two rows exactly when their texts without
    white space are equal. Null texts count as empty; empty texts are one
    block of their own. Repeated rows (same id, same text) give repeated
    rows. Other columns of ``docs`` are ignored, whatever their names.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("n_code_points"), without_white(text).alias("_norm"))
    cut = F.regexp_extract_all("_norm", F.lit(f"(?s).{{1,{int(block_chars)}}}"), F.lit(0))
    blocks = F.when(F.col("_norm") == "", F.array(F.lit(""))).otherwise(cut)

    contents = rows.select(F.explode(blocks).alias("_block")).distinct()
    numbers = saved(_numbered(contents, "_block").select(F.unhex(F.sha2("_block", 256)).alias("_digest"), "_name"), "blocks")
    clash = F.raise_error(F.lit("two different blocks share a SHA-256 digest"))
    names = numbers.groupBy("_digest").agg(F.min("_name").alias("_name"), F.count(F.lit(1)).alias("_n"))
    names = names.select("_digest", F.when(F.col("_n") == 1, F.col("_name")).otherwise(clash.cast("long")).alias("_name"))

    cells = rows.select("doc_id", "n_code_points", F.unhex(F.sha2("_norm", 256)).alias("_sha"), blocks.alias("_blocks"))
    cells = cells.withColumn("_left", F.size("_blocks")).select("doc_id", "n_code_points", "_sha", "_left", F.posexplode("_blocks").alias("_pos", "_block"))
    cells = saved(cells.withColumn("_digest", F.unhex(F.sha2("_block", 256))).drop("_block"), "cells")

    deepest = cells.agg(F.max("_left")).first()[0] or 0
    current = cells.select("doc_id", "_sha", "_left", "_pos", "_digest").join(names, "_digest").drop("_digest")
    used = [numbers, cells]
    done = [current.where("_left = 1").select("doc_id", "_sha", F.lit(0).alias("level"), "_name")]
    level = 0
    while deepest > 1:
        level, deepest = level + 1, (deepest + 1) // 2
        one = F.col("_pos") % 2
        pairs = (
            current.where("_left > 1")
            .groupBy("doc_id", "_sha", F.floor((F.col("_left") + 1) / 2).cast("int").alias("_left"), F.shiftright("_pos", 1).alias("_pos"))
            .agg(F.max(F.when(one == 0, F.col("_name"))).alias("_a"), F.coalesce(F.max(F.when(one == 1, F.col("_name"))), F.lit(-1)).alias("_b"))
        )
        pairs = saved(pairs, f"pairs{level}")
        numbers = saved(_numbered(pairs.select("_a", "_b").distinct(), "_a", "_b"), f"names{level}")
        used += [pairs, numbers]
        current = pairs.join(numbers, ["_a", "_b"]).select("doc_id", "_sha", "_left", "_pos", "_name")
        done.append(current.where("_left = 1").select("doc_id", "_sha", F.lit(level).alias("level"), "_name"))
    named = done[0].distinct()
    for more in done[1:]:
        named = named.unionByName(more.distinct())

    first = cells.where("_pos = 0").select(F.col("doc_id").alias("_id"), F.col("_sha").alias("_key"), "n_code_points")
    joined = first.join(named, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("_sha")))
    out = saved(joined.select("doc_id", F.lower(F.hex("_sha")).alias("text_sha256"), "n_code_points", "level", F.col("_name").alias("name")), "identities")
    discard(*used)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_code_points`` per input row.

    Of rows with equal texts (white space aside) the one with the most code
    points in its original text stays, then the smallest ``doc_id``; null ids
    come last. Of repeated rows with one id and one text exactly one is
    ``kept``. An empty table gives an empty result.
    """
    rows = block_identities(docs, id_col, text_col, block_chars)
    order = F.struct((-F.col("n_code_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
    groups = rows.groupBy("level", "name").agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    copy = F.row_number().over(W.partitionBy("doc_id", "text_sha256", "n_code_points").orderBy("level"))
    joined = rows.withColumn("_copy", copy).join(groups, ["level", "name"])
    kept = F.col("doc_id").eqNullSafe(F.col("_best.c")) & (F.col("n_code_points") == -F.col("_best.a")) & (F.col("_copy") == 1)
    return joined.select("doc_id", F.col("_best.c").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "n_code_points")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with one row left of each group of equal texts, columns as they were."""
    stay = exact_duplicates(docs, id_col, text_col, block_chars).where("kept")
    stay = stay.select(F.col("doc_id").alias("_stay_id"), F.col("text_sha256").alias("_stay_sha"), F.col("n_code_points").alias("_stay_n"))
    text = text_of(text_col)
    tagged = docs.withColumns({"_row_sha": F.sha2(without_white(text), 256), "_row_n": F.length(text), "_row_id": F.col(id_col).cast("long")})
    same = F.col("_row_id").eqNullSafe(F.col("_stay_id")) & (F.col("_row_sha") == F.col("_stay_sha")) & (F.col("_row_n") == F.col("_stay_n"))
    left = tagged.join(stay, same)
    copy = F.row_number().over(W.partitionBy("_row_id", "_row_sha", "_row_n").orderBy(F.xxhash64(*[F.col(c) for c in docs.columns])))
    return left.withColumn("_copy", copy).where("_copy = 1").select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), k AS (
  SELECT doc_id, sha256(t) AS text_sha256, count(*) OVER g AS group_size, first_value(doc_id) OVER (g ORDER BY n DESC, doc_id NULLS LAST) AS keep_id
  FROM d WINDOW g AS (PARTITION BY t)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
