"""Mixing sources to target weights.

Every row gets a hash-random key; rows are ranged by that key within their
source, sizes are summed up to each row, and the source is cut at its budget.
A budget above the size of the source repeats it: whole epochs, then the cut.
Only DataFrame functions are used.

Scale. A source is split into ranges of the key, so a source that holds a third
of all rows is spread over as many tasks as its rows need; only one sum per
(source, range) and one row per source go through a window of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.llm.common import WHITE, saved, text_of, words_in

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
ROWS_PER_RANGE = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows.

    Weights repeat over the sources by code point (null last). A target stops
    at ``most_epochs`` times its source; what is above is shared again by weight.
    In the end all sources below their limit have the same target per unit
    of weight; that level is found from sums over the sources in the order in
    which they reach their limit. One row per source takes part.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = total.withColumn("_w", weight).withColumn("_limit", F.col("source_size") * float(most_epochs))
    by_fill = W.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = ranked.withColumns(
        {
            "_full": F.coalesce(F.sum("_limit").over(before), F.lit(0.0)),
            "_open": F.sum("_w").over(onward),
            "_all": F.sum("source_size").over(W.partitionBy()),
        }
    )
    level = (F.col("_all") * float(share) - F.col("_full")) / F.col("_open")
    # The level is right at the first source that does not reach its limit.
    fits = level * F.col("_w") <= F.col("_limit")
    first = F.first(F.when(fits, level), ignorenulls=True).over(by_fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ranked = ranked.withColumn("_level", first)
    target = F.when(F.col("_level").isNull(), F.col("_limit")).otherwise(F.least("_limit", F.col("_level") * F.col("_w")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: int = MOST_EPOCHS,
    seed: str = SEED,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` per input row.

    ``size`` is the number of words (null text: 0). ``taken`` counts the words
    the mix takes, repeats included: every whole epoch takes the row once, the
    last, partial epoch takes rows in key order up to the budget, and the row
    at the cut in part, so a source's taken words equal its target rounded to
    whole words. Null ids and null sources are ordinary values; repeated rows
    are rows of their own; empty texts take nothing. The key is MD5 of the id
    and ``seed``: reruns agree.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(text_of(text_col)).alias("size"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed)))
    rows = saved(rows.withColumn("_key", key), "sizes")
    ranges = max(1, min(1 << 20, rows.count() // max(1, int(rows_per_range))))
    ranged = rows.withColumn("_range", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32)).cast("int"))

    sums = ranged.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    upto = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_offset"))
    targets = source_targets(rows.select("source", "size"), weights, share, most_epochs)
    plan = targets.withColumns({"_budget": F.round("target").cast("long"), "_t": F.col("source")}).drop("source")
    starts = sums.join(plan, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")

    within = W.partitionBy("source", "_range").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size")
    placed = ranged.withColumn("_before", F.coalesce(F.sum("size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("_budget") - epochs * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("_offset") - F.col("_before")))
    taken = epochs * F.col("size") + part
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th word (``n`` at least 1)."""
    # All white space characters are one byte and one character, so places in
    # the translated text are places in the text.
    spaced = F.translate(text, WHITE, " " * len(WHITE))
    lead = F.length(spaced) - F.length(F.ltrim(spaced))
    body = F.substr(spaced, lead + 1)
    parts = F.split(body, " ")
    # Position of the n-th non-empty part: walk over the gaps once.
    walk = F.aggregate(
        parts,
        F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("end")),
        lambda a, p: F.struct(
            (a["words"] + F.when(p == "", 0).otherwise(1)).cast("long").alias("words"),
            (a["chars"] + F.length(p) + 1).cast("long").alias("chars"),
            F.when((p != "") & (a["words"] + 1 == n), a["chars"] + F.length(p)).otherwise(a["end"]).cast("long").alias("end"),
        ),
    )
    return F.substr(text, F.lit(1), (lead + walk["end"]).cast("int"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as rows of ``docs``: a row per repeat, columns as they were.

    A row that the cut meets is given with its first words only (``n_chars``,
    where present, follows); rows that the mix does not take go. A repeated
    id with several texts takes what each of its rows takes.
    """
    plan = mix(docs, id_col, text_col, source_col, **options)
    plan = plan.where("taken > 0").groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("_taken"), F.count(F.lit(1)).alias("_rows"))
    plan = plan.select(F.col("doc_id").alias("_p_id"), F.col("source").alias("_p_source"), F.col("size").alias("_p_size"), "_taken")
    tagged = docs.withColumns({"_d_id": F.col(id_col).cast("long"), "_d_source": F.col(source_col).cast("string"), "_d_size": words_in(text_of(text_col))})
    copy = W.partitionBy("_d_id", "_d_source", "_d_size")
    tagged = tagged.withColumn("_copy", F.row_number().over(copy.orderBy(F.xxhash64(*[F.col(c) for c in docs.columns]))))
    tagged = tagged.withColumn("_copies", F.count(F.lit(1)).over(copy))
    same = F.col("_d_id").eqNullSafe(F.col("_p_id")) & F.col("_d_source").eqNullSafe(F.col("_p_source")) & (F.col("_d_size") == F.col("_p_size"))
    joined = tagged.join(plan, same)
    # Copies of one row share what they take: whole words first, then the rest.
    own = F.floor(F.col("_taken") / F.col("_copies")) + F.when(F.col("_copy") <= F.col("_taken") % F.col("_copies"), 1).otherwise(0)
    joined = joined.withColumn("_own", own)
    whole = F.floor(F.col("_own") / F.col("_d_size")).cast("int")
    rest = F.col("_own") % F.col("_d_size")
    sizes = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    out = joined.withColumn("_words", F.explode(sizes))
    cut = F.when(F.col("_words") < 0, F.col(text_col)).otherwise(first_words(F.col(text_col), F.col("_words")))
    out = out.withColumn(text_col, cut)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_words") < 0, F.col("n_chars")).otherwise(F.length(text_col)).cast(kind))
    return out.select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1') AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size) * 2.0::DOUBLE AS lim,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source
), f AS (
  SELECT *, coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS every
  FROM s WINDOW o AS (ORDER BY lim / w, source NULLS LAST)
), l AS (SELECT *, (every * 1.5::DOUBLE - reached) / open AS level FROM f),
t AS (
  SELECT source, source_size, least(lim, coalesce((SELECT arg_min(level, lim / w) FROM l WHERE level * w <= lim) * w, lim)) AS target FROM l
), p AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM d
), e AS (
  SELECT p.*, t.source_size, t.target, round(t.target)::BIGINT AS budget,
         CASE WHEN t.source_size > 0 THEN round(t.target)::BIGINT // t.source_size ELSE 0 END AS ep FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target, (ep * size + least(size, greatest(0, budget - ep * source_size - bef)))::BIGINT AS taken FROM e
"""
