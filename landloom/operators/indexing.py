"""Dense sequence numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dense_index(df: DataFrame, bucket: list[Column], order: list[Column], name: str, restart: int = 0) -> DataFrame:
    """Add a 0-based index that follows (bucket, order).

    ``bucket`` must split the rows into ordered groups of bounded size (a file
    split, a range of a million positions). Rows are ranked inside their
    bucket; only the per-bucket counts - one row per bucket - go through one
    global window to become offsets. The index starts again for each value of
    the first ``restart`` bucket columns.
    """
    names = [f"_b{i}" for i in range(len(bucket))]
    keyed = df.withColumns(dict(zip(names, bucket)))
    counts = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    before = (W.partitionBy(*names[:restart]) if restart else W).orderBy(*names[restart:])
    before = before.rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(W.partitionBy(*names).orderBy(*order)) - 1
    on = None
    ranked = keyed.withColumn("_rank", rank)
    renamed = offsets.select(*[F.col(n).alias(f"o{n}") for n in names], "_offset")
    for n in names:
        cond = ranked[n].eqNullSafe(renamed[f"o{n}"])
        on = cond if on is None else on & cond
    return (
        ranked.join(renamed, on, "inner")
        .withColumn(name, (F.col("_offset") + F.col("_rank")).cast("long"))
        .drop("_offset", "_rank", *names, *[f"o{n}" for n in names])
    )
