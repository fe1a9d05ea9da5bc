"""FeatureCollection files read in byte ranges, so that one file of any size is many tasks.

Spark's text source deals a file out in ranges and cuts it at ``}``. Whether a
place of the file is inside a string, and how deep it is nested, hangs on all that comes
before; but what a range does to both can be told without knowing where it starts,
once for a start outside and once for one inside a string. So a first pass gives one row per range,
these are composed in file order, and a second pass, now knowing its start, cuts its range into
features. Only the piece before the first end and the one after the last end of a
range meet their other parts in a shuffle; whole features stay in their task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.session import checkpointed

ESCAPED = re.compile(r"\\.", re.S)
FEATURES = re.compile(r'"features"\s*:\s*\[')
#: Depth inside the collection's object, and inside its array of features.
ROOT, ARRAY = 1, 2


def structure(text: str) -> tuple[bool, int, int]:
    """Whether ``text`` has an odd number of quotes; its change of depth if it starts outside, and inside a string."""
    parts = ESCAPED.sub("", text).split('"')
    sides = "".join(parts[::2]), "".join(parts[1::2])
    out, within = (s.count("{") + s.count("[") - s.count("}") - s.count("]") for s in sides)
    return len(parts) % 2 == 0, out, within


class _Place:
    """Where a reader is: in a string or not, and the depth for both kinds of start."""

    def __init__(self, odd: bool = False, depths: tuple[int, int] = (0, 0)):
        self.odd, self.depths = odd, depths

    def after(self, text: str) -> _Place:
        odd, out, within = structure(text)
        a, b = (within, out) if self.odd else (out, within)
        return _Place(self.odd != odd, (self.depths[0] + a, self.depths[1] + b))


def _pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    rows = spark.read.option("lineSep", "}").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("split"), "value")


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, str]]:
    """``(source, split, number in the split, text)``; a split's rows come together, in file order."""
    at, no = None, 0
    for batch in batches:
        for source, split, value in zip(*(batch.column(c).to_pylist() for c in ("source", "split", "value"))):
            no = no + 1 if at == (source, split) else 0
            at = source, split
            yield source, split, no, value


FACTS = "source string, split long, kind string, no long, odd boolean, depth0 long, depth1 long, empty boolean"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does, and where in it the array of features may begin or end."""
    names, rows, at, place = [f.split()[0] for f in FACTS.split(", ")], [], None, _Place()

    def row(kind: str, no: int, where: _Place, empty: bool = False) -> None:
        rows.append((*at, kind, no, where.odd, *where.depths, empty))

    for source, split, no, value in _in_order(batches):
        if at != (source, split):
            if at:
                row("split", -1, place)
            at, place = (source, split), _Place()
        found = FEATURES.search(value)
        if found:
            row("begin", no, place.after(value[: found.start()]), value[found.end() :].lstrip().startswith("]"))
        if value.lstrip().startswith("]"):
            row("end", no, place)
        place = place.after(value + "}")
    if at:
        row("split", -1, place)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def split_starts(facts: DataFrame) -> DataFrame:
    """``source, split, odd, depth`` at each split's start, and ``begin, end`` of the file's features as ``(split, no)``."""
    before = W.partitionBy("source").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    depth: Column = F.when(F.col("start_odd"), F.col("depth1")).otherwise(F.col("depth0"))
    splits = facts.where("kind = 'split'").withColumn("start_odd", sum_before(F.col("odd").cast("long")) % 2 == 1)
    splits = splits.withColumn("start_depth", sum_before(depth)).select("source", "split", "start_odd", "start_depth")
    marks = facts.where("kind <> 'split'").join(splits, ["source", "split"]).where("odd = start_odd")
    marks = marks.select("source", "kind", "empty", F.struct("split", "no").alias("at"), (F.col("start_depth") + depth).alias("depth"))
    begins = marks.where(f"kind = 'begin' AND depth = {ROOT}").groupBy("source").agg(F.min(F.struct("at", "empty")).alias("b"))
    ends = marks.where(f"kind = 'end' AND depth = {ARRAY}").select("source", "at").join(begins, "source").where("at > b.at")
    ends = ends.groupBy("source").agg(F.min("at").alias("end"))
    known = begins.join(ends, "source", "left").select(
        "source", F.col("b.at").alias("begin"), F.when(F.col("b.empty"), F.col("b.at")).otherwise(F.col("end")).alias("end")
    )
    return splits.join(known, "source", "left")


FOUND = "source string, split long, no long, part string, text string"


def _cut(starts):
    """Second pass: whole features, and the pieces at the seams of splits (``part``: whole, head, through, tail)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        at, held, seam, place, size = None, [], True, _Place(), 0

        def close() -> None:
            if at is not None and held:
                rows.append((*at, last, "through" if seam else "tail", "".join(held)))

        for source, split, no, value in _in_order(batches):
            if at != (source, split):
                close()
                at, held, seam = (source, split), [], True
                odd, depth, begin, end = starts.value[at]
                place = _Place(odd, (depth, depth))
            last, text = no, value + "}"
            if begin is None:
                held.append(text)  # no collection: one row for the file, put together below
                continue
            begins = (split, no) == begin
            if begins:
                seam, text = False, value[FEATURES.search(value).end() :] + "}"
            place = place.after(value + "}")
            if (split, no) < begin or (end is not None and (split, no) >= end):
                if (split, no) == end:
                    close()
                    held = []
                continue
            held.append(text)
            size += len(text)
            if not place.odd and place.depths[0] == ARRAY:
                rows.append((*at, no, "head" if seam else "whole", "".join(held)))
                held, seam = [], False
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names) if rows else empty
                rows, size = [], 0
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    names = [f.split()[0] for f in FOUND.split(", ")]
    empty = pa.RecordBatch.from_arrays([pa.array([], k) for k in (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())], names)
    return run


def collection_features(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``source, split, no, feature``: the features of the files, in order of (source, split, no).

    A FeatureCollection gives the objects of its ``features``, a file of one
    Feature gives itself, other files nothing. Members before and after ``features``, braces and quotes
    in strings, and escapes are no hindrance.
    """
    pieces = _pieces(spark, paths)
    facts = checkpointed(pieces.mapInArrow(_facts, FACTS))
    # One short row per file range, as in the list of ranges the driver schedules from.
    known = {}
    for r in split_starts(facts).toLocalIterator():
        known[r["source"], r["split"]] = (r["start_odd"], r["start_depth"], r["begin"] and tuple(r["begin"]), r["end"] and tuple(r["end"]))
    found = pieces.mapInArrow(_cut(spark.sparkContext.broadcast(known)), FOUND)
    whole = found.where("part = 'whole'").select("source", "split", "no", "text")
    heads = W.partitionBy("source").orderBy("split", "no").rowsBetween(W.unboundedPreceding, -1)
    seams = found.where("part <> 'whole'")
    seams = seams.withColumn("_g", F.coalesce(F.sum(F.when(F.col("part") == "head", 1).otherwise(0)).over(heads), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("split", "no", "text")))
    joined = seams.groupBy("source", "_g").agg(F.max(F.struct("split", "no")).alias("_at"), parts.alias("_p"), F.max((F.col("part") == "head").cast("int")).alias("_ends"))
    joined = joined.withColumn("text", F.array_join(F.transform("_p", lambda p: p["text"]), ""))
    # A seam without an end is a file without a collection, or what follows the last feature.
    single = F.get_json_object("text", "$.type") == "Feature"
    joined = joined.where((F.col("_ends") == 1) | single).select("source", "_at.split", "_at.no", "text")
    every = whole.unionByName(joined)
    return every.select("source", "split", "no", F.substr("text", F.greatest(F.lit(1), F.instr("text", "{"))).alias("feature"))
