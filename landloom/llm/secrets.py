"""Secret scan: candidate strings judged by a random forest.

Long runs of letters, digits and the signs of encoded keys are candidates. Each is
described by its length, its character transitions, how much of it dictionary
words cover, where it stands (path) and the words before it. A random forest
trained on labelled findings then keeps the real ones.

Scale. Texts are read in place; only candidates, a few dozen bytes each, go on.
The dictionary counts the words of all texts and keeps the ``DICTIONARY_WORDS``
most frequent; the forest is fitted on at most ``TRAIN_FINDINGS`` findings; every
candidate of every text is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.llm.common import saved, text_of

LEAST = 16
TRAIN_FINDINGS = 20_000
DICTIONARY_WORDS = 20_000
LONGEST = 32
TREES, DEPTH, SEED = 30, 8, 11
RUN = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")
#: Words that name a secret, and marks that assign one.
KEY_WORDS = frozenset("token secret password passwd pwd key apikey api_key access_key auth bearer credential private".split())
ASSIGN = re.compile(r"[=:]\s*[\"']?$")
FEATURES = (
    "length", "digit_share", "upper_share", "hex_share", "sign_share", "distinct_share", "entropy", "class_changes",
    "vowel_runs", "dictionary_share", "key_word_near", "assigned", "quoted", "path_known", "words_before", "place",
)

CANDIDATE = "doc_id long, path string, start long, value string, before string, after string"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Every candidate of every text: ``doc_id, path, start, value, before, after``.

    ``start`` counts characters. Runs with no digit at all are words and no
    candidates. Null and empty texts have none; a missing path is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CANDIDATE.split(", ")]
        for batch in batches:
            rows = []
            for doc, path, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "path", "t"))):
                for m in RUN.finditer(text):
                    if not m[0].isalpha() and any(c.isdigit() for c in m[0]):
                        rows.append((doc, path, m.start(), m[0], text[max(0, m.start() - 48) : m.start()], text[m.end() : m.end() + 8]))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), text_of(text_col).alias("t")).mapInArrow(run, CANDIDATE)


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> frozenset[str]:
    """The most frequent words of all texts, of at most ``LONGEST`` letters."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(text_of(text_col)), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("w"))
    counted = found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.length("w") <= LONGEST)
    return frozenset(r["w"] for r in counted.orderBy(F.desc("n"), "w").limit(words).collect())


def covered(value: str, known: frozenset[str], longest: int) -> float:
    """Share of the characters that dictionary words can cover without overlap."""
    text, best = value.lower(), [0] * (len(value) + 1)
    for i in range(1, len(text) + 1):
        best[i] = best[i - 1]
        for n in range(3, min(longest, i) + 1):
            if best[i - n] + n > best[i] and text[i - n : i] in known:
                best[i] = best[i - n] + n
    return best[-1] / len(text)


def describe(value: str, before: str, after: str, path: str, start: int, known: frozenset[str], longest: int) -> list[float]:
    n = len(value)
    counts = Counter(value)
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    near = re.findall(r"[a-z_]+", before.lower())[-4:]
    return [
        math.log(n),
        kind.count("d") / n,
        kind.count("u") / n,
        sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        kind.count("s") / n,
        len(counts) / min(n, 64),
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        sum(a != b for a, b in zip(kind, kind[1:])) / n,
        len(re.findall(r"[aeiou]+", value.lower())) / n,
        covered(value, known, longest),
        float(not KEY_WORDS.isdisjoint(near)),
        float(ASSIGN.search(before) is not None),
        float(before[-1:] in "\"'" and before != "" and after[:1] == before[-1:]),
        float(bool(re.search(r"\.(env|ya?ml|json|ini|cfg|conf|pem|key|properties)$", path.lower()))),
        float(len(near)),
        math.log1p(start),
    ]


def featured(found: DataFrame, known: frozenset[str]) -> DataFrame:
    """Candidates with their feature vector."""
    longest = max(map(len, known), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("value", "before", "after", "path", "start")))
            x = [describe(*r, known, longest) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.list_(pa.float64()))], [*batch.schema.names, "x"])

    return found.mapInArrow(run, CANDIDATE + ", x array<double>").withColumn("features", array_to_vector("x")).drop("x")


def rule_label() -> Column:
    """Findings labelled by where they stand: a quoted value assigned to a word that names a secret."""
    words = "|".join(sorted(KEY_WORDS))
    return F.col("before").rlike(rf"(?i)(^|[^a-z])({words})\s*[=:]\s*[\"']$").cast("double")


def fit(findings: DataFrame, rows: int = TRAIN_FINDINGS, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel | float:
    """A forest from ``features, label``; with one label alone, that label (0 without any).

    At most ``rows / 2`` findings of each label take part, those of least hash over id, place and value.
    """
    some = lambda c: findings.where(c).orderBy(F.xxhash64("doc_id", "start", "value"), "doc_id", "start").limit(rows // 2)
    bounded = saved(some(F.col("label") > 0).unionByName(some(F.col("label") <= 0)).select("features", "label"), "findings")
    kinds = [r["label"] for r in bounded.select("label").distinct().collect()]
    if len(kinds) < 2:
        return float(kinds[0]) if kinds else 0.0
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featuresCol="features", labelCol="label").fit(bounded)


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``doc_id, path, start, value, score, predicted`` of every candidate.

    ``findings`` (``doc_id, start, label``) are reviewed candidates; without
    them the placement rule labels those in texts with an odd id, and the
    forest, which never sees a value itself, is applied to all. With one kind of label
    alone every candidate gets that label. Repeated rows are scanned once per row.
    """
    known = dictionary(docs, text_col)
    found = saved(featured(candidates(docs, id_col, text_col, path_col), known), "candidates")
    if findings is None:
        labelled = found.where(F.col("doc_id") % 2 != 0).withColumn("label", rule_label())
    else:
        labels = findings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("label").cast("double").alias("label"))
        labelled = found.join(labels, ["doc_id", "start"])
    model = fit(labelled)
    keep = ["doc_id", "path", "start", "value"]
    if isinstance(model, float):
        return found.select(*keep, F.lit(model).alias("score"), F.lit(int(model)).alias("predicted"))
    scored = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
