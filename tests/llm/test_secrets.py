"""Secret scan: dictionary of all texts, rare labels, long values."""

import random

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from landloom.llm import secrets


def test_dictionary_counts_all_texts(spark):
    letters = F.translate(F.lpad(F.col("id").cast("string"), 5, "0"), "0123456789", "abcdefghij")
    docs = spark.range(5500).select(F.concat(F.lit("Größe "), letters).alias("text"))
    known = secrets.dictionary(docs)
    assert len(known) == 5501 and "größe" in known


def test_rare_label_is_learned(spark):
    rng = random.Random(1)
    made = [(i, 0, f"v{i}", [float(i % 100 == 7), rng.random()], float(i % 100 == 7)) for i in range(300)]
    rows = spark.createDataFrame(made, "doc_id long, start long, value string, x array<double>, label double").withColumn("features", array_to_vector("x"))
    model = secrets.fit(rows, rows=8)
    assert not isinstance(model, float) and model.numClasses == 2
    assert secrets.fit(rows.where("label = 0"), rows=8) == 0.0 and secrets.fit(rows.where("label = 1"), rows=8) == 1.0


def test_cover_of_the_whole_value():
    x = secrets.describe("1" * 300 + "lorem" * 60, "", "", "", 0, frozenset(["lorem"]), 5)
    assert x[secrets.FEATURES.index("dictionary_share")] == 0.5
