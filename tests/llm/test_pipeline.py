"""The corpus pipeline, stage by stage, against plain versions."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from landloom.llm.simhash import SEED, set_fingerprints

SEEDS = (SEED, 1, 2, 3)


def check_stays(texts, kept):
    """No linked and similar texts both stay; each text that went has a similar one in its group."""
    fps = {i: [f & (2**64 - 1) for f in set_fingerprints(t.encode(), SEEDS)] for i, t in texts.items()}
    shingles = {}
    for i, t in texts.items():
        w = t.lower().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    def alike(i, j):
        return len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])

    for i in kept:
        for j in kept:
            linked = any((a ^ b).bit_count() <= 3 for a, b in zip(fps[i], fps[j]))
            assert i == j or not (linked and alike(i, j))
    for i in set(texts) - set(kept):
        assert any(i != j and alike(i, j) for j in texts)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do", "eius", "tempor", "magna", "aliqua"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, labels = [], []
    for i in range(160):
        toxic = i % 8 == 0
        text = prose(60) + (" gruntling " + prose(5) + " mumpsimus" if toxic else "")
        docs.append((i, text, "en", rng.choice(["a", "b", None]), len(text)))
        labels.append((i, 1, int(toxic)))
    long = prose(700)
    docs += [(200 + i, long + " " * i, "en", "a", len(long) + i) for i in range(4)]
    docs += [(300 + i, long.replace("lorem", "LOREM", 1) + f" {rng.choice(words)}", "en", "b", 0) for i in range(3)]
    docs += [(400, None, "en", "a", 0), (401, "", "en", None, 0)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), docs


def test_stages(spark, corpus, tmp_path):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {"": docs}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != "bpe":
            assert docs.columns == columns
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in kept.items()}
    assert sorted(ids["toxicity"]) == sorted(i for i, *_ in rows if not (i < 160 and i % 8 == 0))
    text = {i: t or "" for i, t, *_ in rows}
    bare = {}
    for i in ids["toxicity"]:
        bare.setdefault("".join(text[i].split()), []).append((-len(text[i]), i))
    assert sorted(ids["exact_dedup"]) == sorted(min(g)[1] for g in bare.values())
    check_stays({i: text[i] for i in ids["exact_dedup"]}, ids["near_dedup"])
    assert {203} == {200, 201, 202, 203} & set(ids["near_dedup"]) and len({300, 301, 302} & set(ids["near_dedup"])) < 3
    mixed = kept["mix"].collect()
    assert {r["doc_id"] for r in mixed} <= set(ids["near_dedup"]) and all(text[r["doc_id"]].startswith(r["text"]) for r in mixed)
    sizes = {s: sum(len((r["text"] or "").split()) for r in kept["near_dedup"].collect() if r["source"] == s) for s in ("a", "b", None)}
    taken = {s: sum(len(r["text"].split()) for r in mixed if r["source"] == s) for s in sizes}
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 3 and all(taken[s] <= 2 * sizes[s] for s in sizes)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in mixed:
        tokens = t.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], len(tokens), hashlib.sha256(t.decode(tokens, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in kept["bpe"].collect()]
    assert sorted(want) == sorted(got)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix", "bpe"]
