"""The operators against plain versions on small, awkward tables."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landloom.llm import binary_ids, bpe_chunks, chat, exact_dedup, mixing, secrets, simhash, token_counts, topk, toxicity
from landloom.llm.pieces import pieces

WHITE = re.compile("[\x20\x09-\x0d]")
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, t string, fp string, name string, plan string, level int"


def table(spark, rows):
    """Rows of (id, text, source) with further columns whose names the operators use, too."""
    full = [(i, t, "en", s, len(t or ""), "k", "t", "f", "n", "p", 1) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Ünïcode", "x", "naïve", "12", "don't", "end.", "日本語", "a--b"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared = prose(900)
    long = prose(9000)
    out = [(0, None, "a"), (1, "", "a"), (2, " \t\n", None), (3, "same text", "b"), (4, "same  text\n", "b"), (5, "sametext", "c")]
    out += [(6, shared, "a"), (7, prose(50) + " " + shared, "a"), (8, shared + " " + prose(40), None), (9, shared, "d"), (9, shared, "d"), (9, "other", "d")]
    out += [(10, long, "c"), (11, long + " tail", "c"), (12, "z" * 3000, "b"), (13, "z" * 3000 + shared, "b"), (None, "no id", "a"), (None, None, None)]
    out += [(14, "say <|endoftext|> twice<|endoftext|> x   y", "d"), (15, "é é \x1c ΑΣ Σ İ", "d"), (16, "  lead   and\n\n trail  ", "e")]
    out += [(100 + i, prose(30), rng.choice("abc")) for i in range(30)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def bare(text):
    return WHITE.sub("", text or "")


def test_exact_dedup(docs, rows, none):
    want = []
    for i, t, _ in rows:
        group = [(-len(u or ""), j is None, j or 0) for j, u, _ in rows if bare(u) == bare(t)]
        best = min(group)
        want.append((i, None if best[1] else best[2], len(group), hashlib.sha256(bare(t).encode()).hexdigest()))
    for chars in (7, 4096):
        got = exact_dedup.exact_duplicates(docs, block_chars=chars).collect()
        assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got)
        kept = [r for r in got if r["kept"]]
        assert len(kept) == len({bare(t) for _, t, _ in rows})
        assert all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(kept)
    assert exact_dedup.exact_duplicates(none).count() == 0


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("per_range", [3, 10_000])
def test_mixing(docs, rows, none, per_range):
    got = mixing.mix(docs, rows_per_range=per_range).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    target = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s in sizes:
        assert sum(r["taken"] for r in got if r["source"] == s) == round(target[s])
    again = mixing.mix(docs.repartition(5), rows_per_range=per_range).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.mixed_documents(docs, rows_per_range=per_range)
    assert out.columns == docs.columns
    words = {}
    texts = {t or "" for _, t, _ in rows}
    for r in out.collect():
        assert any(t.startswith(r["text"]) for t in texts) and r["n_chars"] == len(r["text"])
        words[r["source"]] = words.get(r["source"], 0) + len(WORD.findall(r["text"]))
    assert all(words.get(s, 0) == round(target[s]) for s in sizes)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def plain_fingerprint(text):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, rows, none):
    fps = [plain_fingerprint((t or "").replace("\x1c", "\x1c")) for _, t, _ in rows]
    comp = plain_components(fps)
    low = {}
    for (i, _, _), c in zip(rows, comp):
        low[c] = min((x for x in (low.get(c), i) if x is not None), default=None)
    want = [(i, f"{f:016x}", low[c]) for (i, _, _), f, c in zip(rows, fps, comp)]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(map(str, want)) == sorted(map(str, got))
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(set(comp))
    assert simhash.near_duplicates(none).count() == 0


def test_drop_similar(spark, none):
    rng = random.Random(8)
    prose = lambda n: ["w%d" % rng.randrange(5000) for _ in range(n)]
    made, base = [], prose(300)
    for i in range(6):  # two words changed: about nine tenths of the shingles stay
        words = list(base)
        for _ in range(2):
            words[rng.randrange(300)] = f"x{i}"
        made.append((i, " ".join(words), "s"))
    for i in range(10, 14):  # thirty words changed: related, but not similar
        words = list(base)
        for k in range(0, 300, 10):
            words[k] = f"y{i}-{k}"
        made.append((i, " ".join(words), "s"))
    made += [(20 + i, " ".join(prose(40)), "s") for i in range(10)] + [(40, None, "s"), (41, "", "s"), (None, "a b", "s"), (42, "a b", "s"), (20, made[0][1], "s")]
    made += [(50, "repeated row", "s")] * 3
    docs = table(spark, made)
    left = simhash.drop_similar(docs)
    assert left.columns == docs.columns
    got = sorted((str(r["doc_id"]), r["text"]) for r in left.collect())
    want = [m for m in made if m[0] in {0, 10, 11, 12, 13, 40, 42} or (m[0] is not None and 20 <= m[0] < 30 and m[1] != made[0][1])] + [(50, "repeated row", "s")]
    assert got == sorted((str(i), t) for i, t, _ in want)
    assert simhash.drop_similar(none).count() == 0


@pytest.mark.parametrize("flips", [2, 4])
def test_simhash_crowded_segments(spark, flips):
    rng = random.Random(flips)
    fps = set()
    for _ in range(3):
        base = rng.getrandbits(64)
        for n in range(120):
            f = base
            for _ in range(rng.randint(0, flips)):
                f ^= 1 << rng.randrange(32 if n % 3 else 64)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.components(spark.createDataFrame([(f,) for f in signed], "fp long"))
    root = {r["fp"]: r["root"] for r in got.collect()}
    comp = plain_components(fps)
    pairs = {(root[s], c) for s, c in zip(signed, comp)}
    assert len(root) == len(fps) and len(pairs) == len(set(comp)) == len({r for r, _ in pairs})


def test_bpe_chunks(docs, rows, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = []
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    got = [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in bpe_chunks.encode(docs).collect()]
    assert sorted(map(str, want)) == sorted(map(str, got))
    assert bpe_chunks.encode(none, outputs=("ids_sha256",)).count() == 0


def test_chunks_follow_content():
    rng = random.Random(1)
    passage = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)).encode()
    cut = lambda t: [t[a:b] for a, b in zip([0, *bpe_chunks.cut_places(t)], bpe_chunks.cut_places(t))]
    one, two = cut(passage), cut(b"something else first " + passage)
    assert b"".join(one) == passage and len(set(one) & set(two)) > len(one) // 2
    wide = "日".encode() * 40_000
    assert all(p.decode() for p in cut(wide)) and max(map(len, cut(wide))) <= bpe_chunks.MOST


def test_joins_are_checked():
    table = pieces(public_tokenizers.path("word_bpe_49k.json"))
    text = b"the quick brown fox jumps over the lazy dog"
    ends = [18, len(text)]  # inside "fox"
    fixes = bpe_chunks.repairs(table, text, ends)
    parts = [table.words(text[:18]), table.words(text[18:])]
    assert bpe_chunks.joined(parts, fixes) == table.words(text)
    assert bpe_chunks.joined([parts[0], table.words(b"cat sat")], fixes) is None
    assert bpe_chunks.repairs(table, b"a" * 30, [10, 30]) is None


def test_token_id_files(spark, docs, rows, none, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    folder = str(tmp_path / "ids")
    manifest = binary_ids.write_ids(docs, folder, files=4)
    got = binary_ids.read_ids(manifest, folder, with_ids=True).orderBy("start").collect()
    texts = {}
    for i, x, _ in rows:
        texts.setdefault(i, []).append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is None, i or 0)) and len(got) == len(rows)
    start = 0
    for r in got:
        assert bytes(r["ids"]) in texts[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(r["ids"]) // 4, zlib.crc32(r["ids"]))
        start += r["n_tokens"]
    assert len(binary_ids.document_ids(spark, manifest, folder, 9)) == 3
    assert binary_ids.document_ids(spark, manifest, folder, 77) == []
    assert binary_ids.round_trip(none).count() == 0
    file = tmp_path / "ids" / manifest.first()["file"]
    file.write_bytes(file.read_bytes()[:-9])
    with pytest.raises(ValueError):
        binary_ids.IdFile(folder, file.name)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcde", max_size=12))
def test_lexicon_automaton(word):
    terms = [("abcde", False), ("abcdeabcde", False), ("bad", False), ("caged", True), ("dad", True)]
    got = toxicity.Lexicon(terms).match(word)
    found = []
    for i, (term, stem) in enumerate(terms):
        d = min(distance(word[:n], term) for n in range(len(word) + 1)) if stem else distance(word, term)
        if d <= toxicity.edit_limit(term):
            found.append((d, i))
    assert got == min(found, default=None)


def test_toxicity(spark, none):
    rng = random.Random(5)
    words = ["lorem", "ipsum", "dolor", "amet", "consectetur", "sed", "tempor"]
    made, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = [rng.choice(words) for _ in range(30)]
        if bad:
            text.insert(rng.randrange(30), rng.choice(["gruntling", "mumpsimus"]))
            text.insert(rng.randrange(30), "frobx" + rng.choice(["ed", "ing", "ly", "ous"]))
        made.append((i, " ".join(text), "s"))
        marks.append((i, 1, int(bad)))
    made += [(900, None, None), (901, "", "s"), (None, "lorem gruntlng frobxe", "s"), (902, 'he said "gruntling" lorem', "s")]
    docs, labels = table(spark, made), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert ("frobx", True) in model.terms and ("gruntling", False) in model.terms
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == int(i % 5 == 0) for i in range(400))
    assert got[901]["predicted"] == got[900]["predicted"] == 0 and 0 <= got[900]["score"] < 0.5
    assert [h["edits"] for h in got[None]["hits"]] == [1, 0]
    assert got[902]["hits"][0]["quoted"] and got[902]["score"] < got[5]["score"]
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == len(made) - 80 - (got[None]["predicted"] + got[902]["predicted"])
    assert toxicity.score(none, model).count() == 0
    assert toxicity.train(none, labels).terms == [] and toxicity.train(docs, labels.where("toxic = 0")).score([0.0] * 6) < 0.5


def test_top_k(spark, none):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.normal(size=37)]) for i in range(150)]
    vectors += [(200 + i, [0.5] * 37) for i in range(30)] + [(240, None), (260, [1.0, None]), (280, [float("nan")] * 37), (300, [float("inf")] * 37)]
    vectors += [(320, [1.0, 2.0]), (340, []), (20, vectors[20][1]), (None, [1.0] * 37), (360, [1e12] * 37)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    ints = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in {i for i, _ in ints if i % 20 == 0}:
        own = next(v for i, v in ints if i == q)
        scores = sorted(((-sum(a * b for a, b in zip(own, v)), i) for i, v in ints if i != q))[:20]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    small = lambda rows: sorted(r for r in rows if 360 not in r[:3])
    got = [tuple(r) for r in topk.top_k(df).collect()]
    assert len(got) == len(want) and small(got) == small(want)
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


def test_top_k_prunes_exactly():
    rng = np.random.default_rng(7)
    c = rng.integers(-60, 60, (48, 900))
    c[:, :300] = c[:, [0]]  # ties
    q = rng.integers(-60, 60, (48, 25))
    ids = rng.permutation(900)
    for i, found, scores in topk.best_of_block(q, np.full(25, -1), c, ids, 20, step=8):
        full = c.T @ q[:, i]
        order = np.lexsort((ids, -full))[:20]
        assert found.tolist() == ids[order].tolist() and scores.tolist() == full[order].tolist()


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "", "User", "a\nb: ~%"]), st.lists(st.sampled_from(["\\", "### ", "</turn>", "\n", "a", "###", "User:", " "]), max_size=12).map("".join))
def test_turns_read_back(role, text):
    reader = chat.TurnReader()
    made = chat.render(role, text)
    assert [(r, t) for r, _, _, t in reader.feed(made + made)] == [(role, text)] * 2
    reader.close()


def test_chat(spark):
    said = "\\### Assistant: </turn> ok"
    turns = [(1, 1, "assistant", "hi\n</turn>\n"), (1, 0, "user", None), (1, 2, None, "odd"), (-7, 0, "user", said), (-7, 1, "assistant", said), (None, 5, "assistant", ""), (None, None, "x", "last")]
    df = spark.createDataFrame([(*t, "e", 1) for t in turns], "conv_id long, turn long, role string, text string, rendered string, n int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    whole = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    for conv in (1, -7, None):
        own = sorted(((t[1] is None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = [x for _, _, r, x in own if r == "assistant"]
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"]) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (row["loss_chars"], row["loss_sha256"]) == (len("".join(loss)), hashlib.sha256("".join(loss).encode()).hexdigest())
        assert row["formatted_chars"] == len(whole[conv]["formatted"])
        spans = [chat.unescaped(whole[conv]["formatted"][s["start"] : s["end"]]) for s in whole[conv]["loss_spans"]]
        assert spans == loss
    assert chat.read_back(chat.format_turns(df.where("conv_id = 99"))).count() == 0


def greedy(word, vocabulary):
    n = 0
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), None)
        if size is None:
            return 1
        word, n = word[size:], n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12), st.lists(st.sampled_from(b"abc"), max_size=14).map(bytes))
def test_longest_match(vocabulary, word):
    assert token_counts.LongestMatch(vocabulary).count(word) == greedy(word, vocabulary)


def test_token_counts(docs, rows, none):
    known = set(token_counts.byte_level_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    want = [(i, len(w := (t or "").encode().split()), sum(greedy(b" " + x, known) for x in w)) for i, t, _ in rows]
    got = [tuple(r) for r in token_counts.token_counts(docs).collect()]
    assert sorted(map(str, want)) == sorted(map(str, got))
    assert token_counts.token_counts(none).count() == 0


def test_secret_scan(spark, none):
    rng = random.Random(9)
    made = [(None, None, None), (0, "", "s")]
    for i in range(1, 120):
        text = " ".join(rng.choice(["lorem", "ipsum", "dolor"]) for _ in range(20))
        if i % 3 == 0:
            text += f' token = "{rng.getrandbits(160):040x}" amet'
        elif i % 3 == 1:
            text += f" see page/lorem_ipsum_dolor_{i % 10} and build-2024-lorem-ipsum-{i}"
        made.append((i, text, "s"))
    docs = table(spark, made)
    found = secrets.candidates(docs).collect()
    texts = dict((i, t) for i, t, _ in made)
    assert all(texts[r["doc_id"]][r["start"] :].startswith(r["value"]) for r in found)
    got = secrets.scan(docs).collect()
    assert len(got) == len(found) and all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got)
    reviewed = spark.createDataFrame([(r["doc_id"], r["start"], r["doc_id"] % 3 != 0) for r in found], "doc_id long, start long, label boolean")
    assert all(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in secrets.scan(docs, reviewed.withColumn("label", F.col("label").cast("int"))).collect())
    assert secrets.scan(none).count() == 0 and json.dumps(secrets.FEATURES)
