"""Conversation repair, BPE by distinct words, Merkle manifest: against brute force and the library."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from landloom.llm import distinct_words, merkle, turn_repair


# -- conversation repair ------------------------------------------------------------------------------------------


def every_edit(rows):
    """Cheapest (cost, audit, repaired rows) over all edits; rows are (role, text, fault)."""
    best = []

    def go(i, said, cost, audit, run):
        roles = [r for r, _ in said]
        state = 0 if not said else 1 if roles == ["s"] or (len(said) == 1 and roles[0][:1] == "s") else 2 if roles[-1][:1] == "u" else 3
        if i == len(rows) and state in (0, 3):
            best.append((cost, audit, said))
        expected = "assistant" if state == 2 else "user"
        if run < 3:
            go(i, [*said, (expected, "")], cost + 2, audit + "I", run + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, said, cost + 3, audit + "D", 0)
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                go(i + 1, [*said, (expected, text)], cost + 2 + more, audit + "R", 0)
                if role[:1] == expected[:1] or (state == 0 and role[:1] == "s"):
                    go(i + 1, [*said, (role, text)], cost + more, audit + "K", 0)

    go(0, [], 0, "", 0)
    return min(best, key=lambda b: b[:2])


def white(text):
    return text.strip(" \t\n\x0b\x0c\r")


def plain_summary(rows):
    """The contract, row by row: rows are (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fate == 1 else regex.sub("[.!?]", "", text) if fate == 2 else text
            own += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, role, text in own:
            fault = "blank" if not white(text) else "duplicate" if (role, text) in seen else "truncated" if white(text)[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        cost, audit, said = every_edit(faulty)
        counts = [sum(f == kind for *_, f in faulty) for kind in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return out


def test_edits_are_the_cheapest_and_first_in_order():
    draw = random.Random(3)
    cases = [c for n in range(3) for c in itertools.product(range(12), repeat=n)] + [[draw.randrange(12) for _ in range(4)] for _ in range(60)]
    for codes in cases:
        roles, faults = ("system", "user", "assistant", "tool"), ("", "truncated", "blank")
        want = every_edit([(roles[c // 3], "x", faults[c % 3]) for c in codes])[:2]
        for segment in (1, 2, 256):
            assert turn_repair.cheapest_edits(bytes(codes), segment) == want


def test_long_conversations_agree_over_segments():
    draw = random.Random(4)
    for _ in range(30):
        codes = bytes(draw.choice((0, 3, 4, 5, 6, 6, 3, 9)) for _ in range(draw.randrange(150)))
        assert len({turn_repair.cheapest_edits(codes, s) for s in (1, 9, 64, 1000)}) == 1
    cost, audit = turn_repair.cheapest_edits(bytes([9]) * 5000)  # no path ever wins before the end
    assert (cost, audit) == (10000, "R" * 5000)


TALK = "conv_id long, turn long, role string, text string, kind string, _1 string, copies int"


def test_repair_matches_brute_force(spark):
    draw, rows = random.Random(6), []
    texts = ["Hi.", "Hi.", "what", "  ", None, "Yes!\t", "no? ", "Long " * 4000 + "end."]
    for conv in [None, -3, *range(12)]:
        for turn in range(draw.randrange(5)):
            rows.append((conv, turn if draw.random() < 0.9 else None, draw.choice(["system", "user", "user", "assistant", "tool", "", None]), draw.choice(texts)))
    rows += rows[:3]
    df = spark.createDataFrame([(*r, "k", "x", 1) for r in rows], TALK)
    got = {r[0]: tuple(r[1:]) for r in turn_repair.repair_summary(df).collect()}
    assert got == plain_summary(rows)


def test_repair_of_an_empty_table_and_of_dropped_rows(spark):
    assert turn_repair.repair_summary(spark.createDataFrame([], TALK)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = turn_repair.repair_summary(spark.createDataFrame([(gone, 0, "user", "Hi.", "", "", 1)], TALK)).collect()[0]
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_read_well(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "user", "C."), (2, 0, "system", "S.")], "conv_id long, turn long, role string, text string")
    report, found = turn_repair.repair(df)
    rows = turn_repair.repaired_rows(found, report).orderBy("conv_id", "place").collect()
    assert [(r.role, r.text, r.edit) for r in rows] == [("user", "", "I"), ("assistant", "A.", "K"), ("user", "B.", "K"), ("assistant", "C.", "R")]
    assert {r.conv_id: (r.cost, r.audit) for r in report.collect()} == {1: (4, "IKKR"), 2: (3, "D")}


# -- byte-level BPE by distinct words -----------------------------------------------------------------------------


def library():
    ranks = distinct_words.read_ranks(public_tokenizers.path(distinct_words.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_distinct_words_agree_with_the_library(spark):
    draw = random.Random(8)
    bits = ["the", " the", "'s", " ", "  ", "\n\n", "\t", " ", " ", "É", "日本語", "🙂", "12", " 345", "!?", "\0", "<|endoftext|>", "é"]
    texts = ["".join(draw.choices(bits, k=draw.randrange(40))) for _ in range(60)] + [None, "", "same text", "same text", "ab c " * 30_000, "x" * 5000]
    rows = [(i if i % 9 else None, t, "b", "s", 1) for i, t in enumerate(texts)]
    rows.append(rows[1])
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, words string, bucket int")
    enc = library()

    def want(row):
        ids = np.array(enc.encode_ordinary(row[1] or ""), dtype="<u4").tobytes()
        return str((row[0], len(ids) // 4, ids, (row[1] or "").encode()))

    for sizes in ({}, {"block_bytes": 100, "bucket_bytes": 5000}):
        got = distinct_words.encode(df, **sizes)
        assert sorted(str((r[0], r[1], bytes(r[2]), bytes(r[3]))) for r in got.collect()) == sorted(map(want, rows))
    again = distinct_words.decode(got.select("doc_id", "ids"))
    assert sorted(bytes(r.decoded) for r in again.collect()) == sorted((t or "").encode() for _, t, *_ in rows)
    assert distinct_words.encode(df.where("false")).collect() == []


def test_segments_do_not_change_pre_tokens(monkeypatch):
    pattern = regex.compile(public_tokenizers.PATTERN)
    text = "Some words,  then\n\n more 'll  1,000 … " * 200
    monkeypatch.setattr(distinct_words, "SEGMENT", 17)
    assert [w for part in distinct_words.pre_tokens(text, pattern) for w in part] == pattern.findall(text)


def test_packing_round_trip_and_unknown_ids():
    assert distinct_words.unpack_parts(distinct_words.pack_parts([b"", b"\0a", b"x" * 3000])) == [b"", b"\0a", b"x" * 3000]
    numbers = np.array([0, 1, 255, 256, 70000], dtype="<u4")
    assert (distinct_words.unpack_numbers(distinct_words.pack_numbers(numbers)) == numbers).all()
    with pytest.raises(ValueError):
        distinct_words.decoded(public_tokenizers.path(distinct_words.RANKS), [np.array([999_999], dtype="<u4").tobytes()])


# -- Merkle manifest ----------------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows):
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for g in langs]
    trees, out = [plain_tree([plain_leaf(r) for r in g]) for g in groups], []
    top = plain_tree([t[-1][0] for t in trees])
    for at, (group, tree) in enumerate(zip(groups, trees)):
        for no, row in enumerate(group):
            sides = []
            for levels, place in ((tree, no), (top, at)):
                for level in levels[:-1]:
                    run = level[place // 8 * 8 : place // 8 * 8 + 8]
                    sides.append((run[: place % 8], run[place % 8 + 1 :]))
                    place //= 8
            hit = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            folded = plain_leaf((*row[:4], row[4].translate(lower) if hit else row[4]))
            for left, right in sides:
                folded = digest(*left, folded, *right)
            proof = digest(*[s for left, right in sides for s in (*left, *right)])
            out.append((row[0], plain_leaf(row), tree[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, digest string, no int, tree int"


@pytest.mark.parametrize(
    "rows, chunk_levels",
    [
        ([(i, "s", f"l{i % 11}" if i % 5 else None, i, f"T{i} É") for i in range(150)], 1),
        ([(1, "s", "en", 3, "AbC"), (3, None, None, None, None), (None, "x", None, 5, "É A"), (None, "x", None, 5, "É A"), (6, "s", "en", 9, "B" * 200_000)], 4),
        ([(i, "s", "en", 1, "Word") for i in range(70)], 1),
        ([(12, "s", "en", 3, "AbC")], 4),
    ],
)
def test_manifest_matches_brute_force(spark, monkeypatch, rows, chunk_levels):
    monkeypatch.setattr(merkle, "CHUNK_LEVELS", chunk_levels)
    df = spark.createDataFrame([(*r, "d", 7, 7) for r in rows], DOCS)
    assert sorted(map(str, map(tuple, merkle.manifest(df).collect()))) == sorted(map(str, plain_manifest(rows)))


def test_manifest_of_an_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []
