"""Similar texts against brute force over all pairs."""

import random

import numpy as np

from landloom.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def plain_stays(texts):
    """Ids that stay: the least of each group joined by similar pairs."""
    sets, kin = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((kin[i], kin[j]))
                kin = {k: a if v == b else v for k, v in kin.items()}
    return sorted(set(kin.values()))


def stays(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return sorted(r["doc_id"] for r in simhash.drop_similar(docs).collect())


def test_copies_behind_an_unlike_head(spark):
    """One vocabulary in other orders: one fingerprint, so neither copy is first or head."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    orders = [rng.sample(words, 60) for _ in range(4)]
    texts = {i: " ".join(o) for i, o in enumerate(orders)}
    texts |= {10 + i: " ".join([*o[1:], o[0]]) for i, o in enumerate(orders[2:])}
    assert len({simhash.set_fingerprints(t.encode(), (simhash.SEED,))[0] for t in texts.values()}) == 1
    assert stays(spark, texts) == plain_stays(texts) == [0, 1, 2, 3]


def test_a_shingle_of_many_unlike_texts(spark):
    """More groups at one shingle than a round has heads, copies among them."""
    rng = random.Random(5)
    line = "this line stands in each of the texts"
    texts = {i: f"{line} w{rng.randrange(10**6)} w{i}" for i in range(150)}
    texts |= {500 + i: f"{texts[i]} tail" for i in range(0, 150, 3)}
    assert stays(spark, texts) == plain_stays(texts)


def test_short_texts_of_all_lengths(spark):
    """A word more or less, from five words on and across the switch to single words of the fingerprints."""
    rng, texts = random.Random(2), {}
    for n in (19, 20, *range(6, 40)):
        for _ in range(3):
            words = [f"v{rng.randrange(10**6)}" for _ in range(n)]
            texts[len(texts)] = " ".join(words)
            texts[len(texts)] = " ".join([*words, f"x{n}"])
    for _ in range(6):
        few = [f"u{rng.randrange(10**6)}" for _ in range(19)]
        words = [*few, *(rng.choice(few) for _ in range(41))]
        texts[len(texts)] = " ".join(words)
        texts[len(texts)] = " ".join([*words, "new"])
    want = plain_stays(texts)
    assert len(want) < len(texts) * 0.6
    assert stays(spark, texts) == want


def test_copies_in_a_crowded_segment(spark):
    """Over 64 fingerprints that share a half, heads unlike the copies; and a chain of copies."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    halves = {}
    for i in range(4000):
        more = [f"x{i}-{k}" for k in range(6)]
        fp = simhash.set_fingerprints(" ".join(words + more).encode(), (simhash.SEED,))[0]
        halves.setdefault(fp & 0xFFFFFFFF, {})[fp] = more
    crowd = max(halves.values(), key=len)
    assert len(crowd) > 64
    texts = {i: " ".join(rng.sample(words, 300) + more) for i, more in enumerate(crowd.values())}
    texts |= {1000 + i: f"{texts[i]} y{i}" for i in range(20, len(crowd), 3)}
    step = texts[7].split()
    for i in range(6):
        step[i * 40 : i * 40 + 20] = [f"z{i}-{k}" for k in range(20)]
        texts[2000 + i] = " ".join(step)
    assert stays(spark, texts) == plain_stays(texts)


def test_bins_bound_what_texts_share():
    rng = np.random.default_rng(7)
    counts, want = [], []
    for n in (0, 3, 400, 90_000):
        for part in (0.0, 0.5, 1.0):
            a = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
            b = np.unique(np.concatenate([a[: int(part * len(a))], rng.integers(-(1 << 63), (1 << 63) - 1, n - int(part * n))]))
            counts.append([simhash.shingle_counts(v) for v in (a, b)])
            want.append((len(np.intersect1d(a, b)), len(a) + len(b)))
    most = simhash.most_shared(*(np.stack(c) for c in zip(*counts)))
    assert all(shared <= m for m, (shared, _) in zip(most, want))
    full = [bool((np.stack(c) == simhash.FULL).any()) for c in counts]
    assert any(full) and all((m > both) == f for m, (_, both), f in zip(most, want, full))
    assert most[6] < 400 * 0.8  # texts without anything in common are ruled out


def test_simhash_links_come_first(spark, monkeypatch):
    """Copies with one word more are paired by linked fingerprints; unlike texts of one fingerprint are not taken for copies."""
    rng, seen, real = random.Random(8), [], simhash.linked_texts

    def spy(prints):
        pairs = real(prints)
        fps = {r["no"]: (r["doc_id"], r["fp"] & (2**64 - 1)) for r in prints.collect()}
        seen.extend((fps[r["u"]], fps[r["v"]]) for r in pairs.collect())
        return pairs

    monkeypatch.setattr(simhash, "linked_texts", spy)
    texts = {i: " ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for i in range(20)}
    texts |= {100 + i: f"{texts[i]} x{i}" for i in range(20)} | {200: texts[3].upper(), 300: "", 301: " ", 302: "a"}
    assert stays(spark, texts) == plain_stays(texts)
    assert all((a[1] ^ b[1]).bit_count() <= 3 for a, b in seen)
    paired = {frozenset((a[0], b[0])) for a, b in seen}
    assert len({frozenset((i, 100 + i)) for i in range(20)} & paired) >= 15 and frozenset((300, 301)) in paired


def test_pairs_of_a_crowd_of_versions(spark, monkeypatch):
    """Versions of one text, most unlike each other, meet at the same shingles: few are held against each other, none is lost."""
    rng, made, real = random.Random(9), [], simhash.saved

    def spy(df, label):
        out = real(df, label)
        if label == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "saved", spy)
    words, texts = [f"w{i}" for i in range(150)], {}
    for i in range(240):
        own = list(words)
        for k in rng.sample(range(150), rng.choice((1, 2, 3, 4, 4, 5, 5, 6))):
            own[k] = f"x{i}-{k}"
        texts[i] = " ".join(own)
    want = plain_stays(texts)
    assert 10 < len(want) < 200
    assert stays(spark, texts) == want
    assert sum(made) < 12 * len(texts)


def test_groups_are_joined_by_new_links_only(spark, monkeypatch):
    """Each similar pair is given to the search of groups once, whatever the number of rounds; links of fingerprints alone are not."""
    rng, given, found, real, kept = random.Random(4), [], [], simhash.connected_components, simhash.saved

    def components(links):
        given.append(links.count())
        return real(links)

    def spy(df, label):
        out = kept(df, label)
        if label == "similar":
            found.append(out.count())
        return out

    monkeypatch.setattr(simhash, "connected_components", components)
    monkeypatch.setattr(simhash, "saved", spy)
    words, texts = [f"w{i}" for i in range(60)], {}
    for i in range(40):
        own = list(words)
        for k in rng.sample(range(60), rng.choice((0, 1, 1, 2))):
            own[k] = f"x{i}-{k}"
        texts[i] = " ".join(own)
    assert stays(spark, texts) == plain_stays(texts)
    assert len([n for n in found if n]) > 1 and sum(given) == sum(found)


def test_groups_joined_in_steps_equal_all_links_at_once(spark):
    rng, kin, links, want = random.Random(6), None, [], {}
    for _ in range(3):
        more = [tuple(sorted(rng.sample(range(60), 2))) for _ in range(12)]
        kin = simhash.joined_groups(kin, spark.createDataFrame(more, "u long, v long"))
        links += more
        want = {n: n for pair in links for n in pair}
        for u, v in links * 12:
            want[u] = want[v] = min(want[u], want[v])
        assert {r["no"]: r["kin"] for r in kin.collect()} == want


def test_hashes_of_runs_of_words():
    """Shingles are told apart by their words in order, and fingerprint bits are those of the majority."""
    rng = random.Random(10)
    texts = ["", " ", "a", "a b", "b a", "a b c d", "a b c d e", "b a c d e", "A b  c\td e", "ab c d e f"]
    texts += [" ".join(f"w{rng.randrange(30)}" for _ in range(n)) for n in (5, 60, 4000)]
    for words in (3, 5):
        runs = [[tuple(p[i : i + words]) for i in range(max(1, len(p) - words + 1))] for p in (t.lower().split() for t in texts)]
        hashes = [simhash.run_hashes(simhash.word_hashes(t.encode()), words).tolist() for t in texts]
        named = {h: r for run, own in zip(runs, hashes) for r, h in zip(run, own, strict=True)}
        assert len(named) == len({r for run in runs for r in run})
        assert all([named[h] for h in own] == run for run, own in zip(runs, hashes))
    for t in texts:
        own = simhash.word_hashes(t.encode())
        assert simhash.shingle_hashes(own, 5).tolist() == sorted(set(simhash.run_hashes(own, 5).view(np.int64).tolist()))
        found = simhash.run_hashes(own, 3)
        bits = [2 * sum(h >> i & 1 for h in found.tolist()) > len(found) for i in range(64)]
        assert simhash.majority(found) & (2**64 - 1) == sum(1 << i for i, b in enumerate(bits) if b)


def test_rounds_do_not_grow_with_groups(spark, monkeypatch):
    """Groups of many members at the same shingles took a round for each member; few pairs are left after some, and are held at once."""
    rng, rounds, real = random.Random(11), [], simhash.saved

    def spy(df, label):
        rounds.extend([label] if label == "pairs" else [])
        return real(df, label)

    monkeypatch.setattr(simhash, "saved", spy)
    lines, texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(12)) for _ in range(8)], {}
    for i in range(10):
        own = " ".join(rng.sample(lines, 5))
        texts |= {i * 100 + k: f"{own} {' '.join(['x', 'y'][: k % 3])} z{k}" for k in range(14)}
    want = plain_stays(texts)
    assert len(want) < 20
    assert stays(spark, texts) == want
    assert len(rounds) <= 5
