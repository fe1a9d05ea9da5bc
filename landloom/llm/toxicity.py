"""Toxicity: a Levenshtein automaton over a learned lexicon trie, and context windows.

Training reads a bounded, documented sample of labelled rows. Words and word
stems that stand in toxic texts far more often than chance allows become the
lexicon. A trie of the lexicon is intersected with the Levenshtein automaton of
each term's edit limit; the product is made deterministic as texts are read, so
a word costs one table look-up per letter until it leaves the automaton. Every
hit is weighed by the words around it: between quotation marks, or beside a verb
of reporting and a mark, it counts as quoted, else as abuse. A logistic
regression turns the counts of a text into its score.

Scale. Labels are reduced to the sample first (a small, bounded table, the only
one that is broadcast); documents are then read in place, in one pass for
scoring, with no shuffle of texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.llm.common import text_bytes, text_of

#: Labelled rows that training may use, taken by the hash of their id.
TRAIN_ROWS = 20_000
#: A term must be this unlikely to stand in its toxic texts by chance.
CHANCE = 1e-5
LEAST_SHARE = 0.6
STEMS = range(3, 11)
WINDOW = 5
QUOTES = "\"“”„‟«»‹›`"
REPORTING = frozenset("said says say called calls word term quote quoted wrote writes sagte schrieb dit écrit dijo escribió".split())
FOLDS = 5
FEATURES = ("whole", "near", "stem", "near_stem", "quoted", "any")


def edit_limit(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Trie of terms, intersected with their Levenshtein automata.

    ``terms`` are ``(text, stem)``; a stem accepts any ending. A state is a set of
    (trie node, edits so far); its successors are worked out once.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.room = [0]
        for i, (text, _) in enumerate(terms):
            limit, node = edit_limit(text), 0
            self.room[0] = max(self.room[0], limit)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], limit)
            self.ends[node].append(i)
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0}, None)
        self.dead = self._state({}, None)

    def _state(self, nodes: dict[int, int], stem: tuple[int, int] | None) -> int:
        open_nodes = list(nodes.items())
        while open_nodes:  # letters of the term that the word lacks
            node, edits = open_nodes.pop()
            if nodes.get(node, 99) < edits:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.room[child] and edits + 1 < nodes.get(child, 99):
                    nodes[child] = edits + 1
                    open_nodes.append((child, edits + 1))
        best = stem
        for node, edits in nodes.items():
            for i in self.ends[node]:
                text, is_stem = self.terms[i]
                if edits <= edit_limit(text):
                    if best is None or (edits, i) < best:
                        best = (edits, i)
                    if is_stem and (stem is None or (edits, i) < stem):
                        stem = (edits, i)
        key = (frozenset(nodes.items()), stem)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            self.found.append(best)
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        items, stem = self.states[state]
        nodes: dict[int, int] = {}
        for node, edits in items:
            if edits + 1 <= self.room[node]:
                nodes[node] = min(edits + 1, nodes.get(node, 99))
            for c, child in self.children[node].items():
                cost = edits + (c != letter)
                if cost <= self.room[child]:
                    nodes[child] = min(cost, nodes.get(child, 99))
        self.next[state][letter] = to = self._state(nodes, stem)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """``(edits, term)`` of the nearest term of which ``word`` is a spelling."""
        state, table = self.start, self.next
        for letter in word:
            to = table[state].get(letter)
            state = self._step(state, letter) if to is None else to
            if state == self.dead:
                return None
        return self.found[state]


PART = re.compile(r"\w+")


def words_of(token: str) -> list[str]:
    """The letter and digit runs of a token, and all of them joined where marks stand inside."""
    parts = PART.findall(token)
    return [*parts, "".join(parts)] if len(parts) > 1 else parts


class Hits(dict):
    """Token to its match, worked out once per token; emptied when large."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str):
        found = [m for w in words_of(token) if (m := self.lexicon.match(w)) is not None]
        self[token] = out = min(found, default=None)
        return out

    def of(self, text: bytes) -> list[tuple[int, tuple[int, int], bool]]:
        """``(token index, match, quoted)`` for the hits of a whole text."""
        if len(self) > 300_000:
            self.clear()
        tokens = text.decode("utf-8", "replace").lower().split()
        out = []
        for i, match in enumerate(map(self.__getitem__, tokens)):
            if match is not None:
                out.append((i, match, quoted(tokens, i)))
        return out


def quoted(tokens: list[str], i: int) -> bool:
    before, after = tokens[max(0, i - WINDOW) : i + 1], tokens[i : i + WINDOW + 1]
    opened = any(t[0] in QUOTES for t in before)
    closed = any(c in QUOTES for t in after for c in t[-2:])
    if opened and closed:
        return True
    reported = not REPORTING.isdisjoint(t.strip(".,:;") for t in [*before, *after])
    return reported and (opened or closed)


def features(lexicon: Lexicon, hits: list[tuple[int, tuple[int, int], bool]]) -> list[float]:
    counts = dict.fromkeys(FEATURES, 0)
    for _, (edits, term), is_quoted in hits:
        kind = "quoted" if is_quoted else ("near_" if edits else "") + "stem" if lexicon.terms[term][1] else "near" if edits else "whole"
        counts[kind] += 1
    counts["any"] = counts["whole"] + counts["stem"] > 0
    return [math.log1p(counts[f]) for f in FEATURES]


@dataclass
class ToxicityModel:
    terms: list[tuple[str, bool]] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    bias: float = -20.0

    def score(self, values: list[float]) -> float:
        z = self.bias + sum(w * v for w, v in zip(self.weights, values))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def held_out(doc_id: Column) -> Column:
    """True for the fold that training never reads; null ids are in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``text, toxic`` of at most ``rows`` labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    return docs.select(F.col("doc_id").cast("long").alias("_id"), text_of("text").alias("t")).join(F.broadcast(sample), "_id")


def _terms_of(text: bytes) -> tuple[set[str], set[str]]:
    found = {w for token in set(text.decode("utf-8", "replace").lower().split()) for w in PART.findall(token)}
    return found, {w[:n] for w in found for n in STEMS if len(w) > n}


def _term_counts(rows: DataFrame, only: set[str] | None) -> DataFrame:
    """Texts per term: words as they are, stems with a star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in text_bytes(batch.column("t")):
                words, stems = _terms_of(text)
                terms = words | {s + "*" for s in stems}
                counts.update(terms if only is None else terms & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return rows.select("t").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _tail(n_toxic: int, n: int, base: float) -> float:
    """Log of a bound (Chernoff) on the chance that ``n_toxic`` of ``n`` texts are toxic at the base rate."""
    p = n_toxic / n
    if p <= base:
        return 0.0
    divergence = p * math.log(p / base) + (0 if p == 1 else (1 - p) * math.log((1 - p) / (1 - base)))
    return -n * divergence


def choose_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> list[tuple[str, bool]]:
    """Terms of the lexicon from texts per term.

    A stem is taken where it covers clearly more texts than any of its words or
    longer stems; a word where no stem covers it.
    """
    base = max(1e-6, n_toxic / max(1, n_toxic + n_clean))
    good = {}
    for term, n in toxic.items():
        m = clean.get(term, 0)
        if n / (n + m) >= LEAST_SHARE and _tail(n, n + m, base) <= math.log(CHANCE):
            good[term] = n
    stems = {t[:-1]: n for t, n in good.items() if t.endswith("*")}
    longest: dict[str, int] = Counter()  # best count among words and longer stems under a stem
    for term, n in toxic.items():
        text = term.rstrip("*")
        for size in STEMS:
            if len(text) > size or (len(text) == size and not term.endswith("*")):
                longest[text[:size]] = max(longest[text[:size]], n)
    kept = {s for s, n in stems.items() if longest[s] < 0.9 * n}
    kept = {s for s in kept if not any(s[:n] in kept for n in STEMS if n < len(s))}
    words = [t for t in good if not t.endswith("*") and len(t) > 2 and not any(t[:n] in kept for n in STEMS)]
    return sorted([(s, True) for s in kept] + [(w, False) for w in words])


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[list[float], float]:
    """Ridge logistic regression by Newton steps; the bias is not penalised."""
    design = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        slope = design.T @ (p - y) + penalty * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1].tolist(), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed_terms: tuple[str, ...] = ()) -> ToxicityModel:
    """Learn lexicon and weights. Without toxic or without clean rows all texts score the same.

    Only counts per term and a few numbers per sampled row reach the driver.
    """
    sample = training_rows(docs, labels, rows)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sum(n for k, n in sizes.items() if k > 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel(bias=20.0 if n_toxic else -20.0)
    least = max(2, math.ceil(math.log(CHANCE) / math.log(min(0.5, n_toxic / (n_toxic + n_clean)))))
    toxic = {r["term"]: r["n"] for r in _term_counts(sample.where("toxic > 0"), None).where(F.col("n") >= least).collect()}
    clean = {r["term"]: r["n"] for r in _term_counts(sample.where("toxic = 0"), set(toxic)).collect()}
    terms = sorted({*choose_terms(toxic, clean, n_toxic, n_clean), *((t.lower(), False) for t in seed_terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        hits = Hits(lexicon)
        for batch in batches:
            values = [features(lexicon, hits.of(t)) for t in text_bytes(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column("toxic")], ["x", "y"])

    rows_x = sample.select("t", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")).mapInArrow(run, "x array<double>, y int")
    # Equal rows are counted, so what comes back has few rows.
    got = rows_x.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("x", "y").collect()
    x = np.repeat(np.array([r["x"] for r in got]), [r["n"] for r in got], axis=0)
    y = np.repeat(np.array([r["y"] for r in got], dtype=float), [r["n"] for r in got])
    weights, bias = fit_weights(x, y)
    return ToxicityModel(terms, weights, bias)


#: Rows whose scores and hits are held at once.
SCORED = 1024


def score(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_hits: bool = True
) -> DataFrame:
    """``doc_id, score, predicted, hits`` per input row, then the ``carry`` columns.

    ``hits`` lists ``token, term, edits, quoted`` (left out without ``with_hits``). Null and empty
    texts have no hits and get the score of a text without any; repeated rows stay.
    """
    kind = pa.list_(pa.struct([("token", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms)
        table = Hits(lexicon)
        for whole in batches:
            for at in range(0, whole.num_rows, SCORED):
                batch = whole.slice(at, SCORED)
                scores, hits = [], []
                for t in text_bytes(batch.column(text_at)):
                    found = table.of(t)
                    scores.append(model.score(features(lexicon, found)))
                    if with_hits:
                        hits.append([{"token": i, "term": lexicon.terms[m[1]][0], "edits": m[0], "quoted": q} for i, m, q in found])
                own = {f"_c{i}": batch.column(f"_c{i}") for i in range(len(carry))}
                shown = {"hits": pa.array(hits, kind)} if with_hits else {}
                predicted = pa.array([int(s >= 0.5) for s in scores], pa.int32())
                out = {"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64()), "predicted": predicted, **shown, **own}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    # A text that is carried along need not be sent twice.
    carried = text_col in carry and docs.schema[text_col].dataType.simpleString() == "string"
    text_at = f"_c{carry.index(text_col)}" if carried else "_t"
    own_text = [] if carried else [text_of(text_col).alias("_t")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *own_text, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    made = "doc_id long, score double, predicted int" + (", hits array<struct<token:int,term:string,edits:int,quoted:boolean>>" if with_hits else "")
    types = "".join(f", `_c{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    return rows.mapInArrow(run, made + types)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects, columns as they were."""
    names = docs.columns
    out = score(docs, model, names[0] if "doc_id" not in names else "doc_id", text_col, tuple(names), with_hits=False)
    return out.where("predicted = 0").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
